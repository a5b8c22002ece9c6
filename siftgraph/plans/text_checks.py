"""Registered queries: passage and entity cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .fixtures import Tables
from .registry import check

P = X.DEFAULT.patterns("(?m)")


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(expr: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def split_lines(expr: str) -> str:
    parts = f"string_split_regex({expr}, {q(P['breaks'])})"
    return f"list_filter(list_transform({parts}, lambda x: trim(x, {q(X.WS_CHARS)})), lambda x: x <> '')"


def blank_free(expr: str) -> str:
    return f"coalesce(array_to_string({split_lines(expr)}, chr(10)), '')"


def words(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(P['word'])}))"


def cut(expr: str, pattern: str) -> str:
    return f"string_split_regex({expr}, {q(pattern)})[1]"


def visible(expr: str) -> str:
    return rx(rx(expr, f"[{X.INVISIBLE_CHARS}]"), f"[{X.NBSP_CHARS}]", " ")


def links(expr: str) -> str:
    for _ in range(3):
        expr = rx(rx(expr, P["link_piped"], r"\1"), P["link_plain"], r"\1")
    return rx(expr, P["link_left"])


MEDIA = (
    f"(regexp_matches(line, {q(P['placement'])}) OR "
    f"(contains(line, '|') AND regexp_matches(line, {q(P['media'])})))"
)
REST = (
    f"regexp_replace(trim(split_part(line, '|', -1), {q(X.WS_CHARS)}), {q(P['leading_size'])}, '')"
)
CAPTION = (
    f"({words('line')} <= {X.CAPTION_MAX_WORDS} AND NOT regexp_matches(line, {q(P['section'])}) "
    "AND right(line, 1) NOT IN ('.', '!', '?', '\"', ':'))"
)
KIND = (
    f"CASE WHEN {MEDIA} THEN CASE WHEN {words(REST)} >= {X.KEEP_MIN_WORDS} THEN 'K' ELSE 'M' END "
    f"WHEN {CAPTION} THEN 'C' ELSE 'O' END"
)
# text after the footer cut, its lines with kinds, and the text without media and captions
STEPS = f"""
WITH footless AS (SELECT doc_id, {cut(visible('text'), P['cut_v3'])} AS t FROM marked),
listed AS (SELECT doc_id, {split_lines('t')} AS ls FROM footless),
numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM listed),
kinds AS (SELECT doc_id, pos, line, {KIND} AS kind, {REST} AS rest FROM numbered),
state AS (SELECT *, last_value(CASE WHEN kind <> 'C' THEN kind END IGNORE NULLS)
                    OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM kinds),
kept AS (SELECT doc_id, string_agg(CASE WHEN kind = 'K' THEN rest ELSE line END, chr(10) ORDER BY pos) AS t
         FROM state WHERE kind <> 'M' AND NOT (kind = 'C' AND coalesce(before, 'O') = 'M') GROUP BY doc_id),
medialess AS (SELECT f.doc_id, coalesce(k.t, '') AS t FROM footless f LEFT JOIN kept k ON f.doc_id = k.doc_id)
"""
TAIL = rx(
    rx(rx(rx(f"replace({links(rx('t', P['html']))}, '|', ' ')", P["header"], r"\1"), P["bullet"]), P["leading_size"]),
    P["spaces"],
    " ",
)
CLEAN_V3 = f"{STEPS}, cleaned AS (SELECT doc_id, {blank_free(TAIL)} AS v3 FROM medialess)"
CLEAN_V1 = blank_free(cut("text", P["cut_v1"]))
CLEAN_V2 = blank_free(cut("text", P["cut_v2"]))


def entity(expr: str) -> str:
    e = f"replace({rx(links(visible(expr)), P['html'])}, '|', ' ')"
    return f"trim({rx(e, P['spaces'], ' ')}, {q(X.WS_CHARS)})"


def text_query(name: str, column, sql_expr: str, source: str = "marked"):
    """Register one cleaning step over whole texts."""

    @check(name, "doc_id:i text:s", f"SELECT doc_id, {sql_expr} AS text FROM {source}")
    def _(t: Tables):
        return t.marked.select("doc_id", column().alias("text"))


text_query("b01_clean_v1", lambda: X.clean("text", "v1"), CLEAN_V1)
text_query("b02_clean_v2", lambda: X.clean("text", "v2"), CLEAN_V2)
text_query("b04_drop_invisible", lambda: X.drop_invisible("text"), visible("text"))
text_query(
    "b05_footer_cut",
    lambda: X.cut_footer(X.drop_invisible("text")),
    cut(visible("text"), P["cut_v3"]),
)
text_query("b09_strip_html", lambda: X.strip_html("text"), rx("text", P["html"]))
text_query("b10_unwrap_links", lambda: X.unwrap_links("text"), links("text"))
text_query("b11_pipes_to_spaces", lambda: X.pipes_to_spaces("text"), "replace(text, '|', ' ')")
text_query("b12_unwrap_headers", lambda: X.unwrap_headers("text"), rx("text", P["header"], r"\1"))
text_query("b13_strip_bullets", lambda: X.strip_bullets("text"), rx(rx("text", P["bullet"]), P["leading_size"]))
text_query("b14_blank_lines", lambda: X.drop_blank_lines(X.collapse_spaces("text")), blank_free(rx("text", P["spaces"], " ")))


@check("b03_clean_v3", "doc_id:i text:s", f"{CLEAN_V3} SELECT doc_id, v3 AS text FROM cleaned")
def _(t: Tables):
    return t.marked.select("doc_id", X.clean("text").alias("text"))


@check(
    "b06_media_lines",
    "doc_id:i pos:i is_media:i",
    f"{STEPS} SELECT doc_id, pos, CASE WHEN kind IN ('M', 'K') THEN 1 ELSE 0 END AS is_media FROM kinds",
)
def _(t: Tables):
    lines = X.passage_lines(t.marked, "doc_id")
    return lines.select("doc_id", "pos", X.is_media_line(F.col("line")).alias("is_media"))


@check(
    "b07_media_remainder",
    "doc_id:i pos:i rest:s keep:i",
    f"{STEPS} SELECT doc_id, pos, rest, CASE WHEN kind = 'K' THEN 1 ELSE 0 END AS keep FROM kinds"
    " WHERE kind IN ('M', 'K')",
)
def _(t: Tables):
    lines = X.passage_lines(t.marked, "doc_id").filter(F.col("kind").isin("M", "K"))
    rest = X.media_remainder(F.col("line"))
    return lines.select("doc_id", "pos", rest.alias("rest"), (F.col("kind") == "K").alias("keep"))


@check("b08_caption_drop", "doc_id:i text:s", f"{STEPS} SELECT doc_id, t AS text FROM medialess")
def _(t: Tables):
    cut_text = X.cut_footer(X.drop_invisible("text"))
    return t.marked.select("doc_id", X.drop_media_lines(cut_text).alias("text"))


@check("b15_clean_entity", "row_id:s subject:s", f"SELECT row_id, {entity('subject')} AS subject FROM entities")
def _(t: Tables):
    return t.entities.select("row_id", X.clean_entity("subject").alias("subject"))


FRAME_SQL = f"""{CLEAN_V3}
SELECT m.doc_id, c.v3 AS text, {entity("concat('[[', lang, '|', source, ']]')")} AS subject,
       {entity("concat(source, '|', lang)")} AS object
FROM marked m JOIN cleaned c ON m.doc_id = c.doc_id"""


@check("b16_clean_frame", "doc_id:i text:s subject:s object:s", FRAME_SQL)
def _(t: Tables):
    df = t.marked.select(
        "doc_id",
        "text",
        F.concat(F.lit("[["), "lang", F.lit("|"), "source", F.lit("]]")).alias("subject"),
        F.concat("source", F.lit("|"), "lang").alias("object"),
    )
    return X.clean_frame(df)


AUDIT_SQL = f"""{CLEAN_V3},
paired AS (SELECT {CLEAN_V1} AS a, c.v3 AS b FROM marked m JOIN cleaned c ON m.doc_id = c.doc_id),
counted AS (SELECT a, b, {words('a')} AS wa, {words('b')} AS wb FROM paired)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE a <> b) AS n_changed, avg(wa) AS mean_words_v1,
       avg(wb) AS mean_words_v3, count(*) FILTER (WHERE trim(b, {q(X.WS_CHARS)}) = '') AS n_empty,
       count(*) FILTER (WHERE wa >= 30 AND wb < 0.5 * wa) AS n_lost_half
FROM counted"""


@check(
    "b17_change_audit",
    "n_rows:i n_changed:i mean_words_v1:d mean_words_v3:d n_empty:i n_lost_half:i",
    AUDIT_SQL,
)
def _(t: Tables):
    return X.change_audit(t.marked)


RESIDUALS = X.DEFAULT.residual_patterns("(?m)")


@check(
    "b18_residual_audit",
    " ".join(f"{k}:i" for k in RESIDUALS) + " empty_text:i",
    "SELECT "
    + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, {q(v)})) AS {k}" for k, v in RESIDUALS.items())
    + f", count(*) FILTER (WHERE trim(text, {q(X.WS_CHARS)}) = '') AS empty_text FROM marked",
)
def _(t: Tables):
    return X.residual_audit(t.marked)


@check(
    "b18_entity_audit",
    "column_name:s links:i pipes:i invisible:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, "
        rf"count(*) FILTER (WHERE regexp_matches({c}, '\[\[|\]\]')) AS links, "
        f"count(*) FILTER (WHERE contains({c}, '|')) AS pipes, "
        f"count(*) FILTER (WHERE regexp_matches({c}, {q('[' + X.ENTITY_AUDIT_CHARS + ']')})) AS invisible "
        "FROM entities"
        for c in X.ENTITY_COLUMNS
    ),
)
def _(t: Tables):
    return X.entity_audit(t.entities)


@check(
    "b19_entity_in_passage",
    "doc_id:i subject_found:i object_found:i",
    "SELECT doc_id, contains(text, lang) AS subject_found, contains(text, source) AS object_found FROM {documents}",
)
def _(t: Tables):
    return t.documents.select(
        "doc_id",
        X.entity_in_passage("lang", "text").alias("subject_found"),
        X.entity_in_passage("source", "text").alias("object_found"),
    )


@check("p02_sql_functions", "doc_id:i text:s words:i", f"{CLEAN_V3} SELECT doc_id, v3 AS text, {words('v3')} AS words FROM cleaned")
def _(t: Tables):
    X.register_sql(t.spark)
    return t.marked.selectExpr("doc_id", "clean_v3(text) AS text", "word_count(clean_v3(text)) AS words")


@check("p03_passage_lines", "doc_id:i pos:i line:s kind:s", f"{STEPS} SELECT doc_id, pos, line, kind FROM kinds")
def _(t: Tables):
    return X.passage_lines(t.marked, "doc_id")


@check(
    "c22_word_and_char_count",
    "doc_id:i words:i chars:i",
    f"SELECT doc_id, {words('text')} AS words, length(text) AS chars FROM marked",
)
def _(t: Tables):
    return t.marked.select("doc_id", X.word_count("text").alias("words"), X.char_count("text").alias("chars"))


@check(
    "c23_fast_word_estimate",
    "doc_id:i words:i",
    "SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS words FROM {documents}",
)
def _(t: Tables):
    return t.documents.select("doc_id", X.fast_word_estimate("text").alias("words"))


@check("c24_upper_clip", "doc_id:i clipped:i", "SELECT doc_id, least(length(text), 5000) AS clipped FROM {documents}")
def _(t: Tables):
    return t.documents.select("doc_id", X.clip_upper(F.length("text"), 5000).alias("clipped"))


@check(
    "c25_snippet",
    "doc_id:i snippet:s",
    "SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 150) AS snippet FROM {documents}",
)
def _(t: Tables):
    return t.documents.select("doc_id", X.snippet("text").alias("snippet"))


@check(
    "c27_tail_tokens",
    "doc_id:i tail:s",
    f"WITH toks AS (SELECT doc_id, regexp_extract_all(text, {q(P['word'])}) AS w FROM {{documents}})"
    " SELECT doc_id, array_to_string(list_slice(w, greatest(len(w) - 63, 1), len(w)), ' ') AS tail FROM toks",
)
def _(t: Tables):
    return t.documents.select("doc_id", X.keep_tail_tokens("text", 64).alias("tail"))
