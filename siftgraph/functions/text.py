"""Passage and entity cleaning as native column expressions (no Python per row)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------
# Word lists, character sets and limits below must equal the published cleaning rules.
FOOTER_SECTIONS = (
    "קישורים חיצוניים",
    "ראו גם",
    "הערות שוליים",
    "לקריאה נוספת",
    "גלריה",
    "גלריית תמונות",
    "עיינו גם",
    "מקורות",
    "ביבליוגרפיה",
)
FOOTER_SECTIONS_V2 = ("קישורים חיצוניים", "ראו גם", "הערות שוליים")
FOOTER_HEADERS_V1 = ("==קישורים חיצוניים==", "==ראו גם==", "==הערות שוליים==")
CATEGORY_WORD = "קטגוריה"
SIZE_UNITS = ("px", "פיקסלים")
FRAME_WORDS = ("ממוזער", "thumb", "מסגרת", "frameless", "frame", "ללא[_ ]מסגרת", "upright")
PLACEMENT_WORDS = ("right", "left", "center", "שמאל", "ימין", "מרכז")
ATTRIBUTE_WORDS = ("קישור", "טקסט", "link", "alt")
TABLE_WORDS = ("width", "align", "style", "colspan", "rowspan")
RESIDUAL_FOOTERS = ("קישורים חיצוניים", "ראו גם", "הערות שוליים", "לקריאה נוספת")
KEEP_MIN_WORDS = 12
CAPTION_MAX_WORDS = 6
SENTENCE_END = '.!?":'
NBSP_CHARS = "\xa0\u2007\u202f"
INVISIBLE_CHARS = (
    "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\ufeff\xad"
)
ENTITY_AUDIT_CHARS = (
    "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u2060\ufeff\xad\xa0"
)
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Unicode white space as a character class body (the same set for strip, split and \s).
WS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# --- end of fixed values ----------------------------------------------------------

LEVELS = ("v1", "v2", "v3")
# A word: printable ASCII is listed first, so most characters need one comparison.
WORD = f"[!-~[^{WS}]]+"


@dataclass(frozen=True)
class Markup:
    """Language-specific words of the cleaning rules; defaults are the Hebrew set."""

    footers: tuple[str, ...] = FOOTER_SECTIONS
    footers_v2: tuple[str, ...] = FOOTER_SECTIONS_V2
    headers_v1: tuple[str, ...] = FOOTER_HEADERS_V1
    category: str = CATEGORY_WORD
    units: tuple[str, ...] = SIZE_UNITS
    frames: tuple[str, ...] = FRAME_WORDS
    placements: tuple[str, ...] = PLACEMENT_WORDS
    attributes: tuple[str, ...] = ATTRIBUTE_WORDS
    table: tuple[str, ...] = TABLE_WORDS

    def patterns(self, line_flag: str = "(?md)") -> dict[str, str]:
        """Regular expressions of all rules.

        ``line_flag`` is the multi-line prefix of the target engine: Java needs the
        Unix-lines flag so that ``^``, ``$`` and ``.`` only know the newline.
        """
        s, n = f"[{WS}]", r"\p{Nd}"
        names = lambda sections: "|".join(
            f"{s}+".join(re.escape(w) for w in name.split()) for name in sections
        )
        size = rf"{n}+{s}*[xX×]?{s}*{n}*{s}*(?:{'|'.join(self.units)})"
        frames, places = "|".join(self.frames), "|".join(self.placements)
        attrs, table = "|".join(self.attributes), "|".join(self.table)
        return {
            "cut_v1": "|".join(re.escape(h).replace(r"\ ", " ") for h in self.headers_v1),
            "cut_v2": f"=={s}*(?:{names(self.footers_v2)}){s}*==|\n{self.category}:",
            "cut_v3": f"{line_flag}(?:=={s}*(?:{names(self.footers)}){s}*==|^{s}*{self.category}:)",
            "breaks": f"[{LINE_BREAKS}]",
            "placement": f"^(?i:{places})$",
            "media": "|".join(
                (
                    rf"(?:{frames}){s}*\|",
                    rf"\|{s}*(?:{frames}|{places}){s}*$",
                    size,
                    f"^(?:{attrs}){s}*=",
                    rf"^(?:{places}){s}*\|",
                    rf"^\|{s}*[^=|]{{0,40}}=",
                    rf"\|{s}*(?:{attrs}){s}*=",
                    r"\|\|",
                    f"^(?:{table}){s}*=",
                )
            ),
            "leading_size": f"{line_flag}^{s}*{size}{s}*[-–—]?{s}*",
            "section": "^={2,}.*={2,}$",
            "html": r"</?[a-zA-Z][^>\n]{0,60}>",
            "link_piped": r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]",
            "link_plain": r"\[\[([^\[\]|]*)\]\]",
            "link_left": r"\[\[|\]\]",
            "header": f"{line_flag}^{s}*={{2,}}{s}*(.*?){s}*={{2,}}{s}*$",
            "bullet": rf"{line_flag}^{s}*[*#]+{s}*",
            "spaces": "[ \t]{2,}",
            "word": f"[^{WS}]+",
            "size": size,
            # at least one word more than a caption has / as many as a kept remainder needs
            "long_line": f"^(?:[^{WS}]+{s}+){{{CAPTION_MAX_WORDS}}}[^{WS}]",
            "long_rest": f"^(?:[^{WS}]+{s}+){{{KEEP_MIN_WORDS - 1}}}[^{WS}]",
        }

    def residual_patterns(self, line_flag: str = "(?md)") -> dict[str, str]:
        """Markup that should be gone after cleaning, by audit name."""
        s, n = f"[{WS}]", r"\p{Nd}"
        foot = "|".join(f"{s}+".join(name.split()) for name in RESIDUAL_FOOTERS)
        return {
            "wiki_link": r"\[\[|\]\]",
            "pipe": r"\|",
            "category": f"{line_flag}^{s}*{self.category}:",
            "footer_header": f"{line_flag}^{s}*(?:{foot}){s}*$",
            "bullet": rf"{line_flag}^{s}*[*#]",
            "image_directive": rf"ממוזער{s}*\||{n}+{s}*x?{s}*{n}*{s}*(?:{'|'.join(self.units)})",
            "html_tag": r"</?[a-zA-Z][^>\n]{0,40}>",
        }


DEFAULT = Markup()


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    return F.btrim(_c(col), F.lit(WS_CHARS))


def let(col, body) -> Column:
    """``body`` applied to a value that is computed once and may be used many times."""
    return F.get(F.transform(F.array(_c(col)), body), F.lit(0))


def contains_any(text: Column, parts) -> Column:
    """Byte-wise test that is far cheaper than a regular expression on the whole text."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def word_count(col) -> Column:
    """Number of runs of non-space characters, Unicode white space."""
    return F.regexp_count(_c(col), F.lit(WORD)).cast("int")


def char_count(col) -> Column:
    return F.length(_c(col))


def fast_word_estimate(col) -> Column:
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def clip_upper(col, limit) -> Column:
    return F.least(_c(col), F.lit(limit))


def snippet(col, n: int = 150) -> Column:
    return F.substring(F.replace(_c(col), F.lit("\n"), F.lit(" ")), 1, n)


def keep_tail_tokens(col, n: int) -> Column:
    """Last ``n`` white-space tokens, joined by one space (the end of a prompt survives)."""
    tokens = F.regexp_extract_all(_c(col), F.lit(WORD), F.lit(0))
    tail = F.slice(tokens, F.greatest(F.size(tokens) - n + 1, F.lit(1)), F.lit(n))
    return F.array_join(tail, " ")


def drop_invisible(col) -> Column:
    """Delete zero-width and direction marks, turn the no-break space family into a space."""
    marks = NBSP_CHARS + INVISIBLE_CHARS
    return let(
        col,
        lambda t: F.when(
            contains_any(t, marks), F.translate(t, marks, " " * len(NBSP_CHARS))
        ).otherwise(t),
    )


def cut_before(col, pattern: str) -> Column:
    """Text before the leftmost match (alternation order does not matter for the start)."""
    return F.split(_c(col), pattern, 2).getItem(0)


def cut_footer(col, markup: Markup = DEFAULT) -> Column:
    """Text before the first footer header or line-initial category tag."""
    return let(
        col,
        lambda t: F.when(
            contains_any(t, ("==", markup.category)), cut_before(t, markup.patterns()["cut_v3"])
        ).otherwise(t),
    )


def text_lines(col) -> Column:
    """Stripped non-blank lines."""
    rare = [c for c in LINE_BREAKS if c != "\n"]
    parts = let(
        col,
        lambda t: F.when(
            contains_any(t, rare), F.split(t, DEFAULT.patterns()["breaks"])
        ).otherwise(F.split(t, "\n")),
    )
    return F.filter(F.transform(parts, strip), lambda line: line != "")


def drop_blank_lines(col) -> Column:
    return F.array_join(text_lines(col), "\n")


def is_media_line(line: Column, markup: Markup = DEFAULT) -> Column:
    p = markup.patterns()
    return line.rlike(p["placement"]) | (line.contains("|") & line.rlike(p["media"]))


def media_remainder(line: Column, markup: Markup = DEFAULT) -> Column:
    tail = strip(F.substring_index(line, "|", -1))
    return F.regexp_replace(tail, markup.patterns()["leading_size"], "")


def is_caption_candidate(line: Column, markup: Markup = DEFAULT) -> Column:
    """Short line without sentence end that is no section header; cheapest tests first."""
    p = markup.patterns()
    ended = reduce(lambda a, b: a | b, [line.endswith(c) for c in SENTENCE_END])
    return ~ended & ~line.rlike(p["long_line"]) & ~line.rlike(p["section"])


def tag_line(line: Column, markup: Markup = DEFAULT) -> Column:
    """Line with a one-letter kind in front: M dropped media, K kept remainder,
    C possible caption, O other."""
    kept = let(
        media_remainder(line, markup),
        lambda rest: F.when(
            rest.rlike(markup.patterns()["long_rest"]), F.concat(F.lit("K"), rest)
        ).otherwise("M"),
    )
    return (
        F.when(is_media_line(line, markup), kept)
        .when(is_caption_candidate(line, markup), F.concat(F.lit("C"), line))
        .otherwise(F.concat(F.lit("O"), line))
    )


def drop_media_lines(col, markup: Markup = DEFAULT) -> Column:
    """Drop media lines and the caption lines right after them.

    All lines carry a kind letter, so splitting at dropped media lines leaves pieces
    whose leading run of caption candidates is what has to go: what stays starts at
    the first line of another kind.
    """
    tagged = F.transform(text_lines(col), lambda line: tag_line(line, markup))
    joined = F.concat(F.lit("\n"), F.array_join(tagged, "\n"))
    pieces = F.split(joined, "\nM")
    kept = F.transform(
        pieces,
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.regexp_extract(piece, "(?s)\n[^C].*", 0)
        ),
    )
    untagged = F.regexp_replace(F.array_join(kept, ""), "\n[COK]", "\n")
    return F.substring(untagged, 2, 2_000_000_000)


def _replaced_if(col, parts, body) -> Column:
    """``body`` only where the text holds one of ``parts``."""
    return let(col, lambda t: F.when(contains_any(t, parts), body(t)).otherwise(t))


def strip_html(col) -> Column:
    return _replaced_if(
        col, ("<",), lambda t: F.regexp_replace(t, DEFAULT.patterns()["html"], "")
    )


def unwrap_links(col, passes: int = 3) -> Column:
    p = DEFAULT.patterns()

    def unwrap(c: Column) -> Column:
        for _ in range(passes):
            c = F.regexp_replace(F.regexp_replace(c, p["link_piped"], "$1"), p["link_plain"], "$1")
        return F.regexp_replace(c, p["link_left"], "")

    return _replaced_if(col, ("[[", "]]"), unwrap)


def pipes_to_spaces(col) -> Column:
    return F.replace(_c(col), F.lit("|"), F.lit(" "))


def unwrap_headers(col) -> Column:
    return _replaced_if(
        col, ("==",), lambda t: F.regexp_replace(t, DEFAULT.patterns()["header"], "$1")
    )


def strip_bullets(col, markup: Markup = DEFAULT) -> Column:
    """Drop list bullets, then size tokens left at line starts."""
    p = markup.patterns()
    no_bullets = _replaced_if(col, ("*", "#"), lambda t: F.regexp_replace(t, p["bullet"], ""))
    return _replaced_if(
        no_bullets, markup.units, lambda t: F.regexp_replace(t, p["leading_size"], "")
    )


def collapse_spaces(col) -> Column:
    return _replaced_if(
        col, ("  ", "\t"), lambda t: F.regexp_replace(t, DEFAULT.patterns()["spaces"], " ")
    )


def clean(col, level: str = "v3", markup: Markup = DEFAULT) -> Column:
    """Clean one passage; null gives the empty string."""
    if level not in LEVELS:
        raise ValueError(f"unknown cleaning level {level!r}")
    p = markup.patterns()
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    if level != "v3":
        return drop_blank_lines(cut_before(c, p[f"cut_{level}"]))
    c = drop_media_lines(cut_footer(drop_invisible(c), markup), markup)
    c = pipes_to_spaces(unwrap_links(strip_html(c)))
    c = strip_bullets(unwrap_headers(c), markup)
    return drop_blank_lines(collapse_spaces(c))


def clean_entity(col) -> Column:
    """Clean a subject, predicate or object value."""
    c = drop_invisible(F.coalesce(_c(col).cast("string"), F.lit("")))
    return strip(collapse_spaces(pipes_to_spaces(strip_html(unwrap_links(c)))))


ENTITY_COLUMNS = ("subject", "predicate", "object")


def clean_frame(df: DataFrame, text: str = "text", level: str = "v3", markup: Markup = DEFAULT):
    """Clean the text column and every entity column the frame has."""
    changed = {c: clean_entity(c) for c in ENTITY_COLUMNS if c in df.columns}
    if text in df.columns:
        changed[text] = clean(text, level, markup)
    return df.withColumns(changed)


def entity_in_passage(entity, text) -> Column:
    return _c(text).contains(_c(entity))


def change_audit(df: DataFrame, text: str = "text", markup: Markup = DEFAULT) -> DataFrame:
    """One row: rows, rows changed v1 to v3, mean words, empties, rows losing half."""
    both = df.select(clean(text, "v1", markup).alias("a"), clean(text, "v3", markup).alias("b"))
    w = both.select("a", "b", word_count("a").alias("wa"), word_count("b").alias("wb"))
    flag = lambda c: F.sum(c.cast("long"))
    return w.agg(
        F.count(F.lit(1)).alias("n_rows"),
        flag(F.col("a") != F.col("b")).alias("n_changed"),
        F.avg("wa").alias("mean_words_v1"),
        F.avg("wb").alias("mean_words_v3"),
        flag(strip("b") == "").alias("n_empty"),
        flag((F.col("wa") >= 30) & (F.col("wb") < 0.5 * F.col("wa"))).alias("n_lost_half"),
    )


def residual_audit(df: DataFrame, text: str = "text", markup: Markup = DEFAULT) -> DataFrame:
    """One row with the number of passages that still hold each kind of markup."""
    checks = {k: _c(text).rlike(v) for k, v in markup.residual_patterns().items()}
    checks["empty_text"] = strip(text) == ""
    return df.agg(*[F.sum(c.cast("long")).alias(k) for k, c in checks.items()])


def entity_audit(df: DataFrame, columns=ENTITY_COLUMNS) -> DataFrame:
    """Links, pipes and invisible characters per entity column, in one pass."""
    tests = {
        "links": lambda c: c.rlike(r"\[\[|\]\]"),
        "pipes": lambda c: c.contains("|"),
        "invisible": lambda c: c.rlike(f"[{ENTITY_AUDIT_CHARS}]"),
    }
    present = [c for c in columns if c in df.columns]
    aggs = [
        F.sum(test(F.col(c)).cast("long")).alias(f"{c}__{name}")
        for c in present
        for name, test in tests.items()
    ]
    cells = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{t}").alias(t) for t in tests])
        for c in present
    ]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def passage_lines(df: DataFrame, key: str, text: str = "text", markup: Markup = DEFAULT) -> DataFrame:
    """Line table (key, pos, line, kind) of the media step, before captions are dropped."""
    lines = text_lines(cut_footer(drop_invisible(text), markup))
    exploded = df.select(key, F.posexplode(lines).alias("pos", "line"))
    return exploded.withColumn("kind", F.substring(tag_line(F.col("line"), markup), 1, 1))


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_sql(spark: SparkSession, markup: Markup = DEFAULT) -> None:
    """Create temporary SQL functions clean_v1/v2, clean_entity and word_count.

    They are SQL expressions, so Catalyst inlines them; nothing leaves the JVM.
    """
    p, q = markup.patterns(), sql_string

    def body_lines(expr: str) -> str:
        parts = f"split({expr}, {q(p['breaks'])})"
        trimmed = f"transform({parts}, x -> btrim(x, {q(WS_CHARS)}))"
        return f"array_join(filter({trimmed}, x -> x <> ''), {q(chr(10))})"

    def links(expr: str) -> str:
        for _ in range(3):
            expr = f"regexp_replace({expr}, {q(p['link_piped'])}, '$1')"
            expr = f"regexp_replace({expr}, {q(p['link_plain'])}, '$1')"
        return f"regexp_replace({expr}, {q(p['link_left'])}, '')"

    invisible = f"translate(coalesce(v, ''), {q(NBSP_CHARS + INVISIBLE_CHARS)}, '   ')"
    entity = f"translate(regexp_replace({links(invisible)}, {q(p['html'])}, ''), '|', ' ')"
    entity = f"btrim(regexp_replace({entity}, {q(p['spaces'])}, ' '), {q(WS_CHARS)})"
    media = (
        f"(x rlike {q(p['placement'])} or (contains(x, '|') and x rlike {q(p['media'])}))"
    )
    rest = (
        f"regexp_replace(btrim(substring_index(x, '|', -1), {q(WS_CHARS)}),"
        f" {q(p['leading_size'])}, '')"
    )
    words = lambda e: f"regexp_count({e}, {q(p['word'])})"
    caption = (
        f"(right(x, 1) not in ('.', '!', '?', '\"', ':')"
        f" and not x rlike {q(p['long_line'])} and not x rlike {q(p['section'])})"
    )
    tag = (
        f"case when {media} then case when {rest} rlike {q(p['long_rest'])}"
        f" then concat('K', {rest}) else 'M' end"
        f" when {caption} then concat('C', x) else concat('O', x) end"
    )
    cut = f"split({invisible}, {q(p['cut_v3'])}, 2)[0]"
    lines = (
        f"filter(transform(split({cut}, {q(p['breaks'])}), x -> btrim(x, {q(WS_CHARS)})),"
        " x -> x <> '')"
    )
    joined = f"concat({q(chr(10))}, array_join(transform({lines}, x -> {tag}), {q(chr(10))}))"
    first_other = q("(?s)\n[^C].*")
    kept = (
        f"array_join(transform(split({joined}, {q(chr(10) + 'M')}), (x, i) -> case when i = 0"
        f" then x else regexp_extract(x, {first_other}, 0) end), '')"
    )
    v3 = f"substring(regexp_replace({kept}, {q(chr(10) + '[COK]')}, {q(chr(10))}), 2)"
    v3 = f"translate({links(f'''regexp_replace({v3}, {q(p['html'])}, '')''')}, '|', ' ')"
    for rule, to in (("header", "$1"), ("bullet", ""), ("leading_size", ""), ("spaces", " ")):
        v3 = f"regexp_replace({v3}, {q(p[rule])}, '{to}')"
    functions = {
        "clean_v1": body_lines(f"split(coalesce(v, ''), {q(p['cut_v1'])}, 2)[0]"),
        "clean_v2": body_lines(f"split(coalesce(v, ''), {q(p['cut_v2'])}, 2)[0]"),
        "clean_v3": body_lines(v3),
        "clean_entity": entity,
        "word_count": words("v"),
    }
    for name, body in functions.items():
        kind = "INT" if name == "word_count" else "STRING"
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {kind} RETURN {body}"
        )
