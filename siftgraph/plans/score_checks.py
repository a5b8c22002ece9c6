"""Registered queries: hypotheses, prompts, answer parsing, score functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import fixed_values as V
from ..functions import scores as S
from ..functions import verbalize as B
from ..functions.text import LINE_BREAKS, WS, WS_CHARS
from .fixtures import Tables
from .registry import check
from .text_checks import q

TEMPLATES_SQL = ", ".join(f"({q(p)}, {q(t)})" for p, t in V.PREDICATE_TEMPLATES.items())
NAMES_SQL = ", ".join(f"({q(p)}, {q(t)})" for p, t in V.PREDICATE_NAMES_EN.items())


@check(
    "c01_basic_relation",
    "row_id:s relation:s",
    "SELECT row_id, subject || ' ' || predicate || ' ' || object AS relation FROM candidates",
)
def _(t: Tables):
    return t.candidates.select("row_id", B.basic_relation().alias("relation"))


@check(
    "c02_template_relation",
    "row_id:s template_relation:s",
    f"""SELECT row_id, coalesce(replace(replace(tpl, '{{subject}}', subject), '{{object}}', object),
               subject || ' ' || predicate || ' ' || object) AS template_relation
        FROM named LEFT JOIN (VALUES {TEMPLATES_SQL}) x(p, tpl) ON predicate = p""",
)
def _(t: Tables):
    return B.template_relation(t.named)


@check(
    "c03_unseen_predicates",
    "predicate:s",
    f"SELECT DISTINCT predicate FROM named WHERE predicate NOT IN (SELECT p FROM (VALUES {TEMPLATES_SQL}) x(p, tpl))",
)
def _(t: Tables):
    return B.unseen_predicates(t.named)


@check(
    "c04_first_sentence",
    "doc_id:i sentence:s",
    f"""SELECT doc_id, CASE WHEN regexp_matches(text, {q(f'[.!?][{WS}]')})
               THEN regexp_extract(text, {q(f'(?s)^(.*?[.!?])[{WS}]')}, 1) ELSE text END AS sentence
        FROM {{documents}}""",
)
def _(t: Tables):
    return t.documents.select("doc_id", B.first_sentence("text").alias("sentence"))


@check(
    "c05_display_names",
    "predicate_name:s n:i",
    f"""SELECT coalesce(d, predicate) AS predicate_name, count(*) AS n
        FROM named LEFT JOIN (VALUES {NAMES_SQL}) x(p, d) ON predicate = p GROUP BY 1""",
)
def _(t: Tables):
    named = B.display_names(t.named)
    return named.groupBy("predicate_name").agg(F.count(F.lit(1)).alias("n"))


@check(
    "c06_select_shots",
    "n_shot:i conv_id:i idx:i",
    """SELECT 2 AS n_shot, conv_id, turn AS idx FROM {conversations} WHERE turn IN (0, 3)
       UNION ALL SELECT 5, conv_id, turn FROM {conversations} WHERE turn IN (0, 1, 2, 3, 4)""",
)
def _(t: Tables):
    pool = t.conversations.select(
        "conv_id",
        F.col("turn").cast("int").alias("idx"),
        F.lit("en").alias("lang"),
        F.lit("triplet").alias("relation_form"),
    )
    out = None
    for n in V.SHOT_INDICES:
        part = B.select_shots(pool, n, "en", "triplet").withColumn("n_shot", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def sql_fill(template: str, values: dict[str, str]) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(values[p] if i % 2 else q(p) for i, p in enumerate(parts) if i % 2 or p)


ROW = {k: k for k in ("text", "subject", "predicate", "object")} | {"statement": "template_relation"}


def sql_chat(lang: str, form: str, n: int, reasoning: bool) -> str:
    ask = V.USER_TEXT[(lang, form)] + V.ANSWER_INSTRUCTION[(lang, reasoning)]
    end = V.REASONING_SUFFIX[lang] if reasoning else V.ONE_WORD[lang]
    turns = [q("system:" + V.SYSTEM_TEXT[(lang, form)] + end)]
    for i in V.SHOT_INDICES[n]:
        ex = V.SHOT_POOL[i][(lang, form)]
        reply = f"{ex['reasoning']}\n{ex['answer']}" if reasoning else ex["answer"]
        turns += [q("user:" + ask.format(**ex)), q("assistant:" + reply)]
    turns.append(q("user:") + " || " + sql_fill(ask, ROW))
    return f" || {q('|')} || ".join(turns)


CHAT_KINDS = (("en", "triplet", 2, False), ("he", "template", 5, True))


@check(
    "c07_chat_messages",
    "doc_id:i " + " ".join(f"m{i}:s" for i in range(len(CHAT_KINDS))),
    "SELECT doc_id, " + ", ".join(f"{sql_chat(*k)} AS m{i}" for i, k in enumerate(CHAT_KINDS)) + " FROM questions",
)
def _(t: Tables):
    def flat(kind):
        turns = F.transform(B.chat_messages(*kind), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
        return F.array_join(turns, "|")

    return t.questions.select("doc_id", *[flat(k).alias(f"m{i}") for i, k in enumerate(CHAT_KINDS)])


def sql_completion(lang: str, form: str, n: int) -> str:
    block = V.COMPLETION_BLOCK[(lang, form)]
    shots = [V.SHOT_POOL[i][(lang, form)] for i in V.SHOT_INDICES[n]]
    head = "\n\n".join([V.COMPLETION_INTRO[(lang, form)], *[(block + " {answer}").format(**e) for e in shots]])
    return q(head + "\n\n") + " || " + sql_fill(block, ROW)


COMPLETION_KINDS = (("en", "template", 5), ("he", "triplet", 0))


@check(
    "c08_completion_prompt",
    "doc_id:i p0:s p1:s",
    "SELECT doc_id, " + ", ".join(f"{sql_completion(*k)} AS p{i}" for i, k in enumerate(COMPLETION_KINDS)) + " FROM questions",
)
def _(t: Tables):
    cols = [B.completion_prompt(*k).alias(f"p{i}") for i, k in enumerate(COMPLETION_KINDS)]
    return t.questions.select("doc_id", *cols)


@check(
    "c09_nli_prompt",
    "doc_id:i plain:s wrapped:s",
    f"""SELECT doc_id, {sql_fill(V.NLI_INPUT, ROW)} || chr(10) AS plain,
               '### ' || {sql_fill(V.NLI_INPUT, ROW)} || ' ### Answer:' AS wrapped FROM questions""",
)
def _(t: Tables):
    return t.questions.select(
        "doc_id", B.nli_prompt().alias("plain"), B.nli_prompt(prefix="### ", suffix=" ### Answer:").alias("wrapped")
    )


@check(
    "c10_pair_inputs",
    "doc_id:i pair:s separated:s",
    """SELECT doc_id, subject || ' | ' || object AS pair,
              subject || ' [SEP] ' || object || ' [SEP] ' || text AS separated FROM questions""",
)
def _(t: Tables):
    return t.questions.select("doc_id", B.typed_pair().alias("pair"), B.separated_input().alias("separated"))


@check(
    "c11_config_grid",
    "config:s n:i n_yes:i n_unknown:i",
    """SELECT config, count(*) AS n, count(*) FILTER (WHERE pred = '1') AS n_yes,
              count(*) FILTER (WHERE pred = 'unknown') AS n_unknown FROM runs GROUP BY config""",
)
def _(t: Tables):
    return t.runs.groupBy("config").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pred") == "1").alias("n_yes"),
        F.count_if(F.col("pred") == "unknown").alias("n_unknown"),
    )


def think_free(expr: str, flags: str = "(?s)") -> str:
    return f"trim(regexp_replace({expr}, '{flags}<think>.*?</think>', '', 'g'), {q(WS_CHARS)})"


TOKENS = q(f"[^{WS}.,!?:;()\\[\\]\"']+")
YES = r"(regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])yes($|[^\p{{L}}\p{{N}}_])') OR contains({0}, 'כן'))"
NO = r"(regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])no($|[^\p{{L}}\p{{N}}_])') OR contains({0}, 'לא'))"

DIRECT_SQL = f"""
WITH c AS (SELECT conv_id, turn, lower({think_free('raw')}) AS t FROM answers),
f AS (SELECT *, regexp_extract(t, {TOKENS}) AS tok FROM c)
SELECT conv_id, turn, CASE WHEN tok IN ('yes', 'כן') THEN '1' WHEN tok IN ('no', 'לא') THEN '0'
       WHEN {YES.format('t')} THEN '1' WHEN {NO.format('t')} THEN '0' ELSE 'unknown' END AS label FROM f"""


@check("c12_parse_yes_no", "conv_id:i turn:i label:s", DIRECT_SQL)
def _(t: Tables):
    return t.answers.select("conv_id", "turn", A.parse_yes_no("raw").alias("label"))


REASONING_SQL = f"""
WITH c AS (SELECT conv_id, turn, lower({think_free('raw')}) AS t FROM answers),
l AS (SELECT conv_id, turn, unnest(string_split_regex(t, {q('[' + LINE_BREAKS + ']')})) AS line,
             unnest(range(len(string_split_regex(t, {q('[' + LINE_BREAKS + ']')})))) AS pos FROM c),
s AS (SELECT conv_id, turn, line, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos DESC) AS up
      FROM l WHERE trim(line, {q(WS_CHARS)}) <> ''),
tok AS (SELECT conv_id, turn, up, list_filter(regexp_extract_all(line, {TOKENS}),
                                              lambda x: x IN ('yes', 'no', 'כן', 'לא'))[1] AS hit FROM s WHERE up <= 3),
near AS (SELECT conv_id, turn, arg_min(hit, up) AS hit FROM tok WHERE hit IS NOT NULL GROUP BY conv_id, turn),
far AS (SELECT conv_id, turn, arg_min(CASE WHEN {YES.format('line')} THEN '1' ELSE '0' END, up) AS lab FROM s
        WHERE {YES.format('line')} OR {NO.format('line')} GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, coalesce(CASE WHEN near.hit IN ('yes', 'כן') THEN '1' WHEN near.hit IS NOT NULL THEN '0' END,
       far.lab, 'unknown') AS label
FROM c LEFT JOIN near ON c.conv_id = near.conv_id AND c.turn = near.turn
       LEFT JOIN far ON c.conv_id = far.conv_id AND c.turn = far.turn"""


@check("c13_parse_reasoning", "conv_id:i turn:i label:s", REASONING_SQL)
def _(t: Tables):
    return t.answers.select("conv_id", "turn", A.parse_yes_no("raw", reasoning=True).alias("label"))


E, C, N = V.NLI_LABELS
SE, SC, SN = V.NLI_STEMS


@check(
    "c14_parse_nli",
    "conv_id:i turn:i label:s loose:s",
    f"""WITH c AS (SELECT conv_id, turn, {think_free('nli')} AS t FROM answers),
        s AS (SELECT *, CASE WHEN contains(t, '{E}') THEN '1' WHEN contains(t, '{C}') OR contains(t, '{N}') THEN '0'
                   WHEN contains(t, '{SE}') THEN '1' WHEN contains(t, '{SC}') OR contains(t, '{SN}') THEN '0' END AS v FROM c)
        SELECT conv_id, turn, coalesce(v, 'unknown') AS label,
               coalesce(v, CASE WHEN starts_with(t, 'כן') THEN '1' WHEN starts_with(t, 'לא') THEN '0' END, 'unknown') AS loose
        FROM s""",
)
def _(t: Tables):
    return t.answers.select(
        "conv_id", "turn", A.parse_nli("nli").alias("label"), A.parse_nli("nli", parse_yesno=True).alias("loose")
    )


def last_pos(word: str) -> str:
    # start of the last occurrence: length of the text before it
    return f"CASE WHEN contains(t, '{word}') THEN length(regexp_extract(t, '(?s)^(.*){word}', 1)) ELSE -1 END"


@check(
    "c15_parse_nli_last",
    "conv_id:i turn:i label:s",
    f"""WITH c AS (SELECT conv_id, turn, {think_free('nli')} AS t FROM answers),
        p AS (SELECT *, {last_pos(E)} AS e, greatest({last_pos(C)}, {last_pos(N)}) AS o FROM c)
        SELECT conv_id, turn, CASE WHEN e >= 0 AND e > o THEN '1' WHEN o >= 0 THEN '0' ELSE 'unknown' END AS label FROM p""",
)
def _(t: Tables):
    return t.answers.select("conv_id", "turn", A.parse_nli("nli", parse_last=True).alias("label"))


NORMAL_SQL = f"""CASE WHEN t IN ('{E}', '{C}', '{N}') THEN t WHEN contains(t, '{E}') THEN '{E}'
    WHEN contains(t, '{C}') THEN '{C}' WHEN contains(t, '{N}') THEN '{N}' ELSE t END"""


@check(
    "c16_normalise_prediction",
    "conv_id:i turn:i label:s",
    f"""WITH c AS (SELECT conv_id, turn, {think_free('nli', '(?si)')} AS t FROM answers)
        SELECT conv_id, turn, {NORMAL_SQL} AS label FROM c""",
)
def _(t: Tables):
    return t.answers.select("conv_id", "turn", A.normalise_prediction("nli").alias("label"))


@check(
    "c17_derived_scores",
    "row_id:s model:s pe:d emc:d enn:d",
    "SELECT row_id, model, pe, pe - pc AS emc, pe / greatest(pe + pc, 1e-8) AS enn FROM probs",
)
def _(t: Tables):
    cols = [S.derive_score("pe", "pc", f).alias(f) for f in S.FORMULAS]
    return t.probs.select("row_id", "model", *cols)


def logprob_map(t: Tables):
    """First-token maps: token ids with the log of the three scores; zero scores are absent."""
    entry = lambda k, c: F.when(F.col(c) > 0, F.struct(F.lit(k).alias("k"), F.log(c).alias("v")))
    cells = F.filter(
        F.array(entry("y1", "a_score"), entry("n1", "b_score"), entry("y2", "c_score")),
        lambda s: s.isNotNull(),
    )
    return t.candidates.select("row_id", F.map_from_entries(cells).alias("lp"))


@check(
    "c18_soft_yes_no",
    "row_id:s score:d empty:d",
    """SELECT row_id, CASE WHEN a_score + b_score + c_score > 1e-10
              THEN (a_score + c_score) / (a_score + b_score + c_score) ELSE 0.5 END AS score,
              CASE WHEN b_score > 1e-10 THEN 0.0 ELSE 0.5 END AS empty FROM candidates""",
)
def _(t: Tables):
    return logprob_map(t).select(
        "row_id",
        A.soft_yes_no("lp", ["y1", "y2"], ["n1"]).alias("score"),
        A.soft_yes_no("lp", ["zz"], ["n1"]).alias("empty"),
    )


@check(
    "c19_soft_entailment",
    "row_id:s score:d ambiguous:d",
    """SELECT row_id, a_score / (a_score + b_score + c_score + 1e-10) AS score,
              a_score / (a_score + 1e-10) AS ambiguous FROM candidates""",
)
def _(t: Tables):
    return logprob_map(t).select(
        "row_id",
        A.soft_entailment("lp", ["y1"], ["n1"], ["y2"]).alias("score"),
        A.soft_entailment("lp", ["y1"], ["n1", "y2"], ["y2", "n1"]).alias("ambiguous"),
    )


@check(
    "c20_threshold_predictions",
    "row_id:s inclusive:i strict:i",
    """SELECT row_id, CASE WHEN a_score >= 0.3 THEN 1 ELSE 0 END AS inclusive,
              CASE WHEN a_score > 0.3 THEN 1 ELSE 0 END AS strict FROM candidates""",
)
def _(t: Tables):
    return t.candidates.select(
        "row_id",
        S.threshold_pred("a_score", 0.3).alias("inclusive"),
        S.threshold_pred("a_score", 0.3, strict=True).alias("strict"),
    )


@check(
    "c21_numeric_coercion",
    "row_id:s flag:i",
    """SELECT row_id, CASE WHEN linenumber IN (1, 2) THEN 0 WHEN linenumber = 3 AND label = 1 THEN 1
              WHEN linenumber = 3 THEN 0 WHEN b_score > 0.5 THEN 1 ELSE 0 END AS flag FROM candidates""",
)
def _(t: Tables):
    raw = (
        F.when(F.col("linenumber") == 1, F.lit("n/a"))
        .when(F.col("linenumber") == 2, F.lit(None))
        .when(F.col("linenumber") == 3, F.col("label").cast("string"))
        .otherwise(F.col("b_score").cast("string"))
    )
    return t.candidates.select("row_id", raw.alias("raw")).select("row_id", S.coerce_flag("raw").alias("flag"))


@check(
    "c26_token_cost",
    "event_id:i cost:d",
    """SELECT event_id, (length(props) * 0.518 + length(event_type) * 10.0) / 1000000 * 1000 AS cost FROM {events}""",
)
def _(t: Tables):
    price_in, price_out = V.TOKEN_PRICES[0]
    cost = S.token_cost(F.length("props"), F.length("event_type"), F.lit(price_in), F.lit(price_out))
    return t.events.select("event_id", (cost * 1000).alias("cost"))


@check(
    "c28_filters",
    "row_id:s",
    """SELECT row_id FROM signals WHERE gamma__pred IS NOT NULL AND label = 1
       AND subset IN ('new_predicate', 'depth_boost') AND linenumber >= 2 AND linenumber < 5""",
)
def _(t: Tables):
    return t.signals.filter(
        S.labelled("gamma__pred")
        & (F.col("label") == 1)
        & F.col("subset").isin("new_predicate", "depth_boost")
        & S.in_range("linenumber", 2, 5)
    ).select("row_id")


@check(
    "c29_label_ids",
    "conv_id:i turn:i label_id:i",
    f"""WITH c AS (SELECT conv_id, turn, {think_free('nli', '(?si)')} AS t FROM answers),
        n AS (SELECT conv_id, turn, {NORMAL_SQL} AS label FROM c)
        SELECT conv_id, turn, CASE label WHEN '{E}' THEN 0 WHEN '{C}' THEN 1 ELSE 2 END AS label_id
        FROM n WHERE label IN ('{E}', '{C}', '{N}')""",
)
def _(t: Tables):
    d = t.answers.select("conv_id", "turn", A.label_id(A.normalise_prediction("nli")).alias("label_id"))
    return d.filter("label_id >= 0")


