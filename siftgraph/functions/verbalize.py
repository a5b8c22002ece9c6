"""Triples to hypotheses and prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import WS, sql_string

TEMPLATE_COLUMNS = ("predicate", "head", "middle", "tail", "subject_first")


def literal_table(spark: SparkSession, rows: list[tuple], columns) -> DataFrame:
    """Small constant table as SQL VALUES: a local relation with exact statistics."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        return sql_string(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def fill(template: str, values: dict[str, Column]) -> Column:
    """Column form of ``template`` with ``{name}`` holes; values are never re-scanned."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cols)


def basic_relation(subject="subject", predicate="predicate", obj="object") -> Column:
    return F.concat_ws(" ", F.col(subject), F.col(predicate), F.col(obj))


def template_table(spark: SparkSession, templates: dict[str, str] = V.PREDICATE_TEMPLATES):
    """Templates as rows, split at their two holes."""
    rows = []
    for predicate, text in templates.items():
        head, first, middle, second, tail = re.split(r"\{(\w+)\}", text)
        if {first, second} != {"subject", "object"}:
            raise ValueError(f"template of {predicate!r} needs both holes once")
        rows.append((predicate, head, middle, tail, first == "subject"))
    return literal_table(spark, rows, TEMPLATE_COLUMNS)


def template_relation(
    df: DataFrame, templates: DataFrame | None = None, out: str = "template_relation"
) -> DataFrame:
    """Hypothesis from the predicate's template, else ``subject predicate object``.

    The default table is a literal of fixed size and is broadcast; a user's own table is
    joined without a hint, so Spark checks its size.
    """
    table = F.broadcast(template_table(df.sparkSession)) if templates is None else templates
    t = table.select([F.col(c).alias(f"__{c}") for c in table.columns])
    first = F.when(F.col("__subject_first"), F.col("subject")).otherwise(F.col("object"))
    second = F.when(F.col("__subject_first"), F.col("object")).otherwise(F.col("subject"))
    text = F.concat("__head", first, "__middle", second, "__tail")
    return (
        df.join(t, F.col("predicate") == F.col("__predicate"), "left")
        .withColumn(out, F.coalesce(text, basic_relation()))
        .drop(*t.columns)
    )


def unseen_predicates(df: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    table = F.broadcast(template_table(df.sparkSession)) if templates is None else templates
    return df.select("predicate").distinct().join(table.select("predicate"), "predicate", "left_anti")


def display_names(
    df: DataFrame, names: DataFrame | None = None, column: str = "predicate", out: str = "predicate_name"
) -> DataFrame:
    """Map names through a (name, display) table, keeping the name where none is listed."""
    if names is None:
        rows = list(V.PREDICATE_NAMES_EN.items())
        names = F.broadcast(literal_table(df.sparkSession, rows, ("name", "display")))
    n = names.select(F.col("name").alias("__n"), F.col("display").alias("__d"))
    joined = df.join(n, F.col(column) == F.col("__n"), "left")
    return joined.withColumn(out, F.coalesce("__d", column)).drop("__n", "__d")


def first_sentence(col) -> Column:
    """Text up to the first white space after ``.``, ``!`` or ``?``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split(c, f"(?<=[.!?])[{WS}]", 2).getItem(0)


def shot_pool(spark: SparkSession) -> DataFrame:
    """Few-shot examples as rows (idx, lang, relation_form, ...)."""
    fields = ("text", "subject", "predicate", "object", "statement", "answer", "reasoning")
    rows = [
        (i, lang, form, *[entry.get(f) for f in fields])
        for i, variants in enumerate(V.SHOT_POOL)
        for (lang, form), entry in variants.items()
    ]
    return literal_table(spark, rows, ("idx", "lang", "relation_form", *fields))


def select_shots(pool: DataFrame, n_shot: int, lang: str, form: str) -> DataFrame:
    """Pool rows a shot count uses: none, entries 0 and 3, or all five."""
    return pool.filter(
        (F.col("lang") == lang)
        & (F.col("relation_form") == form)
        & F.col("idx").isin(*V.SHOT_INDICES[n_shot])
        if V.SHOT_INDICES[n_shot]
        else F.lit(False)
    )


def _shots(n_shot: int, lang: str, form: str) -> list[dict]:
    return [V.SHOT_POOL[i][(lang, form)] for i in V.SHOT_INDICES[n_shot]]


def _row_values(statement: str) -> dict[str, Column]:
    names = ("text", "subject", "predicate", "object")
    return {**{n: F.col(n) for n in names}, "statement": F.col(statement)}


def _literals(example: dict) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in example.items()}


def chat_messages(
    lang: str, form: str, n_shot: int = 0, reasoning: bool = False, statement: str = "template_relation"
) -> Column:
    """array<struct<role, content>>: system text, example turns, then the row's question."""
    ending = V.ANSWER_INSTRUCTION[(lang, reasoning)]
    question = V.USER_TEXT[(lang, form)] + ending
    system = V.SYSTEM_TEXT[(lang, form)]
    system += V.REASONING_SUFFIX[lang] if reasoning else V.ONE_WORD[lang]
    turns: list[tuple[str, Column]] = [("system", F.lit(system))]
    for ex in _shots(n_shot, lang, form):
        reply = ex["reasoning"] + "\n" + ex["answer"] if reasoning else ex["answer"]
        turns += [("user", fill(question, _literals(ex))), ("assistant", F.lit(reply))]
    turns.append(("user", fill(question, _row_values(statement))))
    return F.array(
        *[F.struct(F.lit(role).alias("role"), body.alias("content")) for role, body in turns]
    )


def completion_prompt(
    lang: str, form: str, n_shot: int = 0, statement: str = "template_relation"
) -> Column:
    """Introduction, answered examples and the open query, separated by blank lines."""
    block = V.COMPLETION_BLOCK[(lang, form)]
    parts = [F.lit(V.COMPLETION_INTRO[(lang, form)])]
    for ex in _shots(n_shot, lang, form):
        parts.append(fill(block + " {answer}", _literals(ex)))
    parts.append(fill(block, _row_values(statement)))
    return F.concat_ws("\n\n", *parts)


def nli_input(text: str = "text", statement: str = "template_relation") -> Column:
    return fill(V.NLI_INPUT, {"text": F.col(text), "statement": F.col(statement)})


def nli_prompt(text="text", statement="template_relation", prefix: str = "", suffix: str = "") -> Column:
    """Wrapped NLI input; without a suffix the prompt ends with a newline."""
    return F.concat(F.lit(prefix), nli_input(text, statement), F.lit(suffix or "\n"))


def typed_pair(subject="subject", obj="object") -> Column:
    return F.concat_ws(" | ", F.col(subject), F.col(obj))


def separated_input(subject="subject", obj="object", text="text") -> Column:
    return F.concat_ws(" [SEP] ", F.col(subject), F.col(obj), F.col(text))


def config_grid(df: DataFrame, axes: dict[str, list]) -> DataFrame:
    """One row per input row and configuration; the grid is a literal array, so no join."""
    rows: list[dict] = [{}]
    for name, values in axes.items():
        rows = [{**r, name: v} for r in rows for v in values]
    cells = [F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows]
    return df.select("*", F.inline(F.array(*cells)))
