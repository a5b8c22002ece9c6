"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the (source, language, topic) cells are raked: each margin in turn is
scaled to its target until all agree. A document is then drawn with a probability in
proportion to its cell's calibration factor, so expected tokens meet every margin.

Scale: the texts are only read to count words; what is shuffled is one row per cell and
task. Margin sums are pre-aggregated, so a source with a third of all rows is a few rows.
Fitted cells join the documents by broadcast when their counted number allows, otherwise
by a shuffle of narrow rows. Everything is DataFrame expressions.

Defined cases: null source, language or topic is the category ``(none)``; null text has no
word; a category without target, or a target without rows, is left out of the margin
(weight 0) and the other targets are rescaled; documents without words are drawn like their
cell; an empty table gives an empty result; margins that no weights can meet stop after
``MAX_SWEEPS`` at the last fit. Repeated rows (same id and text) are drawn together.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 1.0}  # target share is the observed one to this power
MAX_SWEEPS = 48
SWEEPS_PER_JOB = 8
TOLERANCE = 1e-9  # largest relative error of a margin
BROADCAST_CELLS = 100_000
NONE = "(none)"
WORD = "[^\\x20\\x09-\\x0D]+"


def content_form(text: Column) -> Column:
    """Topic of a text without topic labels: the form of its content."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("!!")), "shout")
        .when(F.contains(t, F.lit("Licensed under")), "licence")
        .when(t.rlike("[0-9]{3}"), "data")
        .otherwise("prose")
    )


def uniform(seed: int) -> Column:
    """Draw in [0, 1) from the seed, the id and the text's checksum."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(text))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)


def described(docs: DataFrame, topic: Column | None = None, seed: int = 0) -> DataFrame:
    """doc_id, the three categories, n_tokens and u, narrow."""
    text = F.col("text").cast("string")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return docs.select(
        "doc_id",
        name(F.col("source")).alias("source"),
        name(F.col("lang")).alias("lang"),
        name(content_form(text) if topic is None else topic).alias("topic"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
        uniform(seed).alias("u"),
    )


def flattened_targets(cells: DataFrame, powers: Mapping[str, float]) -> dict[str, DataFrame]:
    """Per dimension (value, share): the observed token share to a power, rescaled."""
    out = {}
    for d in DIMENSIONS:
        seen = cells.groupBy(d).agg(F.sum("tokens").alias("t")).filter("t > 0")
        raised = seen.select(d, F.pow(F.col("t").cast("double"), F.lit(float(powers[d]))).alias("share"))
        out[d] = raised
    return out


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_CELLS else df


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """Adds ``w``, the fitted tokens of each cell (source, lang, topic, tokens).

    Targets hold (value, share) and need not sum to one.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {}
    for d in DIMENSIONS:
        present = targets[d].join(cells.filter("tokens > 0").select(d).distinct(), d, "left_semi").filter("share > 0")
        scale = present.agg(F.sum("share")).first()[0] or 1.0
        goal = present.select(d, (F.col("share") * (total / scale)).alias(f"goal_{d}"))
        wanted[d] = _small(cut_lineage(goal))
    fit = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMENSIONS:  # categories without a target
        fit = fit.join(wanted[d], d, "left").withColumn("w", F.when(F.col(f"goal_{d}").isNotNull(), F.col("w")).otherwise(0.0))
    goals = {d: f"goal_{d}" for d in DIMENSIONS}
    fit = cut_lineage(fit)
    sweep, per_job = (_sweep_in_one, SWEEPS_PER_JOB) if fit.count() <= BROADCAST_CELLS else (_sweep_by_joins, 1)
    for _ in range(-(-max_sweeps // per_job)):
        for _ in range(per_job):
            fit = sweep(fit, goals)
        fit = cut_lineage(fit)
        if (fit.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return fit.drop("off", *goals.values())


def _scaled(fit: DataFrame, goal: str, have: Column) -> DataFrame:
    ratio = F.when(have > 0, F.col(goal) / have).otherwise(1.0)
    return fit.withColumn("ratio", F.coalesce(ratio, F.lit(1.0))).withColumns(
        {"w": F.col("w") * F.col("ratio"), "off": F.greatest("off", F.abs(F.col("ratio") - 1))}
    ).drop("ratio")


def _sweep_in_one(fit: DataFrame, goals: Mapping[str, str]) -> DataFrame:
    """One sweep over at most BROADCAST_CELLS cells: windows in one task, no shuffle between them."""
    fit = fit.coalesce(1).withColumn("off", F.lit(0.0))
    for d, goal in goals.items():
        fit = _scaled(fit.withColumn("have", F.sum("w").over(Window.partitionBy(d))), goal, F.col("have")).drop("have")
    return fit


def _sweep_by_joins(fit: DataFrame, goals: Mapping[str, str]) -> DataFrame:
    """One sweep over any number of cells: pre-aggregated margin sums joined back."""
    fit = fit.withColumn("off", F.lit(0.0))
    for d, goal in goals.items():
        sums = fit.groupBy(d).agg(F.sum("w").alias("have"))
        fit = cut_lineage(_scaled(fit.join(sums, d, "left"), goal, F.col("have")).drop("have"))
    return fit


def calibrated(rows: DataFrame, powers: Mapping[str, float] = FLATTEN, targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Per cell: weight (fitted over observed tokens) and drawing probability.

    The largest weight is drawn with probability 1, so no probability is cut off and
    expected tokens keep the fitted proportions. Cells without tokens take the smallest
    weight above 0.
    """
    cells = cut_lineage(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    fit = rake(cells, targets or flattened_targets(cells, powers))
    weight = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
    weighed = cut_lineage(fit.select(*DIMENSIONS, weight.alias("weight")))
    ends = weighed.filter("weight > 0").agg(F.max("weight").alias("hi"), F.min("weight").alias("lo")).first()
    hi, lo = (ends["hi"], ends["lo"]) if ends["hi"] else (1.0, 1.0)
    weight = F.coalesce("weight", F.lit(lo))
    return _small(weighed.select(*DIMENSIONS, weight.alias("weight"), (weight / hi).alias("probability")))


def draw(docs: DataFrame, topic: Column | None = None, powers: Mapping[str, float] = FLATTEN, seed: int = 0) -> DataFrame:
    """doc_id, categories, n_tokens, weight, probability and selected, per document."""
    rows = described(docs, topic, seed)
    cells = calibrated(rows, powers)
    return rows.join(cells, list(DIMENSIONS), "left").select(
        "doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", (F.col("u") < F.col("probability")).alias("selected")
    )


def sample(docs: DataFrame, topic: Column | None = None, powers: Mapping[str, float] = FLATTEN, seed: int = 0) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns."""
    cells = calibrated(described(docs, topic, seed), powers)
    text = F.col("text").cast("string")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    keys = {
        "__source": name(F.col("source")),
        "__lang": name(F.col("lang")),
        "__topic": name(content_form(text) if topic is None else topic),
        "__u": uniform(seed),
    }
    renamed = cells.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("probability").alias("__p"))
    marked = docs.withColumns(keys).join(renamed, [f"__{d}" for d in DIMENSIONS], "left")
    return marked.filter("__u < __p").select(*docs.columns)
