"""Percentile bootstrap of F1.

F1 depends only on the confusion cells, so a replicate of n rows drawn with replacement
is one multinomial draw over the cells: the cost per replicate does not depend on the
corpus. Replicates are rows; all draws are md5 numbers and expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import confusion_aggs, f1_of
from .ranking import first_per_key, null_safe_join

N_BOOT = 10_000
SEED = 42
LOW, HIGH = 0.025, 0.975


def _replicates(counts: DataFrame, n_boot: int) -> DataFrame:
    """One row per (group, replicate ``__b``), spread over tasks."""
    reps = counts.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    return reps.repartition("__b")


def _normal(seed: int, k: int) -> Column:
    """Standard normal number of (seed, replicate, k): Box-Muller on two halves of an md5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__b").cast("string"), F.lit(str(k))))
    part = lambda at: F.conv(F.substring(digest, at, 13), 16, 10).cast("double")
    radius = F.sqrt(-2 * F.log((part(1) + 1) / float(2**52)))
    return radius * F.cos(part(14) / float(2**52) * (2 * math.pi))


def multinomial(reps: DataFrame, cells: Sequence[str], seed: int, prefix: str = "b_") -> DataFrame:
    """Adds resampled counts of ``cells``: conditional binomials, each a rounded normal number.

    The cost does not depend on the counts. For a few dozen rows the normal form is coarse;
    :func:`bootstrap_f1_by_draw` draws every row.
    """
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cells])
    out = reps.withColumns({"__left": total.cast("double"), "__rest": total.cast("double")})
    for k, c in enumerate(cells[:-1]):
        share = F.when(F.col("__rest") > 0, F.col(c) / F.col("__rest")).otherwise(0.0)
        mean = F.col("__left") * share
        drawn = F.round(mean + _normal(seed, k) * F.sqrt(mean * F.greatest(1 - share, F.lit(0.0))))
        out = out.withColumn(f"{prefix}{c}", F.least(F.greatest(drawn, F.lit(0.0)), F.col("__left")))
        out = out.withColumns(
            {"__left": F.col("__left") - F.col(f"{prefix}{c}"), "__rest": F.col("__rest") - F.col(c)}
        )
    return out.withColumn(f"{prefix}{cells[-1]}", F.col("__left")).drop("__left", "__rest")


def bootstrap_f1(
    df: DataFrame,
    pred: Column,
    gold: Column,
    by: Sequence[str] = (),
    n_boot: int = N_BOOT,
    seed: int = SEED,
) -> DataFrame:
    """Point F1, 2.5 and 97.5 percentiles and half-width per group."""
    by = list(by)
    counts = df.groupBy(*by).agg(*confusion_aggs(pred, gold))
    reps = multinomial(_replicates(counts, n_boot), ["tp", "fp", "fn", "tn"], seed)
    draws = reps.select(*by, f1_of("b_tp", "b_fp", "b_fn").alias("__f1"))
    return _interval(counts.withColumn("f1", f1_of()), draws, by)


def _interval(points: DataFrame, draws: DataFrame, by: Sequence[str]) -> DataFrame:
    q = draws.groupBy(*by).agg(F.percentile("__f1", F.array(F.lit(LOW), F.lit(HIGH))).alias("__q"))
    return (
        null_safe_join(points, q, by)
        .withColumn("ci_lo", F.col("__q")[0])
        .withColumn("ci_hi", F.col("__q")[1])
        .withColumn("ci_halfwidth", (F.col("ci_hi") - F.col("ci_lo")) / 2)
        .drop("__q", "tp", "fp", "fn", "tn")
    )


def draw_index(seed: int, n: Column, b: str = "__b", j: str = "__j") -> Column:
    """Reproducible uniform draw in [0, n): md5 of seed, replicate and draw number."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(b).cast("string"), F.col(j).cast("string")))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return F.floor(share * n).cast("long")


def _draw_rows(counts: DataFrame, n: Column, n_boot: int) -> DataFrame:
    """Every (replicate, draw) of every group; replicates are spread over tasks first."""
    reps = counts.withColumn("__n", n).withColumn(
        "__b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))
    )
    reps = reps.repartition("__b").filter("__n > 0")
    return reps.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))


def bootstrap_f1_by_draw(
    df: DataFrame, pred: Column, gold: Column, by: Sequence[str] = (), n_boot: int = 200, seed: int = SEED
) -> DataFrame:
    """As :func:`bootstrap_f1` with one reproducible md5 draw per sampled row.

    Rows are ordered by cell, so a draw is placed by comparing it with cumulative cell
    counts and no row is looked up. Cost is replicates x rows: for evaluation sets.
    """
    by = list(by)
    counts = df.groupBy(*by).agg(*confusion_aggs(pred, gold))
    d = _draw_rows(counts, F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), n_boot)
    u = draw_index(seed, F.col("__n"))
    reps = (
        d.withColumn("__u", u)
        .groupBy(*by, "__b")
        .agg(
            F.count_if(F.col("__u") < F.col("tp")).alias("b_tp"),
            F.count_if(F.col("__u").between(F.col("tp"), F.col("tp") + F.col("fp") - 1)).alias("b_fp"),
            F.count_if(
                F.col("__u").between(
                    F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") - 1
                )
            ).alias("b_fn"),
        )
    )
    draws = reps.select(*by, f1_of("b_tp", "b_fp", "b_fn").alias("__f1"))
    return _interval(counts.withColumn("f1", f1_of()), draws, by)


PAIR_CELLS = tuple(f"c{g}{a}{b}" for g in (0, 1) for a in (0, 1) for b in (0, 1))


def pair_counts(df: DataFrame, gold: Column, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the eight (gold, first, second) cells."""
    code = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    cell = code(gold) * 4 + code(a) * 2 + code(b)
    return df.groupBy(*by).agg(
        *[F.count_if(cell == i).alias(name) for i, name in enumerate(PAIR_CELLS)]
    )


def _pair_difference() -> Column:
    c = lambda *names: sum((F.col(f"b_{n}") for n in names[1:]), F.col(f"b_{names[0]}"))
    f1_a = f1_of(c("c110", "c111"), c("c010", "c011"), c("c100", "c101"))
    f1_b = f1_of(c("c101", "c111"), c("c001", "c011"), c("c100", "c110"))
    return f1_a - f1_b


def paired_bootstrap(
    df: DataFrame, gold: Column, a: Column, b: Column, by: Sequence[str] = (), n_boot: int = N_BOOT, seed: int = SEED
) -> DataFrame:
    """F1(a) - F1(b) on the same resamples: mean, 2.5/97.5 percentiles, share above zero."""
    by = list(by)
    counts = pair_counts(df, gold, a, b, by)
    reps = multinomial(_replicates(counts, n_boot), PAIR_CELLS, seed)
    return summarise_differences(reps.select(*by, _pair_difference().alias("__d")), by)


def paired_bootstrap_by_draw(
    df: DataFrame, gold: Column, a: Column, b: Column, by=(), n_boot: int = 200, seed: int = SEED
) -> DataFrame:
    """Paired bootstrap with reproducible md5 draws (see :func:`bootstrap_f1_by_draw`)."""
    by = list(by)
    counts = pair_counts(df, gold, a, b, by)
    total = F.lit(0)
    upper = {}
    for name in PAIR_CELLS:
        total = total + F.col(name)
        upper[name] = total
    d = _draw_rows(counts, total, n_boot).withColumn("__u", draw_index(seed, F.col("__n")))
    inside = {
        name: (F.col("__u") < upper[name]) & (F.col("__u") >= upper[name] - F.col(name))
        for name in PAIR_CELLS
    }
    reps = d.groupBy(*by, "__b").agg(
        *[F.count_if(test).alias(f"b_{name}") for name, test in inside.items()]
    )
    return summarise_differences(reps.select(*by, _pair_difference().alias("__d")), by)


def summarise_differences(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    d = draws.groupBy(*by).agg(
        F.avg("__d").alias("mean_diff"),
        F.percentile("__d", F.array(F.lit(LOW), F.lit(HIGH))).alias("__q"),
        F.avg((F.col("__d") > 0).cast("double")).alias("p_a_better"),
    )
    return d.select(
        *by, "mean_diff", F.col("__q")[0].alias("lo95"), F.col("__q")[1].alias("hi95"), "p_a_better"
    )


def significant(lo="lo95", hi="hi95") -> Column:
    return (F.col(lo) > 0) | (F.col(hi) < 0)


def best_against_next(
    runs: DataFrame,
    metrics: DataFrame,
    row_id: str,
    config: str,
    pred: str = "pred",
    gold: str = "label",
    others: int = 5,
    by_draw: bool = False,
    n_boot: int = N_BOOT,
    seed: int = SEED,
) -> DataFrame:
    """Best configuration by F1 against each of the next ``others``, with a significance flag.

    The best configuration's predictions are joined to the others by row id (one equi-join),
    then every comparison needs only its eight cell counts.
    """
    ranked = metrics.select(config, "f1").orderBy(F.col("f1").desc(), config).limit(others + 1)
    best = first_per_key(ranked.withColumn("__one", F.lit(1)), ["__one"], [F.col("f1").desc(), config])
    best = best.select(F.col(config).alias("best"))
    rest = ranked.join(best, F.col(config) == F.col("best"), "left_anti").select(config)
    a = runs.join(best, F.col(config) == F.col("best")).select(
        row_id, "best", F.col(pred).alias("__a"), F.col(gold).cast("int").alias("__g")
    )
    b = runs.join(rest, config, "left_semi").select(
        row_id, F.col(config).alias("versus"), F.col(pred).alias("__b")
    )
    pairs = b.join(a, row_id)
    args = (F.col("__g") == 1, F.col("__a") == "1", F.col("__b") == "1", ["best", "versus"])
    fn = paired_bootstrap_by_draw if by_draw else paired_bootstrap
    return fn(pairs, *args, n_boot=n_boot, seed=seed).withColumn("significant", significant())
