"""Confusion counts, threshold sweeps and rankings of configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_per_key, null_safe_join, upper_median

COUNTS = ("tp", "fp", "fn", "tn")
METRICS = ("f1", "accuracy", "precision", "recall")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 for an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def f1_of(tp="tp", fp="fp", fn="fn") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return ratio(2 * c(tp), 2 * c(tp) + c(fp) + c(fn))


def confusion_aggs(pred: Column, gold: Column) -> list[Column]:
    """tp, fp, fn, tn as aggregates of boolean columns; a null prediction is negative."""
    p, g = F.coalesce(pred, F.lit(False)), F.coalesce(gold, F.lit(False))
    return [
        F.count_if(p & g).alias("tp"),
        F.count_if(p & ~g).alias("fp"),
        F.count_if(~p & g).alias("fn"),
        F.count_if(~p & ~g).alias("tn"),
    ]


def with_ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": f1_of(),
        }
    )


def confusion(
    df: DataFrame, pred: Column, gold: Column, by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """Confusion counts and ratios per group, plus extra aggregates."""
    return with_ratios(df.groupBy(*by).agg(*confusion_aggs(pred, gold), *extra))


def hard_label_metrics(
    runs: DataFrame, by: Sequence[str], pred: str = "pred", gold: str = "label", more: Sequence[Column] = ()
):
    """Metrics of "1"/"0"/other strings; others count as negative and are reported. ``more`` aggregates may follow."""
    p, g = F.col(pred) == "1", F.col(gold).cast("int") == 1
    known = F.coalesce(F.col(pred).isin("1", "0"), F.lit(False))
    extra = [
        F.count_if(~known).alias("n_unknown"),
        F.avg(F.coalesce(p, F.lit(False)).cast("double")).alias("pred_pos_rate"),
    ]
    return confusion(runs, p, g, by, [*extra, *more])


def metrics_at_threshold(
    df: DataFrame, score: str, gold: str, threshold: float, by=(), strict: bool = False
) -> DataFrame:
    s = F.col(score)
    return confusion(df, s > threshold if strict else s >= threshold, F.col(gold) == 1, by)


def score_bin(score: Column, grid: Sequence[float], strict: bool = False) -> Column:
    """How many thresholds of the ascending grid the score reaches."""
    hit = [(score > t if strict else score >= t).cast("int") for t in grid]
    out = hit[0]
    for h in hit[1:]:
        out = out + h
    return F.coalesce(out, F.lit(0))


def binned_counts(df, score, gold, grid, by=(), strict=False) -> DataFrame:
    """(by, bin, n, pos): all any threshold of the grid needs, whatever the corpus size."""
    b = score_bin(F.col(score), grid, strict)
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(gold) == 1).alias("pos")
    )


def sweep_from_bins(bins: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts per group and threshold from binned counts."""
    cells = F.array(
        *[F.struct(F.lit(i + 1).alias("step"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)]
    )
    hit = F.col("bin") >= F.col("step")
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return (
        bins.select("*", F.inline(cells))
        .groupBy(*by, "threshold")
        .agg(
            F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
            F.sum(F.when(hit, 0).otherwise(pos)).alias("fn"),
            F.sum(F.when(hit, 0).otherwise(neg)).alias("tn"),
        )
    )


def threshold_sweep(
    df: DataFrame, score: str, gold: str, grid: Sequence[float], by: Sequence[str] = (), strict=False
) -> DataFrame:
    """Metrics at every threshold of the grid from one scan and one small shuffle."""
    return with_ratios(sweep_from_bins(binned_counts(df, score, gold, grid, by, strict), grid, by))


def best_threshold(sweep: DataFrame, by: Sequence[str] = (), metric: str = "f1") -> DataFrame:
    """Row with the highest metric per group; the lowest threshold wins ties."""
    best = F.max_by(
        F.struct(*[c for c in sweep.columns if c not in by]),
        F.struct(F.col(metric), -F.col("threshold")),
    )
    return sweep.groupBy(*by).agg(best.alias("__m")).select(*by, "__m.*")


def nearest_threshold(sweep: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Metrics at the grid threshold closest to ``target`` (the lower one on a tie)."""
    gap = F.round(F.abs(F.col("threshold") - target), 9)
    near = F.min_by(
        F.struct(*[c for c in sweep.columns if c not in by]), F.struct(gap, F.col("threshold"))
    )
    return sweep.groupBy(*by).agg(near.alias("__m")).select(*by, "__m.*")


def score_summary(df: DataFrame, score: str, by: Sequence[str], bucket: Column) -> DataFrame:
    """n, mean, upper median, min and max of a score per group."""
    basic = df.groupBy(*by).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("score_mean"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
    )
    return null_safe_join(basic, upper_median(df, score, bucket, by), by)


def per_predicate_f1(
    df: DataFrame, pred: Column, gold: Column, by=(), predicate="predicate", min_n: int = 1
) -> DataFrame:
    """F1 per (group, predicate) with at least ``min_n`` examples."""
    extra = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(gold, F.lit(False)).cast("double")).alias("pos_rate"),
    ]
    d = confusion(df, pred, gold, [*by, predicate], extra).filter(F.col("n") >= min_n)
    return d.select(*by, predicate, "n", "pos_rate", "tp", "fp", "fn", "tn", "f1")


def predicate_macro_f1(df, pred: Column, gold: Column, by=(), predicate="predicate", min_n=1):
    """Unweighted mean of per-predicate F1, NaN when no predicate is large enough."""
    counts = per_predicate_f1(df, pred, gold, by, predicate, 1)
    mean = F.avg(F.when(F.col("n") >= min_n, F.col("f1")))
    return counts.groupBy(*by).agg(F.coalesce(mean, F.lit(float("nan"))).alias("macro_f1"))


def class_macro_f1(df: DataFrame, pred: str, gold: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean F1 over the union of true and predicted classes, accuracy and n."""
    pairs = df.groupBy(*by, F.col(gold).alias("__g"), F.col(pred).alias("__p")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    same = F.col("__g").eqNullSafe(F.col("__p"))
    cells = pairs.select(
        *by,
        F.inline(
            F.when(
                same,
                F.array(F.struct(F.col("__g").alias("cls"), F.col("__n").alias("tp"), F.lit(0).cast("long").alias("err"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("__g").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("__n").alias("err")),
                    F.struct(F.col("__p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("__n").alias("err")),
                )
            )
        ),
    )
    per_class = cells.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("err").alias("err"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("err"))
    macro = per_class.groupBy(*by).agg(
        F.avg(f1).alias("class_macro_f1"), F.count(F.lit(1)).alias("n_classes"), F.sum("tp").alias("__hit")
    )
    totals = pairs.groupBy(*by).agg(F.sum("__n").alias("n"))
    joined = null_safe_join(macro, totals, by)
    return joined.withColumn("accuracy", ratio(F.col("__hit"), F.col("n"))).drop("__hit")


def error_rates(metrics: DataFrame) -> DataFrame:
    """False-positive and false-negative rates from confusion counts."""
    return metrics.withColumns(
        {
            "fp_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
            "fn_rate": ratio(F.col("fn"), F.col("fn") + F.col("tp")),
        }
    )


def mean_by(metrics: DataFrame, axis: str, metric: str = "f1") -> DataFrame:
    """Mean metric and number of configurations per value of one axis."""
    return metrics.groupBy(axis).agg(
        F.avg(metric).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n_configs")
    )


def run_ordinal(config: str, order: Sequence[str]) -> Column:
    """Place of a configuration in the order the runs were made."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(config))


def best_per_metric(metrics: DataFrame, config: Sequence[str], names=METRICS, ordinal: str | None = None) -> DataFrame:
    """Best configuration for each metric; the first run wins ties (``ordinal``), else the smallest name."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    ties = [ordinal] if ordinal else list(config)
    long = metrics.select(*config, *([ordinal] if ordinal else []), F.inline(cells))
    best = first_per_key(long, ["metric"], [F.col("value").desc(), *ties])
    return best.drop(ordinal) if ordinal else best


def rank_configs(
    metrics: DataFrame, by: Sequence[str], ties: Sequence[str], metric: str = "f1"
) -> DataFrame:
    """Rank of each configuration inside its group, best first (metric tables are small)."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), *ties)
    return metrics.withColumn("rank", F.row_number().over(w))


def best_per_group(metrics: DataFrame, by: Sequence[str], ties: Sequence[str], metric="f1"):
    return first_per_key(metrics, by, [F.col(metric).desc(), *ties])


def error_examples(runs: DataFrame, kind: str, pred: str, gold: str, order: Sequence, n: int = 10):
    """First ``n`` false positives ("fp") or false negatives ("fn") in a total order."""
    p, g = ("1", 0) if kind == "fp" else ("0", 1)
    bad = runs.filter((F.col(pred) == p) & (F.col(gold).cast("int") == g))
    return bad.orderBy(*order).limit(n)
