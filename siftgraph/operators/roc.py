"""ROC curves, AUC and cross-validated thresholds from distinct-score counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import best_threshold, f1_of, ratio, score_bin, sweep_from_bins, with_ratios
from .ranking import hash_key, null_safe_join, ordered_rank, prefix_sums, unit_bucket

CV_FOLDS = 5
CV_SEED = 42


def score_counts(df: DataFrame, score: str, gold: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg) per distinct score."""
    g = F.col(gold) == 1
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(g).alias("pos"), F.count_if(~g).alias("neg")
    )


def roc_points(df, score, gold, by: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Cumulative counts and rates at each distinct score taken as an inclusive threshold."""
    return points_from_counts(score_counts(df, score, gold, by), by, bucket)


def points_from_counts(counts: DataFrame, by: Sequence[str] = (), bucket: Column | None = None):
    """ROC points of (by, score, pos, neg) counts."""
    by = list(by)
    bucket = unit_bucket("score") if bucket is None else bucket
    cum = prefix_sums(counts, "score", ["pos", "neg"], bucket, by, descending=True)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return null_safe_join(cum, totals, by).select(
        *by,
        F.col("score").alias("threshold"),
        "pos",
        "neg",
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        "n_pos",
        "n_neg",
        ratio(F.col("cum_pos"), F.col("n_pos")).alias("tpr"),
        ratio(F.col("cum_neg"), F.col("n_neg")).alias("fpr"),
    )


def auc(df, score, gold, by: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Mann-Whitney AUC: each negative counts the positives above it and half its ties."""
    return auc_from_points(roc_points(df, score, gold, by, bucket), by)


def auc_from_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    above = F.col("tp") - F.col("pos")
    wins = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    pairs = F.max("n_pos").cast("double") * F.max("n_neg")
    return points.groupBy(*by).agg(
        F.when(pairs == 0, F.lit(None).cast("double")).otherwise(wins / pairs).alias("auc")
    )


def youden(df, score, gold, by: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Threshold with the largest tpr - fpr (highest threshold on ties) and F1 there.

    Without a gain over the empty prediction the threshold is infinite and F1 is 0.
    """
    points = roc_points(df, score, gold, by, bucket)
    # integer form of tpr - fpr, so that ties are exact
    gain = F.col("tp") * F.col("n_neg") - F.col("fp") * F.col("n_pos")
    f1 = f1_of(F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp"))
    best = points.groupBy(*by).agg(
        F.max_by(
            F.struct(F.col("threshold"), f1.alias("f1"), gain.alias("gain"), "tpr", "fpr"),
            F.struct(gain, F.col("threshold")),
        ).alias("m")
    )
    found = F.col("m.gain") > 0
    return best.select(
        *by,
        F.when(found, F.col("m.threshold")).otherwise(F.lit(float("inf"))).alias("youden_threshold"),
        F.when(found, F.col("m.f1")).otherwise(F.lit(0.0)).alias("youden_f1"),
        F.when(found, F.col("m.tpr") - F.col("m.fpr")).otherwise(F.lit(0.0)).alias("youden_j"),
    )


def stratified_folds(
    df: DataFrame, strata: Sequence[str], row_id: str, k: int = CV_FOLDS, seed: int = CV_SEED
) -> DataFrame:
    """Add ``fold``: rank in a seeded shuffle inside each stratum, modulo ``k``."""
    d = df.withColumn("__h", hash_key(seed, row_id))
    ranked = ordered_rank(d, "__h", [row_id], strata, name="__rank")
    return ranked.withColumn("fold", F.pmod(F.col("__rank"), F.lit(k)).cast("int")).drop("__h", "__rank")


def fold_thresholds(
    folded: DataFrame, score: str, gold: str, grid: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Per fold: threshold with the best F1 on the other folds and F1 on the fold itself.

    Train counts are totals minus the fold's own counts, so the data is read once.
    """
    return thresholds_from_counts(score_counts(folded, score, gold, [*by, "fold"]), grid, by)


def thresholds_from_counts(counts: DataFrame, grid: Sequence[float], by: Sequence[str] = ()):
    """Fold thresholds of (by, fold, score, pos, neg) counts."""
    by = list(by)
    bins = counts.groupBy(*by, "fold", score_bin(F.col("score"), grid).alias("bin")).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("pos")
    )
    held = sweep_from_bins(bins, grid, [*by, "fold"])
    total = held.groupBy(*by, "threshold").agg(*[F.sum(c).alias(f"t_{c}") for c in ("tp", "fp", "fn", "tn")])
    both = null_safe_join(held, total, [*by, "threshold"])
    train = both.withColumn(
        "train_f1",
        f1_of(*[F.col(f"t_{c}") - F.col(c) for c in ("tp", "fp", "fn")]),
    ).withColumn("fold_f1", f1_of())
    # equal F1 in exact arithmetic must tie in floating point too
    best = best_threshold(
        train.withColumn("__key", F.round("train_f1", 12)).select(
            *by, "fold", "threshold", "train_f1", "fold_f1", "__key"
        ),
        [*by, "fold"],
        metric="__key",
    )
    return best.drop("__key")


def cross_validated_threshold(
    folded: DataFrame, score: str, gold: str, grid: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Mean and population deviation of held-out F1, mean threshold, mean fold AUC."""
    by = list(by)
    # one stored table of distinct scores feeds thresholds and curves, so the rows are read once
    counts = cut_lineage(score_counts(folded, score, gold, [*by, "fold"]))
    folds = thresholds_from_counts(counts, grid, by)
    aucs = auc_from_points(points_from_counts(counts, [*by, "fold"]), [*by, "fold"])
    d = null_safe_join(folds, aucs, [*by, "fold"])
    return d.groupBy(*by).agg(
        F.avg("fold_f1").alias("cv_mean_f1"),
        F.stddev_pop("fold_f1").alias("cv_std_f1"),
        F.avg("threshold").alias("mean_threshold"),
        F.avg("auc").alias("cv_mean_auc"),
    )


def out_of_fold(
    folded: DataFrame, score: str, gold: str, grid: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Rows with the prediction at their own fold's threshold (``oof_pred``)."""
    by = list(by)
    t = fold_thresholds(folded, score, gold, grid, by).select(*by, "fold", "threshold")
    d = null_safe_join(folded, t, [*by, "fold"])
    return d.withColumn("oof_pred", (F.col(score) >= F.col("threshold")).cast("int"))


def out_of_fold_metrics(oof: DataFrame, gold: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of out-of-fold predictions and the mean of the fold thresholds."""
    p, g = F.col("oof_pred") == 1, F.col(gold) == 1
    per_fold = oof.groupBy(*by, "fold", "threshold").agg(
        F.count_if(p & g).alias("tp"),
        F.count_if(p & ~g).alias("fp"),
        F.count_if(~p & g).alias("fn"),
        F.count_if(~p & ~g).alias("tn"),
    )
    total = per_fold.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.avg("threshold").alias("mean_threshold"),
    )
    return with_ratios(total)


def formula_comparison(df: DataFrame, config: Sequence[str], formulas: Sequence[str], gold: str) -> DataFrame:
    """AUC and Youden threshold per configuration, one column pair per score formula.

    ``df`` is long: one row per (row, configuration, formula) with column ``score``.
    """
    by = [*config, "formula"]
    both = null_safe_join(auc(df, "score", gold, by), youden(df, "score", gold, by), by)
    return both.groupBy(*config).pivot("formula", list(formulas)).agg(
        F.first("auc").alias("auc"), F.first("youden_threshold").alias("roc_t")
    )
