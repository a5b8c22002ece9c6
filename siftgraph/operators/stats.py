"""Corpus statistics and evaluation tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import coerce_flag
from ..functions.text import word_count
from .bootstrap import bootstrap_f1
from .metrics import (
    best_per_group,
    best_threshold,
    confusion,
    f1_of,
    hard_label_metrics,
    metrics_at_threshold,
    predicate_macro_f1,
    ratio,
    score_summary,
    threshold_sweep,
)
from .ranking import exact_quantiles, first_per_key, null_safe_join, unit_bucket

# --- Fixed values: bin edges, limits and subset names of the published reports ------
CHAR_BINS = ((0, 100, "<100"), (100, 200, "100-200"), (200, 400, "200-400"), (400, None, "400+"))
WORD_BINS = ((0, 100, "0-100"), (100, 250, "100-250"), (250, 500, "250-500"), (500, None, "500-+"))
SCORE_BINS = ((0.0, 0.3, "<0.3"), (0.3, 0.5, "0.3-0.5"), (0.5, 0.7, "0.5-0.7"), (0.7, 0.9, "0.7-0.9"), (0.9, None, ">=0.9"))
MIN_BUCKET = 10
FREQUENT = 20
BASELINE_THRESHOLD = 0.75
BASELINE_GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
# --- end of fixed values -------------------------------------------------------------


def binned(col: Column, bins: Sequence[tuple]) -> Column:
    """Name of the half-open bin a value falls in; null outside all bins."""
    out = None
    for low, high, name in bins:
        test = col >= low if high is None else (col >= low) & (col < high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def with_all(df: DataFrame, group: Column, name: str, label: str = "ALL") -> DataFrame:
    """Rows once under their group and once under ``label`` (null groups only under it)."""
    return df.withColumn(
        name, F.explode(F.filter(F.array(group, F.lit(label)), lambda g: g.isNotNull()))
    )


def unpivot_signals(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long form (ids, signal, value) without a shuffle."""
    cells = [
        F.struct(F.lit(c).alias("signal"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    return df.select(*ids, F.inline(F.array(*cells)))


def outcome_summary(df: DataFrame, score: str, gold: str, threshold: float, by: Sequence[str]) -> DataFrame:
    """Score summary per outcome TP/FP/FN/TN."""
    p, g = F.col(score) >= threshold, F.col(gold) == 1
    outcome = F.when(p & g, "TP").when(p & ~g, "FP").when(~p & g, "FN").otherwise("TN")
    return score_summary(df.withColumn("outcome", outcome), score, [*by, "outcome"], unit_bucket(score))


def accuracy_by_length(df, score, gold, threshold, by, length: Column, bins=CHAR_BINS) -> DataFrame:
    """Accuracy per group and length bin."""
    d = df.withColumn("length_bin", binned(length, bins))
    m = metrics_at_threshold(d, score, gold, threshold, [*by, "length_bin"])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return m.select(*by, "length_bin", n.alias("n"), "accuracy")


def f1_by_words(
    df: DataFrame,
    pred: Column,
    gold: Column,
    words: Column,
    by: Sequence[str] = (),
    interval: Callable = bootstrap_f1,
    min_n: int = MIN_BUCKET,
    **kwargs,
) -> DataFrame:
    """F1 with interval per word-count bucket and for ALL rows; small buckets are skipped."""
    d = with_all(df.select("*", pred.alias("__p"), gold.alias("__g")), binned(words, WORD_BINS), "bucket")
    keys = [*by, "bucket"]
    sizes = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("__g").cast("double")).alias("pos_rate")
    )
    ci = interval(d, F.col("__p"), F.col("__g"), keys, **kwargs)
    big = sizes.filter((F.col("n") >= min_n) | (F.col("bucket") == "ALL"))
    return null_safe_join(big, ci, keys)


def score_distribution(df: DataFrame, score: str, gold: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per score bin; a missing score counts as 0.5."""
    s = F.coalesce(F.col(score).cast("double"), F.lit(0.5))
    g = F.col(gold) == 1
    d = df.withColumn("score_bin", binned(s, SCORE_BINS)).filter("score_bin is not null")
    return d.groupBy(*by, "score_bin").agg(
        F.count_if(g).alias("n_pos"), F.count_if(~g).alias("n_neg")
    )


def predicate_matrix(
    runs: DataFrame, config: str, predicate: str, min_n: int = 5, top: int = 10, pred="pred", gold="label"
) -> DataFrame:
    """Per-predicate F1 of the ``top`` configurations by F1, long form with the mean."""
    cells = hard_label_metrics(runs, [config, predicate], pred, gold)
    overall = cells.groupBy(config).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    best = overall.orderBy(f1_of().desc(), config).limit(top).select(config)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    picked = cells.join(best, config, "left_semi").withColumn("n", n).filter(F.col("n") >= min_n)
    return picked.select(predicate, config, "n", "f1")


def predicate_difficulty(matrix: DataFrame, predicate: str, easiest: bool, n: int = 10) -> DataFrame:
    """Predicates with the highest (or lowest) mean F1 over the chosen configurations."""
    mean = matrix.groupBy(predicate).agg(F.avg("f1").alias("mean_f1"), F.max("n").alias("n"))
    key = F.round("mean_f1", 12)
    return mean.orderBy(key.desc() if easiest else key.asc(), predicate).limit(n)


def pivot_configs(matrix: DataFrame, predicate: str, config: str, names: Sequence[str]) -> DataFrame:
    return matrix.groupBy(predicate).pivot(config, list(names)).agg(F.first("f1"))


def predicate_by_shot(
    runs: DataFrame, config: Sequence[str], shot: str, shots: Sequence[int], predicate: str,
    min_n: int = 5, top: int = 20, pred="pred", gold="label",
) -> DataFrame:
    """Mean F1 per predicate and shot count, for the ``top`` predicates by rows."""
    m = hard_label_metrics(runs, [*config, shot, predicate], pred, gold)
    m = m.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    sizes = m.groupBy(predicate).agg(F.max("n").alias("n")).filter(F.col("n") >= min_n)
    largest = sizes.orderBy(F.col("n").desc(), predicate).limit(top)
    wide = m.drop("n").join(largest, predicate).groupBy(predicate, "n").pivot(shot, list(shots))
    out = wide.agg(F.avg("f1"))
    return out.select(predicate, "n", *[F.col(str(s)).alias(f"shot_{s}") for s in shots])


def agreement_matrix(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    """Share of rows on which two prediction columns agree, for every pair (one scan)."""
    pairs = [(a, b) for a in preds for b in preds]
    aggs = [
        F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias(f"__{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    cells = [
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"__{i}").alias("agreement"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def signal_statistics(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    """Counts and percentages of 1 / 0 / -5 / null per prediction column, in one scan."""
    tests = {
        "n_pos": lambda c: c == 1,
        "n_neg": lambda c: c == 0,
        "n_split": lambda c: c == -5,
        "n_na": lambda c: c.isNull(),
    }
    aggs = [F.count_if(t(F.col(c))).alias(f"{c}|{k}") for c in preds for k, t in tests.items()]
    cells = [
        F.struct(F.lit(c).alias("signal"), *[F.col(f"{c}|{k}").alias(k) for k in tests]) for c in preds
    ]
    long = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs).select("n_rows", F.inline(F.array(*cells)))
    pct = lambda k: ratio(F.col(k) * 100, F.col("n_rows"))
    total = F.col("n_pos") + F.col("n_neg") + F.col("n_split") + F.col("n_na")
    return long.select(
        "signal",
        total.alias("n_total"),
        *tests,
        pct("n_pos").alias("pct_pos"),
        pct("n_neg").alias("pct_neg"),
        pct("n_split").alias("pct_split"),
    )


def prediction_distribution(scores: DataFrame, score: str, threshold: float, by=()) -> DataFrame:
    present = scores.filter(F.col(score).isNotNull())
    d = present.groupBy(*by).agg(
        F.count_if(F.col(score) >= threshold).alias("n_pos"),
        F.count_if(F.col(score) < threshold).alias("n_neg"),
        F.count(F.lit(1)).alias("n_total"),
    )
    return d.withColumn("pct_pos", ratio(F.col("n_pos") * 100, F.col("n_total")))


def dataset_statistics(df: DataFrame, doc="docid", predicate="predicate", label="label", text="text"):
    """One row: rows, documents, triples per document, predicates, rates, mean lengths."""
    base = df.agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_distinct(doc).alias("unique_docs"),
        F.avg(F.col(label).cast("double") * 100).alias("pos_rate"),
        F.avg(word_count(text).cast("double")).alias("mean_words"),
        F.avg(F.length(text).cast("double")).alias("mean_chars"),
    )
    per = df.groupBy(predicate).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate")
    )
    preds = per.agg(
        F.count(F.lit(1)).alias("unique_predicates"),
        F.count_if(F.col("n") >= FREQUENT).alias("preds_ge20"),
        (F.stddev_samp("rate") * 100).alias("pos_rate_std_by_pred"),
    )
    return null_safe_join(base, preds, []).withColumn(
        "triples_per_doc", ratio(F.col("examples"), F.col("unique_docs"))
    )


def describe_lengths(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """mean, median, sample std, min and max per length column (and group)."""
    cells = [F.struct(F.lit(k).alias("measure"), c.cast("int").alias("v")) for k, c in columns.items()]
    long = df.select(*by, F.inline(F.array(*cells)))
    keys = [*by, "measure"]
    basic = long.groupBy(*keys).agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    median = exact_quantiles(long, "v", {"median": 0.5}, F.floor(F.col("v") / 16), keys)
    return null_safe_join(basic, median, keys)


def five_numbers(df: DataFrame, value: str, by: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Minimum, quartiles and maximum with linear interpolation."""
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}
    return exact_quantiles(df, value, probs, F.floor(F.col(value) / 16) if bucket is None else bucket, by)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """Most frequent values with their share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    top = counts.orderBy(F.col("n").desc(), column).limit(n)
    return (
        null_safe_join(top, total, [])
        .withColumn("pct", ratio(F.col("n") * 100, F.col("__total")))
        .drop("__total")
    )


def positive_rate_by_value(df: DataFrame, column: str, label: str, n: int) -> DataFrame:
    """Total, positives, negatives and positive percentage of the ``n`` most frequent values."""
    counts = df.groupBy(column).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos")
    )
    top = counts.orderBy(F.col("n").desc(), column).limit(n)
    return top.withColumns(
        {"n_neg": F.col("n") - F.col("n_pos"), "pct_pos": ratio(F.col("n_pos") * 100, F.col("n"))}
    )


def crosstab(df: DataFrame, column: str, label: str) -> DataFrame:
    """Value x label counts, zero-filled, with row percentages."""
    c = df.groupBy(column).agg(
        F.count_if(F.col(label) == 0).alias("n_0"), F.count_if(F.col(label) == 1).alias("n_1")
    )
    total = F.col("n_0") + F.col("n_1")
    return c.withColumns(
        {"pct_0": ratio(F.col("n_0") * 100, total), "pct_1": ratio(F.col("n_1") * 100, total)}
    )


def top_and_other(df: DataFrame, column: str, n: int = 15, other: str = "Other") -> DataFrame:
    """Counts of the top values, the rest rolled up into one row."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), column).limit(n).select(column).withColumn("__top", F.lit(1))
    name = F.when(F.col("__top").isNotNull(), F.col(column)).otherwise(other)
    joined = counts.join(top, column, "left").select(name.alias(column), "n")
    return joined.groupBy(column).agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, value: Column, upper: float, bins: int = 54, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins on [0, upper] of clipped values; the last bin is closed."""
    v = F.least(value.cast("double"), F.lit(float(upper)))
    b = F.least(F.floor(v * bins / float(upper)), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def published_quality(
    df: DataFrame, label: str, gold: str, subset: str, interval: Callable = bootstrap_f1, **kwargs
) -> DataFrame:
    """Coverage, precision, recall, F1 and interval of the published label per subset and ALL."""
    d = with_all(df.withColumn("__l", F.coalesce(F.col(label).cast("int"), F.lit(-1))), F.col(subset), "part", "all")
    sizes = d.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("__l") >= 0).alias("covered"),
        F.count_if(F.col("__l") == 1).alias("n_pos_in_release"),
        F.count_if(F.col("__l") == 0).alias("n_neg_in_release"),
    )
    sizes = sizes.withColumn("coverage", ratio(F.col("covered"), F.col("n")))
    covered = d.filter("__l >= 0")
    p, g = F.col("__l") == 1, F.col(gold) == 1
    m = confusion(covered, p, g, ["part"]).select("part", "precision", "recall")
    ci = interval(covered, p, g, ["part"], **kwargs)
    return sizes.join(m, "part", "left").join(ci, "part", "left")


def signal_table(
    df: DataFrame, preds: Sequence[str], gold: str, predicate: str, min_n: int = 10,
    interval: Callable = bootstrap_f1, **kwargs,
) -> DataFrame:
    """F1 with interval, predicate-macro F1 and positive rate of every signal.

    A null or split prediction counts as negative.
    """
    long = unpivot_signals(df, [gold, predicate], preds)
    long = long.withColumn("__p", coerce_flag("value") == 1).withColumn("__g", F.col(gold) == 1)
    p, g = F.col("__p"), F.col("__g")
    ci = interval(long, p, g, ["signal"], **kwargs)
    macro = predicate_macro_f1(long, p, g, ["signal"], predicate, min_n)
    rate = long.groupBy("signal").agg(F.avg(p.cast("double")).alias("pos_rate"))
    return ci.join(macro, "signal").join(rate, "signal")


def signal_by_subset(df: DataFrame, preds: Sequence[str], gold: str, subset: str) -> DataFrame:
    """F1 per signal and subset, plus all rows."""
    long = unpivot_signals(df, [gold, subset], preds)
    long = long.withColumn("__p", coerce_flag("value") == 1)
    long = with_all(long, F.col(subset), "part", "all")
    n = F.count(F.lit(1)).alias("n")
    return confusion(long, F.col("__p"), F.col(gold) == 1, ["signal", "part"], [n]).select(
        "signal", "part", "n", "f1"
    )


def annotated_precision(df: DataFrame, consensus: str, manual: str) -> DataFrame:
    """Precision of the predicted-clean and predicted-noise groups of annotated rows."""
    d = df.filter(F.col(manual).isNotNull() & F.col(consensus).isin(0, 1))
    out = d.groupBy(F.col(consensus).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(manual) == F.col(consensus)).alias("n_correct")
    )
    return out.withColumn("precision", ratio(F.col("n_correct"), F.col("n")))


def annotated_models(df: DataFrame, preds: Sequence[str], manual: str) -> DataFrame:
    """Metrics of every signal on the annotated rows; a missing prediction is negative."""
    long = unpivot_signals(df.filter(F.col(manual).isNotNull()), [manual], preds)
    return confusion(long, F.col("value") == "1", F.col(manual) == 1, ["signal"])


def annotated_predicates(df: DataFrame, predicate: str, manual: str) -> DataFrame:
    d = df.filter(F.col(manual).isNotNull()).groupBy(predicate).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(manual) == 1).alias("n_pos")
    )
    return d.withColumn("pct_pos", ratio(F.col("n_pos") * 100, F.col("n")))


def baseline_table(df: DataFrame, score: str, gold: str, by: Sequence[str], predicate: str, min_n: int = 10):
    """Fixed-rule filter (score > 0.75) against its best threshold, per group.

    Both rows carry precision, recall, F1 with its interval, accuracy and predicate-macro F1.
    """
    by = list(by)
    fixed = metrics_at_threshold(df, score, gold, BASELINE_THRESHOLD, by, strict=True)
    fixed = fixed.withColumns({"mode": F.lit("as-published"), "threshold": F.lit(BASELINE_THRESHOLD)})
    sweep = threshold_sweep(df, score, gold, BASELINE_GRID, by, strict=True)
    keyed = sweep.withColumn("__key", F.round("f1", 12))
    tuned = best_threshold(keyed, by, "__key").drop("__key").withColumn("mode", F.lit("best-threshold"))
    rows = fixed.unionByName(tuned)
    # two rows a group: the table itself is not dealt by group
    labelled = null_safe_join(df, F.broadcast(rows.select(*by, "mode", "threshold")), by)
    p, g = F.col(score) > F.col("threshold"), F.col(gold) == 1
    macro = predicate_macro_f1(labelled, p, g, [*by, "mode"], predicate, min_n)
    ci = bootstrap_f1(labelled, p, g, [*by, "mode"]).select(*by, "mode", "ci_lo", "ci_hi")
    return null_safe_join(null_safe_join(rows, macro, [*by, "mode"]), ci, [*by, "mode"])


def best_row_per_model(metrics: DataFrame, model: str, metric: str, ties: Sequence[str]) -> DataFrame:
    return best_per_group(metrics, [model], ties, metric)


def seed_summary(results: DataFrame, variant: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))]
    return results.groupBy(variant).agg(F.count(F.lit(1)).alias("n_seeds"), *aggs)


def token_totals(calls: DataFrame, prices: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    """Token sums and cost per configuration; prices per million tokens joined by model.

    Models without a price keep their tokens, with null cost and ``priced`` false.
    """
    sums = calls.groupBy(*dict.fromkeys([*by, model])).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    known = sums.join(prices, model, "left").withColumns({"cost": cost, "priced": F.col("price_in").isNotNull()})
    return known.drop("price_in", "price_out")


def throughput(runs: DataFrame, by: Sequence[str], rows: str = "n_rows", seconds: str = "seconds"):
    """Rows, seconds and rows per second (infinite for zero time)."""
    d = runs.groupBy(*by).agg(F.sum(rows).alias("n_rows"), F.sum(seconds).alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.col("n_rows") / F.col("seconds"))
    return d.withColumn("rows_per_sec", rate.otherwise(F.lit(float("inf"))))
