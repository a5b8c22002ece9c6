"""Exact ranks, prefix sums and quantiles without one-task windows.

Every ordering here is split into coarse ordered buckets first. A small window runs
over the bucket totals (at most the number of buckets per group) and the fine window
only inside one bucket, so a group that holds a third of the rows is still spread
over all its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3  # 16**3 = 4096 ordered buckets


def hash_key(seed, *cols) -> Column:
    """Reproducible pseudo-random order key: md5 of seed and columns joined by '|'."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as scalar subqueries (no join)."""
    one = totals.select(F.struct(*[F.col(c) for c in totals.columns]).alias("__t"))
    return df.withColumn("__t", one.scalar()).select("*", "__t.*").drop("__t")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"):
    """Join on ``keys`` where null matches null; the right key copies are dropped.

    Without keys the right side is a global aggregate, i.e. one row.
    """
    if not keys:
        return with_totals(left, right)
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _met(offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bucket offsets as the side of a join; without keys there are only as many as buckets."""
    return offsets if keys else F.broadcast(offsets)


def ordered_rank(
    df: DataFrame,
    hash_col: str,
    ties: Sequence[str] = (),
    keys: Sequence[str] = (),
    name: str = "rank",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """0-based rank by ``(hash_col, *ties)`` inside ``keys``; equals row_number() - 1."""
    keys = list(keys)
    d = df.withColumn("__b", F.substring(F.col(hash_col), 1, digits))
    totals = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(hash_col, *ties)
    return (
        null_safe_join(d, _met(offsets, keys), [*keys, "__b"])
        .withColumn(name, F.col("__off") + F.row_number().over(inside) - 1)
        .drop("__b", "__off")
    )


def prefix_sums(
    df: DataFrame,
    order: str,
    measures: Sequence[str],
    bucket: Column,
    keys: Sequence[str] = (),
    descending: bool = False,
    prefix: str = "cum_",
    late: dict[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums of ``measures`` along ``order`` inside ``keys``.

    ``df`` holds one row per (keys, order) value, i.e. it is already aggregated;
    ``bucket`` must be monotone in ``order``. Columns of ``late`` do not move with the rows but are
    computed again from the others.
    """
    keys = list(keys)
    d = df.withColumn("__b", bucket)
    totals = d.groupBy(*keys, "__b").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    b_order = F.col("__b").desc() if descending else F.col("__b").asc()
    before = Window.partitionBy(*keys).orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "__b",
        *[F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures],
    )
    v_order = F.col(order).desc() if descending else F.col(order).asc()
    inside = (
        Window.partitionBy(*keys, "__b")
        .orderBy(v_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if late:
        d = d.drop(*late).repartition(*keys, "__b").withColumns(late)
    out = null_safe_join(d, _met(offsets, keys), [*keys, "__b"])
    for m in measures:
        out = out.withColumn(f"{prefix}{m}", F.col(f"__o_{m}") + F.sum(m).over(inside))
    return out.drop("__b", *[f"__o_{m}" for m in measures])


def unit_bucket(col: str, steps: int = 64, clip: int = 40) -> Column:
    """Monotone bucket for scores in [-1, 1] that also splits the crowded ends.

    Model scores pile up next to 0 and 1, where equal-width buckets would put most
    distinct values into one task; a log-odds scale spreads both ends over thousands of
    buckets.
    """
    c = F.col(col).cast("double")
    size = F.abs(c)
    odds = F.log(size / (1 - size))
    level = F.greatest(F.least(odds, F.lit(float(clip))), F.lit(-float(clip)))
    rung = F.floor(level * steps) + clip * steps + 1
    end = 2 * clip * steps + 2
    rung = F.when(size >= 1, F.lit(end)).when(size == 0, F.lit(0)).otherwise(rung)
    return F.when(c.isNull(), F.lit(None)).when(c < 0, -rung).otherwise(rung)


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, n): the pre-aggregated form all quantile operators start from."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    bucket: Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolated quantiles per group, one output column per entry of ``probs``.

    Works on distinct values, so memory and shuffle grow with distinct values and not
    with rows; no group is collected.
    """
    keys = list(keys)
    cum = prefix_sums(value_counts(df, value, keys), value, ["n"], bucket, keys)
    total = cum.groupBy(*keys).agg(F.max("cum_n").alias("__total"))
    d = null_safe_join(cum, total, keys)
    aggs = []
    for name, p in probs.items():
        h = (F.col("__total") - 1) * F.lit(float(p))
        lo = F.min(F.when(F.col("cum_n") > F.floor(h), F.col(value)))
        hi = F.min(F.when(F.col("cum_n") > F.ceil(h), F.col(value)))
        frac = F.max(h - F.floor(h))
        aggs.append((lo + (hi - lo) * frac).cast("double").alias(name))
    return d.groupBy(*keys).agg(*aggs)


def upper_median(df: DataFrame, value: str, bucket: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Element at position n div 2 of the sorted values (0-based), per group."""
    keys = list(keys)
    cum = prefix_sums(value_counts(df, value, keys), value, ["n"], bucket, keys)
    total = cum.groupBy(*keys).agg(F.max("cum_n").alias("__total"))
    d = null_safe_join(cum, total, keys)
    at = F.floor(F.col("__total") / 2)
    return d.groupBy(*keys).agg(F.min(F.when(F.col("cum_n") > at, F.col(value))).alias("score_median"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Row with the smallest ``order`` per key.

    ``row_number() = 1`` lets Spark push a group limit below the shuffle, so each map
    task sends at most one row per key and a hot key cannot pile up.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
