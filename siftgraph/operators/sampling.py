"""Folds, exact samples, vocabularies and set operations, all reproducible by md5 order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import HASH_DIGITS, first_per_key, hash_key, null_safe_join, prefix_sums, with_totals
from .roc import stratified_folds

MIN_PREDICATE_COUNT = 20
SEED = 42
WEIGHT_BITS = 30  # twice: a weight is kept to 2^-60 of the largest
PER_SEGMENT = 64


def predicate_folds(df: DataFrame, row_id: str, k: int, predicate="predicate", seed=SEED) -> DataFrame:
    """Stratified folds by predicate: sizes inside a predicate differ by at most one."""
    return stratified_folds(df, [predicate], row_id, k, seed)


def fold_sizes(folded: DataFrame) -> DataFrame:
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def train_split(folded: DataFrame, fold: int) -> DataFrame:
    return folded.filter(F.col("fold") == fold)


def other_splits(folded: DataFrame, fold: int) -> DataFrame:
    return folded.filter(F.col("fold") != fold)


def first_wins(df: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    return first_per_key(df, keys, [row_id])


def best_evidence(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """Highest-scoring row per key."""
    return first_per_key(df, keys, [F.col(score).desc(), *ties])


def top_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows of a total order (a report; kept in memory by TakeOrdered)."""
    return df.orderBy(*order).limit(n)


def cap_rows(df: DataFrame, n: int, row_number: str = "row_number") -> DataFrame:
    """Rows before position ``n``, by explicit position and not by arrival."""
    return df.filter(F.col(row_number) < n)


def exact_sample(
    df: DataFrame,
    n: int | DataFrame,
    ids: Sequence[str],
    seed: int = SEED,
    pool_filter: Column | None = None,
) -> DataFrame:
    """Uniform sample without replacement of exactly min(n, pool) rows.

    The sample is every row up to the n-th in md5 order of its ids, which must be unique.
    That row is found from ids alone: bucket totals say which bucket holds it, and only
    that bucket is ranked. Rows are then kept by comparing with it, so no other column is
    ever shuffled. ``n`` may be a one-row frame with column ``n`` (a size only known at run
    time).
    """
    pool = df if pool_filter is None else df.filter(pool_filter)
    key = F.struct(hash_key(seed, *ids).alias("__md5"), *[F.col(c) for c in ids])
    last = _nth_key(pool.select(key.alias("__key")), n)
    kept = with_totals(pool, last)
    inside = F.when(F.col("__all"), F.lit(True)).otherwise(F.coalesce(key <= F.col("__last"), F.lit(False)))
    return kept.filter(inside).drop("__last", "__all")


def _nth_key(keys: DataFrame, n: int | DataFrame) -> DataFrame:
    """One row: the n-th smallest ``__key`` (null if there is none), and whether all are wanted."""
    d = keys.withColumn("__b", F.substring("__key.__md5", 1, HASH_DIGITS))
    totals = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    running = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # few buckets
    upto = totals.withColumn("__upto", F.sum("__n").over(running))
    if isinstance(n, DataFrame):
        upto = with_totals(upto, n.select(F.col("n").cast("long").alias("__size")))
    else:
        upto = upto.withColumn("__size", F.lit(n).cast("long"))
    room = F.col("__size") - F.col("__upto") + F.col("__n")
    edge = upto.filter((room >= 1) & (room <= F.col("__n"))).select("__b", room.alias("__room"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__key"))
    found = d.join(F.broadcast(edge), "__b").withColumn("__place", place).filter(F.col("__place") == F.col("__room"))
    last = found.agg(F.max("__key").alias("__last"))
    every = upto.agg(F.coalesce(F.max(F.col("__upto")) <= F.max("__size"), F.lit(True)).alias("__all"))
    return with_totals(last, every)


def size_matched_control(raw: DataFrame, target: DataFrame, ids: Sequence[str], seed: int = SEED):
    """Uniform sample of ``raw`` with as many rows as ``target``."""
    size = target.agg(F.count(F.lit(1)).alias("n"))
    return exact_sample(raw, size, ids, seed)


def weighted_draws(
    df: DataFrame, weight: str, n: int, ids: Sequence[str], seed: int = SEED, parts: int | None = None
) -> DataFrame:
    """``n`` draws with replacement, probability proportional to ``weight``.

    Draw j is a 104-bit integer of md5(seed|j) modulo the total weight; it hits the row
    whose cumulative weight interval holds it. Rows and draws are matched by weight
    segment: the weight axis is cut into equal segments, a row is sent to each segment
    it covers and a draw to its own, so the range lookup becomes an equi-join. Weights
    are fixed-point integers relative to the largest (2^-60 of it is the unit and the
    least), their sums 128-bit decimals, so intervals meet exactly and small weights keep
    their ratios whatever the scale. The number of segments grows with the draws, so that
    one holds about ``PER_SEGMENT`` of them.
    """
    parts = parts or max(1, -(-n // PER_SEGMENT))
    d = df.filter(F.col(weight) > 0)
    top = d.agg(F.max(F.col(weight).cast("double"))).scalar()
    late = {"__h": hash_key(seed, *ids), "__w": fixed_point(F.col(weight).cast("double") / top)}
    d = d.withColumns(late)
    cum = prefix_sums(d, "__h", ["__w"], F.substring("__h", 1, 3), prefix="__cum", late=late)
    cum = cum.withColumn("__lo", F.col("__cum__w") - F.col("__w")).drop("__h", "__w")
    total = d.agg(F.sum("__w").alias("__total"))
    rows = null_safe_join(cum, total, [])
    segment = lambda c: F.floor(c.cast("double") / F.col("__total") * parts).cast("int")
    rows = rows.withColumn(
        "__seg", F.explode(F.sequence(segment(F.col("__lo")), segment(F.col("__cum__w"))))
    )
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"))
    draws = null_safe_join(draws, total, [])
    draws = draws.withColumn("__u", wide_draw(seed, "draw") % F.col("__total"))
    draws = draws.withColumn("__seg", segment(F.col("__u"))).drop("__total")
    hit = (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__cum__w"))
    return draws.join(rows, "__seg").filter(hit).select("draw", *df.columns)


def fixed_point(share: Column) -> Column:
    """A number in (0, 1] as an integer of 2^-60, at least 1; halves are exact, nothing is rounded twice."""
    scale = float(1 << WEIGHT_BITS)
    high = share * scale
    low = F.floor((high - F.floor(high)) * scale)
    return F.greatest(F.floor(high) * (1 << WEIGHT_BITS) + low, F.lit(1)).cast("decimal(20,0)")


def wide_draw(seed: int, *cols: str) -> Column:
    """Reproducible integer below 2^104: the first 26 digits of an md5."""
    digest = hash_key(seed, *cols)
    part = lambda at: F.conv(F.substring(digest, at, 13), 16, 10).cast("decimal(16,0)")
    return (part(1) * F.lit(1 << 52).cast("decimal(16,0)") + part(14)).cast("decimal(38,0)")


def uniform(seed: int, *cols: str) -> Column:
    """Reproducible uniform number in [0, 1) from the first 52 bits of an md5."""
    digest = F.substring(hash_key(seed, *cols), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**52))


def union_tagged(frames: dict[str, DataFrame | None], tag: str = "config") -> DataFrame:
    """Union of tables tagged with their configuration; missing tables are skipped."""
    present = {k: d for k, d in frames.items() if d is not None}
    if not present:
        raise ValueError("no table present")
    out = None
    for name, d in present.items():
        tagged = d.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def predicate_vocabulary(
    corpus: DataFrame,
    gold: DataFrame,
    gold_order: str,
    min_count: int = MIN_PREDICATE_COUNT,
    predicate: str = "predicate",
) -> DataFrame:
    """(predicate, id): frequent predicates sorted, then gold-only ones in first-seen order.

    The windows run over aggregated predicate lists, never over rows.
    """
    from pyspark.sql import Window

    frequent = (
        corpus.groupBy(predicate)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
        .select(predicate)
    )
    base = frequent.select(
        predicate,
        (F.row_number().over(Window.orderBy(predicate)) - 1).cast("long").alias("id"),
        F.lit(0).alias("gold_only"),
    )
    seen = gold.groupBy(predicate).agg(F.min(gold_order).alias("__first"))
    extra = seen.join(frequent, predicate, "left_anti")
    size = frequent.agg(F.count(F.lit(1)).alias("__base"))
    extra = null_safe_join(extra, size, []).select(
        predicate,
        (F.col("__base") + F.row_number().over(Window.orderBy("__first", predicate)) - 1)
        .cast("long")
        .alias("id"),
        F.lit(1).alias("gold_only"),
    )
    return base.unionByName(extra)


def label_set(frame: DataFrame, evaluated: DataFrame, min_count: int, predicate="predicate") -> DataFrame:
    """Predicates frequent in the corpus and present in the evaluation rows."""
    frequent = frame.groupBy(predicate).agg(F.count(F.lit(1)).alias("n"))
    frequent = frequent.filter(F.col("n") >= min_count).select(predicate)
    return frequent.intersect(evaluated.select(predicate))


def capped_sample(
    pool: DataFrame, labels: DataFrame, n: int, ids: Sequence[str], seed: int = SEED, predicate="predicate"
) -> DataFrame:
    """min(n, pool) rows of the pool restricted to a label set, which is broadcast."""
    return exact_sample(pool.join(F.broadcast(labels.select(predicate)), predicate, "left_semi"), n, ids, seed)


def drop_triples(graph: DataFrame, test: DataFrame, keys=("h", "r", "t")) -> DataFrame:
    return graph.join(test.select(*keys).distinct(), list(keys), "left_anti")


def shared_vocabulary_test(test: DataFrame, graphs: Sequence[DataFrame]) -> DataFrame:
    """Test triples whose head, relation and tail occur in every training graph."""
    entities, relations = None, None
    for g in graphs:
        e = g.select(F.explode(F.array("h", "t")).alias("e")).distinct()
        r = g.select("r").distinct()
        entities = e if entities is None else entities.intersect(e)
        relations = r if relations is None else relations.intersect(r)
    heads, tails = entities.withColumnRenamed("e", "h"), entities.withColumnRenamed("e", "t")
    return (
        test.join(heads, "h", "left_semi")
        .join(relations, "r", "left_semi")
        .join(tails, "t", "left_semi")
        .select(*test.columns)
    )


def inspection_sample(df: DataFrame, n: int, ids: Sequence[str], text: str = "text", seed: int = 7):
    """Random rows with the first 300 and last 160 characters of the passage."""
    from ..functions.text import word_count

    s = exact_sample(df, n, ids, seed)
    t = F.col(text)
    long_text = F.length(t) > 460
    return s.withColumns(
        {
            "words": word_count(text),
            "head": F.replace(F.substring(t, 1, 300), F.lit("\n"), F.lit(" ")),
            "tail": F.when(
                long_text, F.replace(F.right(t, F.lit(160)), F.lit("\n"), F.lit(" "))
            ).otherwise(""),
        }
    )
