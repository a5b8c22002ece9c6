"""Sharding along a Hilbert curve over document metadata.

Source, language and size are quantised to ``BITS`` bits each; the curve index of that
point orders the documents, and runs of equal length are cut into shards. Documents of one
shard are close in all three, so readers that filter on any of them skip most shards and,
inside a shard, most row groups.

The curve is a state machine: ``2 ** BITS`` steps of a table of (state, corner) that is
built from the Gray-code rule. Law ``rows``: shard sizes differ by one row at most.

Scale: only narrow rows are shuffled, by range of (index, crc32, id), and ranks are the running
count inside a range partition plus one total per partition. Everything is DataFrame
expressions. ``write_shards`` moves the texts once, to their shard.

Defined cases: null texts have size 8 and crc32 0; null source or language come first in
their dimension; ties on the curve go by the text's crc32, so equal texts are neighbours,
then by doc_id (null first); an empty table gives an empty result. Only the columns named
here are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

SHARDS = 24
BITS = 8
DIMS = 3


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _rotate(x: int, by: int, bits: int) -> int:
    by %= bits
    return ((x << by) | (x >> (bits - by))) & ((1 << bits) - 1)


def _trailing_ones(i: int) -> int:
    n = 0
    while i & 1:
        i, n = i >> 1, n + 1
    return n


def curve_table(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """(corner order, next state) at ``state * 2**dims + corner bits``.

    A state is the entry corner and the direction of travel of a sub-cube.
    """
    size = 1 << dims
    order, following = [], []
    for state in range(size * dims):
        entry, direction = divmod(state, dims)
        for corner in range(size):
            turned = _rotate(corner ^ entry, -(direction + 1), dims)
            w = next(i for i in range(size) if _gray(i) == turned)
            start = 0 if w == 0 else _gray(2 * ((w - 1) // 2))
            axis = 0 if w == 0 else _trailing_ones(w - 1 if w % 2 == 0 else w) % dims
            order.append(w)
            following.append((entry ^ _rotate(start, direction + 1, dims)) * dims + (direction + axis + 1) % dims)
    return order, following


def hilbert_index(codes: list[Column], bits: int = BITS) -> Column:
    """Curve index of integer codes below ``2 ** bits``."""
    order, following = (F.array(*map(F.lit, t)) for t in curve_table(len(codes)))
    size = 1 << len(codes)

    def step(acc: Column, level: Column) -> Column:
        corner = sum(
            (F.call_function("shiftright", c.cast("int"), level).bitwiseAND(1) * (1 << j) for j, c in enumerate(codes)),
            F.lit(0),
        )
        at = acc["state"] * size + corner + 1
        return F.struct(
            (acc["h"] * size + F.element_at(order, at)).alias("h"), F.element_at(following, at).alias("state")
        )

    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("state"))
    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, start, step)["h"]


def ranked(df: DataFrame, order: list[Column], name: str, by: list[str]) -> DataFrame:
    """0-based rank along ``order`` (range-partitioned by the columns ``by`` first)."""
    parts = stored(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return parts.join(base, "__part").withColumn(name, F.col("__base") + F.row_number().over(inside) - 1).drop("__part", "__base")


def category_codes(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(column, code): distinct values in order, spread evenly over the codes; null has none."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    placed = stored(ranked(values, [F.col(column)], "__rank", [column]), "categories")
    n = placed.count()
    spread = F.floor(F.col("__rank") * (1 << bits) / max(n, 1)).cast("int")
    return placed.select(column, F.least(spread, F.lit((1 << bits) - 1)).alias(f"{column}_code"))


def described(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, source, lang and the curve index, narrow."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    for c in ("source", "lang"):
        rows = rows.join(category_codes(docs.select(F.col(c).cast("string").alias(c)), c, bits), c, "left")
    size_code = F.least(F.floor(F.log2(F.col("size").cast("double")) * 8), F.lit((1 << bits) - 1)).cast("int")
    codes = [F.coalesce("source_code", F.lit(0)), F.coalesce("lang_code", F.lit(0)), size_code]
    return rows.withColumn("curve", hilbert_index(codes, bits)).drop("source_code", "lang_code")


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, source and lang per document."""
    rows = described(docs, bits)
    order = [F.col("curve"), F.col("text_crc32"), F.col("doc_id").asc_nulls_first()]
    placed = ranked(rows, order, "rank", ["curve", "text_crc32", "doc_id"])
    n = docs.count()
    least, more = divmod(n, shards)
    border = more * (least + 1)
    rank = F.col("rank")
    if least:
        number = F.when(rank < border, F.floor(rank / (least + 1))).otherwise(more + F.floor((rank - border) / least))
    else:
        number = rank
    first = F.col("shard") * least + F.least(F.col("shard"), F.lit(more))
    return (
        placed.withColumn("shard", number.cast("int"))
        .withColumn("slot", (F.col("rank") - first).cast("bigint"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            "slot",
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
            "source",
            "lang",
        )
    )


def write_shards(docs: DataFrame, target: str, shards: int = SHARDS) -> None:
    """All columns of ``docs``, one folder per shard, in curve order inside it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    places = shard(docs, shards).groupBy("doc_id", "text_crc32", "source", "lang").agg(
        F.min("shard").alias("shard"), F.min("slot").alias("slot")
    )
    keyed = docs.withColumn("__crc", F.crc32(text.cast("binary")))
    on = (
        F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
        & (F.col("d.__crc") == F.col("p.text_crc32"))
        & F.col("d.source").cast("string").eqNullSafe(F.col("p.source"))
        & F.col("d.lang").cast("string").eqNullSafe(F.col("p.lang"))
    )
    joined = keyed.alias("d").join(places.alias("p"), on).select(*[F.col(f"d.`{c}`") for c in docs.columns], "p.shard", "p.slot")
    (
        joined.repartition("shard", F.floor(F.col("slot") / 100_000))
        .sortWithinPartitions("shard", "slot")
        .drop("slot")
        .write.partitionBy("shard")
        .option("parquet.block.size", str(16 << 20))
        .parquet(target)
    )
