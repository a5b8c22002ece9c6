"""Features that are encoded once and kept over runs.

A cache is a table bucketed by row id with one row per (row id, key), where the key is a hash of
the encoder's name and the row's text. A run encodes only rows whose key the table does not
have yet and appends them in one commit; a run that is cut off appends nothing and is simply
repeated. Readers join by row id and key, without a shuffle of the cache where the other side is
bucketed alike. Rows of earlier texts stay until :func:`compact` drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEY, GENERATION = "feature_key", "generation"


def feature_key(encoder: str, text: str) -> Column:
    """Hash of encoder and text; a null text has a key of its own."""
    return F.md5(F.concat_ws("|", F.lit(encoder), F.coalesce(F.md5(F.col(text)), F.lit("null"))))


def _last_generation(spark: SparkSession, table: str) -> int | None:
    if not spark.catalog.tableExists(table):
        return None
    return spark.table(table).agg(F.max(GENERATION)).first()[0] or 0


def _append(df: DataFrame, table: str, row_id: str, buckets: int, path: str | None, mode: str) -> None:
    writer = df.write.mode(mode).bucketBy(buckets, row_id).sortBy(row_id)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def cached_features(
    rows: DataFrame,
    table: str,
    row_id: str,
    text: str,
    encoder: str,
    encode: Callable[[DataFrame], DataFrame],
    buckets: int = 64,
    path: str | None = None,
) -> tuple[DataFrame, int]:
    """Features of all ``rows``, and how many had to be encoded.

    ``encode`` maps rows to the same rows with feature columns and must keep ``row_id`` and
    the key; it is called on the rows that are new or whose text or encoder changed.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn(KEY, feature_key(encoder, text))
    last = _last_generation(spark, table)
    fresh = keyed
    if last is not None:
        fresh = keyed.join(spark.table(table).select(row_id, KEY), [row_id, KEY], "left_anti")
    encoded = encode(fresh.dropDuplicates([row_id, KEY])).drop(text).withColumn(GENERATION, F.lit((last or 0) + 1))
    seen = Observation("encoded rows")
    _append(encoded.observe(seen, F.count(F.lit(1)).alias("n")), table, row_id, buckets, path, "append")
    spark.catalog.refreshTable(table)
    extra = [c for c in spark.table(table).columns if c not in keyed.columns]
    out = keyed.join(spark.table(table).select(row_id, KEY, *extra), [row_id, KEY])
    return out, seen.get["n"]


def compact(table: str, rows: DataFrame, row_id: str, text: str, encoder: str, target: str, buckets: int = 64, path: str | None = None) -> None:
    """Write the cache's rows that ``rows`` still use to the table ``target``."""
    spark = rows.sparkSession
    used = rows.select(row_id, feature_key(encoder, text).alias(KEY)).distinct()
    _append(spark.table(table).join(used, [row_id, KEY], "left_semi"), target, row_id, buckets, path, "overwrite")
