"""Intermediate tables in the shared folder, and ordered blocks of document ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, stored  # noqa: F401

BLOCK_BYTES = 4 << 20
MOST_BLOCKS = 20_000  # borders and first ids that the driver holds
FIRST = -(2**63)  # order of a null id


def block_borders(docs: DataFrame, bytes_each: int = BLOCK_BYTES) -> list[int]:
    """Ids that cut ``docs`` (doc_id, text) into blocks of about equal row counts; ascending."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    n = min(MOST_BLOCKS, max(1, -(-(size[0] or 0) // bytes_each)))
    if n == 1 or not size[1]:
        return []
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    return sorted({int(x) for x in cuts})


def block_numbers(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, ids.fill_null(FIRST).to_numpy(), side="right").astype(np.int32)


def _deal(borders: list[int], copies: dict[int, list[int]] | None):
    cuts = np.array(borders, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(FIRST).to_numpy()
            block = block_numbers(batch.column("doc_id"), cuts)
            names = [*batch.schema.names, "block", "ahead"]
            own = [*batch.columns, pa.array(block), pa.array(np.zeros(len(ids), bool))]
            yield pa.RecordBatch.from_arrays(own, names=names)
            if copies is None:
                continue
            for i in np.flatnonzero(np.isin(ids, list(copies))):
                for to in copies[int(ids[i])]:
                    row = batch.slice(int(i), 1)
                    yield pa.RecordBatch.from_arrays(
                        [*row.columns, pa.array([to], pa.int32()), pa.array([True])], names=names
                    )

    return run


def deal_rows(docs: DataFrame, borders: list[int]) -> DataFrame:
    """Adds ``block``, the place of each row's id among the borders; nothing is shuffled."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", block int, ahead boolean"
    return docs.mapInArrow(_deal(borders, None), schema).drop("ahead")


def consecutive_blocks(docs: DataFrame, bytes_each: int = BLOCK_BYTES) -> DataFrame:
    """Rows of (doc_id, crc, text) sorted inside blocks of consecutive ids.

    Each block ends with a copy (``ahead``) of the row after it; the last block with one of
    the very first row. One shuffle; the driver holds two numbers a block.
    """
    borders = block_borders(docs, bytes_each)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", block int, ahead boolean"
    ids = docs.select("doc_id").mapInArrow(_deal(borders, None), "doc_id bigint, block int, ahead boolean")
    heads = sorted(
        (r.block, r.head)
        for r in ids.groupBy("block").agg(F.min(F.coalesce("doc_id", F.lit(FIRST))).alias("head")).collect()
    )
    copies: dict[int, list[int]] = {}
    for i, (block, _) in enumerate(heads):
        copies.setdefault(heads[(i + 1) % len(heads)][1], []).append(block)
    dealt = docs.mapInArrow(_deal(borders, copies), schema)
    return dealt.repartition("block").sortWithinPartitions("block", "ahead", F.col("doc_id").asc_nulls_first(), "crc")
