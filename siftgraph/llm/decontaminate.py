"""Benchmark decontamination with SimHash windows.

Every benchmark item has a 128-bit SimHash of its weighted word shingles (weight: how often
a shingle occurs). A document is read through windows of an item's word count; windows
whose fingerprint lies within ``RADIUS`` bits of an item's are candidates, and the exact
weighted Jaccard similarity of the shingles (0.75 or more) decides.

The fingerprints are found by multi-index Hamming blocks: of ``BLOCKS`` equal blocks at
least one differs by at most ``RADIUS // BLOCKS`` bits, so a table of block values within
that distance yields every fingerprint within the radius. At similarity 0.75 two
fingerprints differ by 22 bits on average (standard deviation 4.3), half of the radius.
Windows that share no shingle with an item have similarity 0, so only those around shared
shingles are fingerprinted.

Scale: documents are checked where they are read, in slices; nothing is shuffled and only
findings leave. The benchmark is sent to the tasks in parts of at most ``PART_BYTES`` of
text, one pass over the documents for each, so no broadcast grows with it.

Defined cases: null or empty items and documents match nothing; an item or document with
fewer words than a shingle is one shingle of all its words; a document shorter than an item
is one window; equal items are reported each; repeated rows are judged alike. A null
item_id is reported as null. Extra columns are kept by ``remove_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hash_words, mix, shingles, slices, split_words

SHINGLE = 5
PERCENT = 75
BITS = 128
RADIUS = 44
BLOCKS = 16
PART_BYTES = 4 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = 1 << np.arange(8)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """-1 or 1 per bit of two independent 64-bit hashes of each shingle."""
    both = np.stack([mix(hashes), mix(hashes ^ _STEP)], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    """Packed fingerprints (rows x bytes) of summed signs."""
    return np.packbits(sums > 0, axis=1)


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.int32)


@dataclass
class Items:
    """Benchmark part: shingles, fingerprints and their block tables."""

    ids: list
    n_words: np.ndarray
    hashes: np.ndarray  # shingles of all items
    offsets: np.ndarray
    known: np.ndarray  # distinct shingles, sorted
    owners: np.ndarray  # items of each distinct shingle, joined
    owner_offsets: np.ndarray
    prints: np.ndarray
    near: np.ndarray  # block x byte value x item: within RADIUS // BLOCKS bits

    @classmethod
    def build(cls, ids: list, texts: list[str | None], size: int = SHINGLE) -> Items:
        words = split_words(pa.array(texts, pa.string()), lower=True)
        hashes, offsets = shingles(words, hash_words(words), size)
        item = np.repeat(np.arange(len(ids)), np.diff(offsets))
        pairs = np.unique(np.stack([hashes, item.astype(np.uint64)], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.uint64)
        known, first = np.unique(pairs[:, 0], return_index=True)
        sums = np.zeros((len(ids), BITS), np.int32)
        np.add.at(sums, item, _signs(hashes))
        prints = _prints(sums)
        distance = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
        close = distance <= RADIUS // BLOCKS
        near = np.stack([close[:, prints[:, b]] for b in range(BLOCKS)]) if len(ids) else np.zeros((BLOCKS, 256, 0), bool)
        return cls(
            ids, words.counts, hashes, offsets, known, pairs[:, 1].astype(np.int64), np.append(first, len(pairs)), prints, near
        )

    def within(self, window_prints: np.ndarray, item: int) -> np.ndarray:
        """Distance of each window to the item, or -1 where no block or the whole is too far."""
        found = np.zeros(len(window_prints), bool)
        for b in range(BLOCKS):
            found |= self.near[b, window_prints[:, b], item]
        distance = _POPCOUNT[window_prints ^ self.prints[item]].sum(axis=1)
        return np.where(found & (distance <= RADIUS), distance, -1)


def _similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(sum of minima, sum of maxima) of two shingle multisets."""
    values, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(which[: len(a)], minlength=len(values))
    y = np.bincount(which[len(a) :], minlength=len(values))
    return int(np.minimum(x, y).sum()), int(np.maximum(x, y).sum())


def find_leaks(texts: pa.Array, items: Items, size: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """(row, item, start word, words, similarity, bits) of the best window per row and item."""
    words = split_words(texts, lower=True)
    hashes, offsets = shingles(words, hash_words(words), size)
    if not len(items.known) or not len(hashes):
        return []
    place = np.searchsorted(items.known, hashes)
    place[place == len(items.known)] = 0
    hits = np.flatnonzero(items.known[place] == hashes)
    if not len(hits):
        return []
    fan = np.diff(items.owner_offsets)[place[hits]]
    where = np.repeat(hits, fan)
    step = np.arange(len(where)) - np.repeat(np.cumsum(fan) - fan, fan)
    item = items.owners[np.repeat(items.owner_offsets[place[hits]], fan) + step]
    row = np.searchsorted(offsets, where, side="right") - 1
    order = np.lexsort((where, item, row))
    where, item, row = where[order], item[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    out = []
    borders = [*np.flatnonzero(new), len(row)]
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        r, t = int(row[a]), int(item[a])
        best = _best_window(hashes[offsets[r] : offsets[r + 1]], where[a:b] - offsets[r], int(words.counts[r]), items, t, size, percent)
        if best is not None:
            out.append((r, t, *best))
    return out


def _best_window(own: np.ndarray, at: np.ndarray, n_words: int, items: Items, item: int, size: int, percent: int):
    """Best window of one document for one item, around the shared shingles ``at``."""
    length = min(int(items.n_words[item]), n_words)
    width = max(length - size + 1, 1)  # shingles of a window
    last = len(own) - width
    target = items.hashes[items.offsets[item] : items.offsets[item + 1]]
    # a window with the similarity shares this many shingle places with the item
    need = -(-percent * (width + len(target)) // (100 + percent))
    marks = np.zeros(len(own) + 1, np.int64)
    marks[at + 1] = 1
    shared = np.cumsum(marks)
    starts = np.unique(np.maximum((at[:, None] - np.arange(width)[None, :]).ravel(), 0)) if len(at) * width < 1 << 16 else np.arange(last + 1)
    starts = starts[starts <= last]
    starts = starts[shared[starts + width] - shared[starts] >= need]
    if not len(starts):
        return None
    best = None
    for group in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
        for lo in range(0, len(group), 4096):
            some = group[lo : lo + 4096]
            base = some[0]
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(own[base : some[-1] + width]), axis=0, dtype=np.int32)])
            prints = _prints(sums[some - base + width] - sums[some - base])
            bits = items.within(prints, item)
            for i in np.flatnonzero(bits >= 0):
                s = int(some[i])
                low, high = _similarity(own[s : s + width], target)
                if 100 * low >= percent * high and (best is None or low / high > best[2]):
                    best = (s, length, low / high, int(bits[i]))
    return best


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[Items]:
    """The benchmark as parts of about ``part_bytes`` of text, one at a time."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // part_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        found = rows.filter(part == i).orderBy("item_id", "text").collect()
        yield Items.build([r["item_id"] for r in found], [r["text"] for r in found])


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, start (word), n_words, similarity, hamming: the best window of each document and item."""
    id_type = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id bigint, item_id {id_type}, start bigint, n_words bigint, similarity double, hamming int"
    item_type = None
    out = None
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in benchmark_parts(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                found = find_leaks(part.column("text"), items, size, percent)
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([x[0] for x in found], pa.int64())),
                        pa.array([items.ids[x[1]] for x in found], _ARROW.get(id_type, item_type)),
                        pa.array([x[2] for x in found], pa.int64()),
                        pa.array([x[3] for x in found], pa.int64()),
                        pa.array([x[4] for x in found], pa.float64()),
                        pa.array([x[5] for x in found], pa.int32()),
                    ],
                    names=["doc_id", "item_id", "start", "n_words", "similarity", "hamming"],
                )

        one = texts.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}


def remove_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with their own columns."""
    out = docs
    for items in benchmark_parts(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[x[0] for x in find_leaks(part.column("text"), items, size, percent)]] = False
                yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
