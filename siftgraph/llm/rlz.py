"""Substring dedup by relative Lempel-Ziv factoring.

Every window of 20 words is looked up in an index of all documents. The index is cut
into blocks by anchor: a window is filed under the smallest hash of its 6-word grams, so
two equal windows always meet in one block and a document only visits the blocks that can
hold a match. Anchor hits that copy one place are then joined left and right into factors:
a factor is a maximal run of windows whose sources are consecutive too. There is no greedy
cursor: windows across factor borders are looked up like all others, because each repeated
window is to go, and a parse that jumps over them would keep some. A window's source is the
first copy in its slice or, between slices, the first in the block, not the longest match.

Scale: a map task first removes repeats inside its own slice, so a passage sent by every
document is sent once per slice; a row carries all windows of one anchor, about one row
per eight words, and only factors travel on. Blocks are read as a sorted stream, so
what a block holds is one entry per distinct window of the current anchor. Texts are
shuffled once, packed one by one, to meet their factors.

Windows are compared by an independent 64-bit window hash besides their anchor, of which 64
bits are compared inside a slice and 32 between slices. Removal needs the copied windows only,
so it takes the runs of each anchor as they are; ``factors`` joins them.

Defined cases: null, empty and shorter texts have no window; rows with the same doc_id
and different texts are documents ordered by the crc32 of their text; identical rows have
the same result and none is earlier than the other. A null doc_id comes before all others.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import flat, hash_words, mix, slices, split_words, window_hash

WINDOW = 20  # words
GRAM = 6  # words of an anchor gram
FIRST = -(2**63)  # stands for a null doc_id
_CODEC = pa.Codec("zstd")

INDEX_SCHEMA = "key int, doc bigint, at bigint, local boolean, load binary"
FACTOR_SCHEMA = "doc bigint, crc bigint, start int, n int, src_doc bigint, src_crc bigint, src_start int"
_FACTOR = np.dtype(
    [("n", "<i4"), ("src_doc", "<i8"), ("src_at", "<i8")]
)


def _smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest gram in each run of ``width`` grams."""
    best = np.arange(len(grams))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        have += step
    return best


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where ``new`` is true."""
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new)))


def _copies(key: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """For each window the index of the first equal one before it, or itself."""
    order = np.argsort(mix(key ^ (tag * np.uint64(0x9E3779B97F4A7C15))), kind="stable")
    k, t = key[order], tag[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    heads = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    source = np.empty(len(order), np.int64)
    source[order] = order[heads]
    return source


def _index_slice(batch: pa.RecordBatch, window: int, gram: int) -> pa.RecordBatch | None:
    """Anchor rows of one slice, without windows that repeat inside it, and its own factors."""
    order = pc.sort_indices(batch, sort_keys=[("doc", "ascending"), ("crc", "ascending")])
    batch = batch.take(order)
    doc = batch.column("doc").to_numpy()
    crc = batch.column("crc").to_numpy()
    words = split_words(batch.column("text"))
    n_windows = np.maximum(words.counts - window + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return None
    h = hash_words(words)
    d = np.repeat(np.arange(len(doc)), n_windows)
    start = np.arange(total) - (np.cumsum(n_windows) - n_windows)[d]
    place = words.first[d] + start
    grams = window_hash(h, gram)
    anchor = _smallest(grams, window - gram + 1)[place]
    key = grams[anchor]
    tag = window_hash(h, window, 0xA0761D6478BD642F)[place]
    source = _copies(key, tag)
    # identical rows are one document here: a window is no copy of itself
    copied = (source != np.arange(total)) & ~(
        (doc[d] == doc[d[source]]) & (crc[d] == crc[d[source]]) & (start == start[source])
    )
    at = (crc[d].astype(np.int64) << 32) | start
    joined = (d[1:] == d[:-1]) & (copied[1:] == copied[:-1])
    new = np.ones(total, bool)
    new[1:] = ~joined | np.where(copied[1:], np.diff(source) != 1, anchor[1:] != anchor[:-1])
    begin, length = _runs(new)
    local = copied[begin]
    # windows of the anchors, eight bytes each
    own = begin[~local]
    lengths = length[~local]
    sent = ~np.repeat(local, length)
    tags = tag[sent].tobytes()
    offsets = np.concatenate([[0], np.cumsum(lengths * 8)])
    load = pa.Array.from_buffers(
        pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(tags)]
    )
    mine = begin[local]
    factor = np.zeros(len(mine), _FACTOR)
    src = source[mine]
    factor["n"], factor["src_doc"], factor["src_at"] = length[local], doc[d[src]], at[src]
    size = _FACTOR.itemsize
    packed = pa.Array.from_buffers(
        pa.binary(),
        len(mine),
        [None, pa.py_buffer((np.arange(len(mine) + 1) * size).astype(np.int32)), pa.py_buffer(factor.tobytes())],
    )
    rows = np.concatenate([own, mine])
    keys = np.concatenate([key[own], mix(at[mine].astype(np.uint64) ^ doc[d[mine]].astype(np.uint64))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array((keys >> np.uint64(32)).astype(np.uint32).view(np.int32)),
            pa.array(doc[d[rows]]),
            pa.array(at[rows]),
            pa.array(np.arange(len(rows)) >= len(own)),
            pa.concat_arrays([load, packed]),
        ],
        names=["key", "doc", "at", "local", "load"],
    )


def _index(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = _index_slice(part, window, gram)
            if out is not None:
                yield out

    return run


def _factor_batch(doc, at, n, src_doc, src_at) -> pa.RecordBatch:
    low = np.int64(0xFFFFFFFF)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc),
            pa.array(at >> 32),
            pa.array((at & low).astype(np.int32)),
            pa.array(n.astype(np.int32)),
            pa.array(src_doc),
            pa.array(src_at >> 32),
            pa.array((src_at & low).astype(np.int32)),
        ],
        names=[c.split()[0] for c in FACTOR_SCHEMA.split(", ")],
    )


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows with an earlier copy, per anchor; rows come sorted by (key, doc, at)."""
    empty = np.zeros(0, np.int64)
    seen = (empty.astype(np.uint64), empty.astype(np.uint64), empty, empty)  # firsts of the last key
    for batch in batches:
        local = batch.column("local").to_numpy(zero_copy_only=False)
        key = batch.column("key").to_numpy().view(np.uint32).astype(np.uint64)
        doc, at = batch.column("doc").to_numpy(), batch.column("at").to_numpy()
        if local.any():
            raw, _ = flat_load(batch.column("load"), local)
            f = np.frombuffer(raw, _FACTOR)
            yield _factor_batch(doc[local], at[local], f["n"].copy(), f["src_doc"].copy(), f["src_at"].copy())
        rows = np.flatnonzero(~local)
        if not len(rows):
            continue
        k = key[rows]
        twice = np.zeros(len(rows), bool)
        twice[1:] |= k[1:] == k[:-1]
        twice[:-1] |= k[1:] == k[:-1]
        twice |= k == k[-1]
        if len(seen[0]):
            twice |= k == seen[0][0]
        keep = np.zeros(len(local), bool)
        keep[rows[twice]] = True
        raw, lengths = flat_load(batch.column("load"), keep)
        tags = np.frombuffer(raw, np.uint64)
        sizes = lengths // 8
        r = np.repeat(np.flatnonzero(keep), sizes)
        step = np.arange(len(r)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        olds = len(seen[0])
        wk = np.concatenate([seen[0], key[r]])
        wt = np.concatenate([seen[1], tags])
        wd = np.concatenate([seen[2], doc[r]])
        wa = np.concatenate([seen[3], at[r] + step])
        source = _copies(wk, wt)
        copied = (source != np.arange(len(wk))) & ~((wd == wd[source]) & (wa == wa[source]))
        copied[:olds] = False
        hit = np.flatnonzero(copied)
        if len(hit):
            src = source[hit]
            new = np.ones(len(hit), bool)
            new[1:] = ~(
                (np.diff(hit) == 1)
                & (wd[hit[1:]] == wd[hit[:-1]])
                & (np.diff(wa[hit]) == 1)
                & (wd[src[1:]] == wd[src[:-1]])
                & (np.diff(wa[src]) == 1)
            )
            begin, length = _runs(new)
            yield _factor_batch(wd[hit[begin]], wa[hit[begin]], length, wd[src[begin]], wa[src[begin]])
        first = (source == np.arange(len(wk))) & (wk == k[-1])
        seen = (wk[first], wt[first], wd[first], wa[first])


def flat_load(column: pa.Array, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Joined bytes and lengths of the chosen rows."""
    part = column.filter(pa.array(keep)).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.filter(pa.array(keep))
    if not len(part):
        return b"", np.zeros(0, np.int64)
    _, offsets, data = part.buffers()
    o = np.frombuffer(offsets, np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
    return (data.to_pybytes()[o[0] : o[-1]] if data is not None else b""), np.diff(o)


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, crc, start, n, src_doc, src_crc, src_start): ``n`` windows from word ``start`` on
    copy those from ``src_start`` on of an earlier document, or of the same one further up."""
    return _joined(_copied(docs, window, gram))


def _copied(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of copied windows, cut where the anchor changes; columns of :func:`factors`."""
    texts = _keyed(docs).select("doc", "crc", "text").filter(F.col("text").isNotNull())
    index = texts.mapInArrow(_index(window, gram), INDEX_SCHEMA)
    blocks = index.repartition("key").sortWithinPartitions("key", "doc", "at")
    return blocks.mapInArrow(_match, FACTOR_SCHEMA)


def _joined(runs: DataFrame) -> DataFrame:
    """Runs that touch or overlap and copy the same place as one factor."""
    ident = ["doc", "crc", "src_doc", "src_crc"]
    line = [*ident, (F.col("src_start") - F.col("start")).alias("ahead")]
    along = Window.partitionBy(*ident, "ahead").orderBy("start")
    before = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = (
        runs.select(*line, "start", (F.col("start") + F.col("n")).alias("stop"))
        .withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
        .withColumn("factor", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    )
    whole = marked.groupBy(*ident, "ahead", "factor").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return whole.select(
        "doc", "crc", "start", (F.col("stop") - F.col("start")).alias("n"), "src_doc", "src_crc",
        (F.col("start") + F.col("ahead")).alias("src_start"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("doc"),
        F.shiftright(F.crc32(F.col("text").cast("binary")), 1).alias("crc"),  # 31 bits
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed each on its own; a null has size 0 like the empty text."""
    for part in slices(batches, "text"):
        data, offsets = flat(part.column("text"))
        texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        packed = pa.array([_CODEC.compress(x, asbytes=True) if x else b"" for x in texts], pa.binary())
        columns = [part.column("doc"), part.column("crc"), part.column("doc_id"), pa.array(np.diff(offsets)), packed]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "crc", "doc_id", "size", "packed"])


def _unpacked(packed: bytes, size: int) -> bytes:
    return _CODEC.decompress(packed, int(size), asbytes=True) if size else b""


def _keep(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept, n_words, n_removed = [], [], []
            for text, size, spans in zip(pdf["packed"], pdf["size"], pdf["spans"], strict=True):
                words = _unpacked(text, size).split()
                n_words.append(len(words))
                if spans is None or not len(spans):
                    kept.append(b" ".join(words).decode())
                    n_removed.append(0)
                    continue
                ends = np.zeros(len(words) + 1, np.int32)
                s = np.array([x["start"] for x in spans])
                np.add.at(ends, s, 1)
                np.add.at(ends, s + np.array([x["n"] for x in spans]) + window - 1, -1)
                free = np.cumsum(ends[:-1]) == 0
                kept.append(b" ".join([w for w, ok in zip(words, free, strict=True) if ok]).decode())
                n_removed.append(len(words) - int(free.sum()))
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "n_words": n_words, "n_removed": n_removed, "kept": kept}
            )

    return run


def remove_copies(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words of every document, joined by one space."""
    spans = _copied(docs, window, gram).groupBy("doc", "crc").agg(
        F.collect_list(F.struct("start", "n")).alias("spans")  # at most one per word of the document
    )
    texts = _keyed(docs).mapInArrow(_packed, "doc bigint, crc bigint, doc_id bigint, size bigint, packed binary")
    joined = texts.join(spans, ["doc", "crc"], "left").select("doc_id", "size", "packed", "spans")
    return joined.mapInPandas(_keep(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
