"""Periodic runs in texts: stretches of words that repeat with a fixed period.

A run is a stretch with smallest period q, at least ``max(LEAST, 2 q)`` words long, that no
neighbouring word extends keeping the period.

Method: recursive frequency splitting. Each word of a run occurs in it at least twice, so a
word that occurs once inside a segment belongs to no run there and splits the segment; the
parts are counted again until nothing splits. Segments below ``LEAST`` words are given up. A
segment that only loses a few words at a time, ``PEELS`` times in a row, goes to the scan as it
is: splitting saves work, the scan is exact on any segment.
The segments that survive are scanned lag by lag: words q apart are compared, and stretches
of matches that are long enough are runs, smaller lags first so that a multiple of a period
is not reported again. Lags up to ``DENSE_LAG`` are scanned in full. Larger ones are taken in
doubling ranges [K, 2K): a run there has K matches in a row, so one of its aligned blocks of
K/2 words equals the block q words further on; only such pairs are extended, and pairs inside
a run already found whose period divides q are left out. So a segment of m words costs about
m log m, not m squared, and no lag is left out.

Scale: one pass without a shuffle; memory is a few times the longest text.

Defined cases: a null or blank text has no words and no runs; a null id is kept; rows with
one id are separate texts; words are compared whole, as bytes. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices, window_hash

LEAST = 12  # words of the shortest run
DENSE_LAG = 16
PEELS = 32
BLANK = "[\\x20\\x09-\\x0D]+"
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of at least ``LEAST`` words in which every word occurs twice or more."""
    whole, todo = [], [(0, len(ids), 0)]
    while todo:
        start, stop, peeled = todo.pop()
        if stop - start < LEAST:
            continue
        _, back, count = np.unique(ids[start:stop], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[back] < 2)
        if not len(rare) or peeled > PEELS:
            whole.append((start, stop))
            continue
        edges = np.concatenate([[-1], rare, [stop - start]]) + start
        for k in np.flatnonzero(np.diff(edges) > LEAST).tolist():
            a, b = int(edges[k]) + 1, int(edges[k + 1])
            todo.append((a, b, peeled + 1 if 8 * (b - a) > 7 * (stop - start) else 0))
    return whole


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of at least ``least`` true values."""
    step = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    starts, ends = step[::2], step[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, compared in doubling pieces."""
    n, done, piece = min(len(a), len(b)), 0, 64
    while done < n:
        diff = np.flatnonzero(a[done : done + piece][: n - done] != b[done : done + piece][: n - done])
        if len(diff):
            return done + int(diff[0])
        done += piece
        piece *= 2
    return n


def _inside(found: dict[tuple[int, int], int], start: np.ndarray, stop: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Whether [start, stop) lies in a found run whose period divides the lag."""
    covered = np.zeros(len(start), bool)
    by_period: dict[int, list[tuple[int, int]]] = {}
    for (a, b), q in found.items():
        by_period.setdefault(q, []).append((a, b))
    for q, spans in by_period.items():
        mine = np.flatnonzero(~covered & (lag % q == 0))
        if not len(mine):
            continue
        # runs of one period overlap by less than it, so starts and ends ascend together
        spans.sort()
        a, b = (np.array(x, np.int64) for x in zip(*spans, strict=True))
        k = np.searchsorted(a, start[mine], side="right") - 1
        covered[mine] = (k >= 0) & (b[np.maximum(k, 0)] >= stop[mine])
    return covered


def _scan(part: np.ndarray) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs of one segment."""
    n = len(part)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(DENSE_LAG, n // 2 + 1)):
        starts, ends = _stretches(part[:-q] == part[q:], max(LEAST, 2 * q) - q)
        for a, b in zip(starts.tolist(), (ends + q).tolist(), strict=True):
            found.setdefault((a, b), q)
    width = DENSE_LAG
    while 2 * width <= n:
        half = width // 2
        h = window_hash(part.astype(np.uint64), half)
        anchor = np.arange(0, len(h) - width, half)
        if not len(anchor):
            break
        # every anchor against the places width .. 2 width - 1 words further on
        pad = np.concatenate([h, ~np.resize(h[-1:], width)])
        far = np.lib.stride_tricks.sliding_window_view(pad, width)[anchor + width]
        row, lag = np.nonzero(far == h[anchor][:, None])
        start, lag = anchor[row], lag + width
        fits = start + lag + half <= n
        start, lag = start[fits], lag[fits]
        new = ~_inside(found, start, start + lag + half, lag)
        start, lag = start[new], lag[new]
        order = np.lexsort((start, lag))
        last_q, last_end = 0, 0
        for a, q in zip(start[order].tolist(), lag[order].tolist(), strict=True):
            if q == last_q and a < last_end:
                continue
            right = a + _reach(part[a:], part[a + q :])
            left = a - _reach(part[:a][::-1], part[: a + q][::-1])
            last_q, last_end = q, right
            if right - left >= q and right - a >= half:
                found.setdefault((left, right + q), q)
        width *= 2
    return found


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    if len(words) < LEAST:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = []
    for start, stop in _segments(ids):
        found += [(start + a, b - a, q) for (a, b), q in _scan(ids[start:stop]).items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words outside the repeats: of each run only the first period stays."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    dropped = np.cumsum(gone) > 0
    return b" ".join(w for w, d in zip(words, dropped) if not d)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        counts, runs, kept = [], [], []
        for text in part.column("text").cast(pa.binary()).to_pylist():
            words = (text or b"").split()  # splits at \x20 and \x09-\x0D only
            here = word_runs(words)
            counts.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in here])
            kept.append(collapse_words(words, here) if here else b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs, and the text without their repeats."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(_find, SCHEMA)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in texts whose id's crc32 ends in 0, the words from one place on repeat.

    With h the crc32 of the id in decimal and g = floor(h / 10), word i >= a becomes word
    a + (i - a) mod p, a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)); such texts are
    joined by blanks. A null id or a text without words is left as it is.
    """
    text, h = F.col("text").cast("string"), F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n, g = F.size(w).cast("bigint"), F.floor(h / 10)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        # the first copy is cut once and repeated, so a long text needs no lookup per word
        head, unit = F.slice(w, F.lit(1), a.cast("int")), F.slice(w, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(head, tail), " ")).otherwise(text)

    planted = F.transform(F.array(words), repeated)[0]
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.when(h % 10 == 0, planted).otherwise(text).alias("text")
    )
