"""Words, 64-bit hashes and bounded slices of Arrow text columns, as numpy arrays.

A text column is handled as one byte array with offsets, so a batch costs a few numpy
passes and no Python object per word. Words are maximal runs outside ``\\x20\\x09-\\x0D``;
in UTF-8 these bytes never occur inside a longer code point, so bytes are exact.
Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # text bytes handled at once; one longer document is handled alone
LONG_WORD = 128  # bytes; longer words are hashed one by one

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (published murmur constants)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of ``text``, on row borders."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Words of a slice: byte ranges in ``data``, and ``first[d]:first[d + 1]`` per document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """Document index of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """``lower`` maps A-Z only."""
    data, offsets = flat(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    final = inside.copy()
    final[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(final) + 1
    if lower:
        data = _LOWER[data]
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def hash_words(words: Words) -> np.ndarray:
    """64-bit hash of every word, eight bytes at a time."""
    size = words.ends - words.starts
    padded = np.zeros(len(words.data) + 8, np.uint8)
    padded[: len(words.data)] = words.data
    eight = np.ndarray(len(words.data) + 1, np.dtype("<u8"), padded, 0, (1,))
    h = mix(size.astype(np.uint64) * _TWO)
    todo, at, left = None, words.starts, size
    long = np.flatnonzero(size > LONG_WORD)
    for _ in range(LONG_WORD // 8 + 1):
        lane = eight[at]
        short = left < 8
        if short.any():
            keep = (np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)
            lane = np.where(short, lane & keep, lane)
        if todo is None:
            h = mix((h ^ lane) * _ONE)
            todo = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        else:
            h[todo] = mix((h[todo] ^ lane) * _ONE)
            todo = todo[left > 8]
        if not len(todo):
            break
        done = int(_ + 1) * 8
        at, left = words.starts[todo] + done, size[todo] - done
    for i in long:
        digest = hashlib.blake2b(words.data[words.starts[i] : words.ends[i]].tobytes(), digest_size=8)
        h[i] = np.uint64(int.from_bytes(digest.digest(), "little"))
    return h


def window_hash(h: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """Order-dependent hash of every run of ``n`` values (``len(h) - n + 1`` of them)."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    power, width, have = h, 1, None
    have_width = 0
    while True:
        if n & width:
            if have is None:
                have, have_width = power, width
            else:
                scale = np.uint64(pow(base, width, 1 << 64))
                m = len(h) - have_width - width + 1
                have = have[:m] * scale + power[have_width : have_width + m]
                have_width += width
        if width * 2 > n:
            break
        scale = np.uint64(pow(base, width, 1 << 64))
        m = len(power) - width
        power = power[:m] * scale + power[width : width + m]
        width *= 2
    return mix(have[:total])


def shingles(words: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets per document) of all n-word shingles, repeats included.

    A document with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = words.counts
    full = window_hash(h, n)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(counts)), sizes)
    place = np.arange(offsets[-1]) - offsets[doc] + words.first[doc]
    short = counts[doc] < n
    out = np.zeros(offsets[-1], np.uint64)
    out[~short] = full[place[~short]] if len(full) else 0
    for i in np.flatnonzero(short):
        d = doc[i]
        part = h[words.first[d] : words.first[d + 1]]
        out[i] = window_hash(part, len(part))[0] ^ np.uint64(len(part))
    return out, offsets
