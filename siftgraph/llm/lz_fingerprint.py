"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each the longest known phrase and one more
byte); the phrases are hashed, and the smallest hash in each of ``PLACES`` classes is the
fingerprint. The share of equal places estimates the overlap of the phrase sets, which
follows how much one text helps to compress the other.

``edited_fingerprints`` compares each document with its edited text and with the next
document. Scale: documents are dealt to blocks of consecutive ids, each with a copy of the
document that follows it, so one shuffle of the texts brings every neighbour along; a block
is read as a stream. The parse of the part that text and edited text share is done once.

Defined cases: null counts as empty text; an empty text has no phrase and the fingerprint of
zeros, alike (1) only to another such; a null doc_id comes first; rows with one doc_id follow
each other in the order of their texts' crc32; a single document is its own next. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import consecutive_blocks
from .words import Words, hash_words, slices

PLACES = 64  # 16-bit values of a fingerprint
_LOW = np.uint64(0xFFFF)


def parse(data: bytes, trie: dict[int, int], node: int, shift: int, added: list[int] | None = None) -> tuple[list[int], int]:
    """(ends of the phrases in ``data``, open node); ``trie`` maps (node, byte) to node."""
    ends = []
    n = len(trie)
    for i, c in enumerate(data, shift + 1):
        key = node << 8 | c
        node = trie.get(key, 0)
        if not node:
            n += 1
            trie[key] = n
            ends.append(i)
            if added is not None:
                added.append(key)
    return ends, node


def phrase_ends(whole: bytes, shared: int, other_tail: bytes) -> tuple[list[int], list[int]]:
    """Phrase ends of ``whole`` and of its first ``shared`` bytes with another tail."""
    trie: dict[int, int] = {}
    head, node = parse(whole[:shared], trie, 0, 0)
    added: list[int] = []
    tail, _ = parse(whole[shared:], trie, node, shared, added)
    for key in added:
        del trie[key]
    other, _ = parse(other_tail, trie, node, shared)
    return head + tail, head + other


def fingerprints(texts: list[bytes], ends: list[list[int]]) -> np.ndarray:
    """Smallest phrase hash per class and text (texts x PLACES, uint16, 0 for no phrase)."""
    sizes = np.array([len(e) for e in ends], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(len(texts) * PLACES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    if first[-1]:
        base = np.cumsum([0, *map(len, texts)])[:-1]
        stops = np.concatenate([np.array(e, np.int64) for e in ends])
        starts = np.zeros_like(stops)
        starts[1:] = stops[:-1]
        starts[first[:-1][sizes > 0]] = 0
        shift = np.repeat(base, sizes)
        words = Words(np.frombuffer(b"".join(texts), np.uint8), starts + shift, stops + shift, first)
        h = hash_words(words)
        place = (h % np.uint64(PLACES)).astype(np.int64) + np.repeat(np.arange(len(texts)) * PLACES, sizes)
        np.minimum.at(out, place, h)
    value = (out >> np.uint64(16)) & _LOW
    value[value == 0] = 1
    value[out == np.uint64(0xFFFFFFFFFFFFFFFF)] = 0
    return value.astype(">u2").reshape(len(texts), PLACES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places among those that either text fills; 1 if neither fills any."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, ahead, doc, crc); ``ahead`` marks the copy that ends a block."""
    held = None  # (block, doc_id, text, ahead) that waits for its next document
    for part in slices(batches, "text"):
        rows = list(
            zip(
                part.column("block").to_pylist(),
                part.column("doc_id").to_pylist(),
                (x or "" for x in part.column("text").to_pylist()),
                part.column("ahead").to_pylist(),
                strict=True,
            )
        )
        ready = []
        for row in rows:
            if held is not None and held[0] == row[0] and not held[3]:
                ready.append((held[1], held[2], row[2]))
            held = row
        if not ready:
            continue
        texts, edited, ends, edited_ends = [], [], [], []
        for _, text, following in ready:
            cut = len(text) // 4
            keep = text[: len(text) - cut].encode()
            tail = following[:cut].encode()
            whole = text.encode()
            a, b = phrase_ends(whole, len(keep), tail)
            texts.append(whole)
            edited.append(keep + tail)
            ends.append(a)
            edited_ends.append(b)
        # the last one's next document is not parsed yet
        last = ready[-1][2].encode()
        mine = fingerprints([*texts, last], [*ends, parse(last, {}, 0, 0)[0]])
        # inside the slice the next ready row may belong to the next block
        following = np.array([i + 1 if i + 1 == len(ready) or ready[i][2] is ready[i + 1][1] else -1 for i in range(len(ready))])
        apart = np.flatnonzero(following < 0)
        if len(apart):
            other = [ready[i][2].encode() for i in apart]
            extra = fingerprints(other, [parse(x, {}, 0, 0)[0] for x in other])
            mine = np.concatenate([mine, extra])
            following[apart] = len(ready) + 1 + np.arange(len(apart))
        changed = fingerprints(edited, edited_ends)
        own = mine[: len(ready)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in ready], pa.int64()),
                pa.array([len(x[1]) for x in ready], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                pa.array([x.tobytes().hex() for x in own]),
                pa.array([x.tobytes().hex() for x in changed]),
                pa.array(likeness(own, changed)),
                pa.array(likeness(own, mine[following])),
            ],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))
    return consecutive_blocks(keyed).mapInArrow(_pairs, SCHEMA)
