"""Fill-in-the-middle transformation of texts, and its inverse.

A text is cut into units (white space with the word after it; white space that ends the
text is one more unit). Two cuts, drawn from a hash of the seed and the id, give prefix,
middle and suffix, which are reordered around three markers so that a left-to-right model
learns to fill gaps.

Method: a slice of texts is one UTF-8 buffer viewed as 64-bit words. A byte ends a unit if it
is no white space and the byte after it is, or if it is the last byte of its text. The eight
bytes of a word are tested at once by carry-free arithmetic, which leaves one mark bit per
unit end; ``bitwise_count`` gives the units of a word and a prefix sum their rank. The byte
of the k-th unit end is found by a search in the prefix sums and then inside one word by
clearing its lowest marks. No unit becomes a Python object.

Scale: one pass without a shuffle; memory is a few times a slice of ``SLICE_BYTES`` or the
longest text. ``restored`` is JVM expressions.

Defined cases: a null text is empty; an empty text, or one with a marker in it, stays as it
is (form ``plain``, character counts null); a null id is hashed as no digits. Rows with one
id are cut alike. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import flat, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

_LANES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_FROM_TAB = _LANES * np.uint64(0x80 - 0x09)
_PAST_RETURN = _LANES * np.uint64(0x80 - 0x0E)
_BLANKS = _LANES * np.uint64(0x20)
_ONE = np.uint64(1)


def space_marks(x: np.ndarray) -> np.ndarray:
    """High bit of every byte of ``x`` that is 0x20 or 0x09 to 0x0D; the sums stay inside a byte."""
    low = x & _LOW7
    control = (low + _FROM_TAB) & ~(low + _PAST_RETURN)
    other = ((low ^ _BLANKS) + _LOW7) | x  # high bit unless the byte is 0x20
    return (control & ~x | ~other) & _HIGH


class UnitEnds:
    """Rank and select over the bytes that end a unit, for all texts of a buffer."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = len(data) // 8 + 1
        padded = np.full(words * 8, 0x20, np.uint8)
        padded[: len(data)] = data
        spaces = space_marks(padded.view("<u8"))
        following = spaces >> np.uint64(8)
        following[:-1] |= spaces[1:] << np.uint64(56)
        self.marks = following & ~spaces & _HIGH
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        bits = np.uint64(0x80) << ((last & 7) * 8).astype(np.uint64)
        np.bitwise_or.at(self.marks, last >> 3, bits)
        self.until = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Unit ends before byte ``at``."""
        word, lane = at >> 3, (at & 7).astype(np.uint64)
        before = self.marks[word] & ((_ONE << (lane * np.uint64(8))) - _ONE)
        return self.until[word] + np.bitwise_count(before)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the ``k``-th unit end, counted from 1."""
        word = np.searchsorted(self.until, k, side="left") - 1
        left = self.marks[word].copy()
        skip = k - self.until[word] - 1
        for done in range(7):
            todo = skip > done
            if not todo.any():
                break
            left[todo] &= left[todo] - _ONE
        lowest = left & (~left + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def _cut(seed: int, fim_percent: int, spm_percent: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p_mark, s_mark, m_mark = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = flat(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            ends = UnitEnds(data, offsets)
            first = ends.rank(offsets[:-1])
            n = ends.rank(offsets[1:]) - first
            h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
            cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
            at = np.repeat(offsets[:-1, None], 2, axis=1)
            inside = cuts > 0
            at[inside] = ends.select((first[:, None] + cuts)[inside]) + 1
            whole = data.tobytes()
            form, output, chars = [], [], []
            for d in range(len(ids)):
                start, stop = int(offsets[d]), int(offsets[d + 1])
                text = whole[start:stop]
                if not text or h[d, 2] % 100 >= fim_percent or any(m in text for m in marks):
                    form.append("plain")
                    output.append(text)
                    chars.append((None, None))
                    continue
                a, b = int(at[d, 0]) - start, int(at[d, 1]) - start
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                chars.append((len(prefix.decode()), len(middle.decode())))
                if h[d, 3] % 100 < spm_percent:
                    form.append("spm")
                    output.append(b"".join((s_mark, suffix, p_mark, prefix, m_mark, middle)))
                else:
                    form.append("psm")
                    output.append(b"".join((p_mark, prefix, s_mark, suffix, m_mark, middle)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(n.astype(np.int64)),
                    pa.array(form, pa.string()),
                    pa.array([c[0] for c in chars], pa.int64()),
                    pa.array([c[1] for c in chars], pa.int64()),
                    pa.array(output, pa.binary()).cast(pa.string()),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return run


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output) of every row.

    ``fim_percent`` of the texts are reordered, ``spm_percent`` of those with the suffix first.
    """
    if not (0 <= fim_percent <= 100 and 0 <= spm_percent <= 100):
        raise ValueError("percentages lie between 0 and 100")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(_cut(seed, fim_percent, spm_percent), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone.

    Texts with a marker are never reordered, so each marker of a reordered output occurs once.
    """

    def after(mark: str) -> Column:
        return F.locate(mark, output) + len(mark)

    def until(start: Column, mark: str) -> Column:
        return output.substr(start, F.locate(mark, output) - start)

    tail = output.substr(after(MIDDLE), F.length(output))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(until(after(PREFIX), SUFFIX), tail, until(after(SUFFIX), MIDDLE)))
        .when(form == "spm", F.concat(until(after(PREFIX), MIDDLE), tail, until(after(SUFFIX), PREFIX)))
    )
