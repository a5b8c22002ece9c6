"""Token ids as Parquet list columns, in document order, and selective reads of them.

The format: one row per document in ascending doc_id, with ``ids`` (list of int),
``n_tokens``, the file's place in the order and any metadata columns asked for. Ids are
dictionary-encoded per row group (at most one vocabulary of entries, 16-bit packed), the
sorted integer columns are delta-encoded where a dictionary does not pay (format version
2); row groups and pages are small and carry a page index, so a range of documents or a
metadata column is read without the ids of the rest.

Scale: texts are range-partitioned by doc_id once and encoded in a stream; positions come
from one sum per file and a running sum inside it, over narrow columns only.

Every distinct white-space word is encoded once per Python worker, without the marks at its
end if the vocabulary always splits there. It splits at white space before merging, so ids
are those of the whole text (tested); for a tokenizer that does not, pass ``by_word=False``.
Words are looked up by 64-bit hashes, which are not confirmed. Texts that name a special token
go to the tokenizer whole, as it is set up; ``special_as_text`` reads such names as plain text.

Defined cases: null and empty texts have the end id alone; a null doc_id comes first;
repeated ids follow each other in the order of their texts' crc32; an empty table writes
no row. Metadata columns that clash with the format's own get the prefix ``meta_``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import shared_folder
from .words import Words, hash_words, slices, split_words

END = 2
ROW_GROUP = 16 << 20  # bytes
PAGE_ROWS = 2_000
KNOWN_WORDS = 2_000_000  # encoded words kept per Python worker, about 40 bytes each
OWN = ("doc_id", "part", "crc", "n_tokens", "ids")
FIRST = -(2**63)

_loaded: dict = {}


class WordEncoder:
    """Ids of words, each encoded once per Python worker and then looked up by its hash."""

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = [] if special_as_text else [t.content for t in added if t.content]
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.lower = one("A") == one("a")
        self.marks = one("ab,!") == one("ab") + one(",!")  # splits between a letter and a mark
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _plain(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, joined ids). Words of letters alone are encoded many at a time: each ends
        with the only word-ending id it has."""
        simple = [k for k, w in enumerate(words) if w.isalpha()] if self.last.any() else []
        sizes, rows = np.zeros(len(words), np.int64), [None] * len(words)
        for lo in range(0, len(simple), 512):
            some = simple[lo : lo + 512]
            ids = np.array(self._plain([" ".join(words[k] for k in some)])[0], np.int32)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(some):
                for k, a, b in zip(some, [0, *stops[:-1]], stops, strict=True):
                    rows[k] = ids[a:b]
        rest = [k for k, r in enumerate(rows) if r is None]
        for k, ids in zip(rest, self._plain([words[k] for k in rest]), strict=True):
            rows[k] = np.array(ids, np.int32)
        sizes[:] = [len(r) for r in rows]
        return sizes, np.concatenate([np.zeros(0, np.int32), *rows])

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``ids``, number of ids) of every word."""
        found, first, which = np.unique(hash_words(words), return_index=True, return_inverse=True)
        if len(self.hashes) + len(found) > KNOWN_WORDS:
            self.forget()
        new = ~np.isin(found, self.hashes, assume_unique=True)
        if new.any():
            raw = words.data.tobytes()
            sizes, ids = self._new([raw[words.starts[i] : words.ends[i]].decode() for i in first[new]])
            hashes = np.concatenate([self.hashes, found[new]])
            order = np.argsort(hashes, kind="stable")
            at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
            self.hashes, self.at = hashes[order], at[order]
            self.sizes = np.concatenate([self.sizes, sizes])[order]
            self.ids = np.concatenate([self.ids, ids])
        place = np.searchsorted(self.hashes, found)
        return self.at[place][which], self.sizes[place][which]


_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True


def part_marks(words: Words) -> Words:
    """Cuts the marks (no apostrophe) off the end of words of Latin letters or digits."""
    cut = words.ends.copy()
    for _ in range(8):
        cut -= (cut > words.starts) & _MARK[words.data[cut - 1]]
    before = np.maximum(cut - 1, words.starts)
    byte, lead = words.data[before], words.data[np.maximum(before - 1, 0)]
    latin = (lead == 0xC3) & (byte >= 0x80) & (byte != 0x97) & (byte != 0xB7) & (before > words.starts)
    two = (cut > words.starts) & (cut < words.ends) & (_ALNUM[byte] | latin)
    pieces = 1 + two.astype(np.int64)
    at = np.cumsum(pieces) - pieces
    starts, ends = np.repeat(words.starts, pieces), np.repeat(words.ends, pieces)
    ends[at[two]] = cut[two]
    starts[at[two] + 1] = cut[two]
    return Words(words.data, starts, ends, np.concatenate([[0], np.cumsum(pieces)])[words.first])


def _named(column: pa.Array, names: list[str]) -> np.ndarray:
    """Which texts hold one of the names in upper or lower case."""
    found = np.zeros(len(column), bool)
    for name in names:
        found |= pc.match_substring(column, name, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
    return found


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate([[0], np.cumsum(sizes)])


def encode(column: pa.Array, path: str, end: int = END, special_as_text: bool = False, by_word: bool = True):
    """(ids of all texts, each followed by ``end``; offsets per text)."""
    if (path, special_as_text) not in _loaded:
        _loaded[path, special_as_text] = WordEncoder(path, special_as_text)
    encoder = _loaded[path, special_as_text]
    if not by_word:
        return _joined([np.array([*ids, end], np.int32) for ids in encoder._plain([x or "" for x in column.to_pylist()])])
    if (named := _named(column, encoder.whole)).any():
        # texts that name a token of the vocabulary in any case are encoded whole, the others by word
        others = pa.array([None if n else t for t, n in zip(column.to_pylist(), named, strict=True)], column.type)
        ids, offsets = encode(others, path, end, special_as_text)
        rows = np.split(ids, offsets[1:-1])
        for i in np.flatnonzero(named):
            rows[i] = np.array([*encoder._plain([column[i].as_py()])[0], end], np.int32)
        return _joined(rows)
    words = split_words(column, lower=encoder.lower)
    words = part_marks(words) if encoder.marks and len(words.starts) else words
    at, sizes = encoder.look_up(words)
    # an end after each text's words
    begin = np.insert(at, words.first[1:], len(encoder.ids))
    take = np.insert(sizes, words.first[1:], 1)
    stops = np.cumsum(take)
    source = np.append(encoder.ids, np.int32(end))
    ids = source[np.repeat(begin - (stops - take), take) + np.arange(stops[-1] if len(stops) else 0)]
    ends = words.first[1:] + np.arange(1, len(words.first))  # words and ends up to each text
    return ids, np.concatenate([[0], stops[ends - 1]]) if len(ends) else np.zeros(1, np.int64)


def _encoder(path: str, end: int, special_as_text: bool, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, offsets = encode(part.column("text"), path, end, special_as_text, by_word)
            names = [n for n in part.schema.names if n != "text"]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.array(np.diff(offsets)), lists],
                names=[*names, "n_tokens", "ids"],
            )

    return run


def write_tokens(
    docs: DataFrame,
    target: str,
    tokenizer: str,
    end: int = END,
    metadata: Sequence[str] = (),
    special_as_text: bool = False,
    by_word: bool = True,
    row_group: int = ROW_GROUP,
) -> None:
    """Encode all texts and write them below ``target``."""
    extra = [F.col(f"`{c}`").alias(f"meta_{c}" if c in OWN or c == "text" else c) for c in metadata]
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.crc32(text.cast("binary")).alias("crc"), *extra, text.alias("text")
    )
    ordered = rows.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "crc")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name != "text")
    encoded = ordered.mapInArrow(
        _encoder(tokenizer, end, special_as_text, by_word), f"{schema}, n_tokens bigint, ids array<int>"
    )
    (
        encoded.write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(target)
    )


def read_tokens(spark: SparkSession, target: str, columns: Sequence[str] = ("doc_id", "ids")) -> DataFrame:
    """Chosen columns; filters on doc_id skip row groups and pages."""
    return spark.read.parquet(target).select(*columns)


def positions(spark: SparkSession, target: str, rows: DataFrame | None = None) -> DataFrame:
    """Adds ``start``, the number of ids of all documents before, to rows of the files.

    ``rows`` has doc_id, part, crc, n_tokens and what else is wanted; by default just these.
    """
    meta = read_tokens(spark, target, ("doc_id", "part", "crc", "n_tokens"))
    files = meta.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(FIRST))).alias("lo"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition written
    base = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "crc").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return (meta if rows is None else rows).join(base, "part").withColumn("start", start).drop("base")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        ids = part.column("ids")
        at = np.asarray(ids.offsets, np.int64)
        raw = np.asarray(ids.values, "<u4")
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("part"), part.column("crc"), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "crc", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the ids in the files."""
    ids = read_tokens(spark, target, ("doc_id", "part", "crc", "ids"))
    sums = ids.mapInArrow(_checksums, "doc_id bigint, part int, crc bigint, n_tokens bigint, ids_crc32 bigint")
    return positions(spark, target, sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def encode_and_index(docs: DataFrame, tokenizer: str, end: int = END, metadata: Sequence[str] = ()) -> DataFrame:
    """Write the files to a new shared folder and return their index."""
    target = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, target, tokenizer, end, metadata)
    return token_index(docs.sparkSession, target)
