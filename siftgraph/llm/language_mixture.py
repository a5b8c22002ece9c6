"""Language identification by expectation-maximisation over a mixture of languages.

A document is a mixture: each word is of one language, with the likelihood of its letter
trigrams there. EM estimates the share of every language; language sets of growing size
(largest shares first) are fitted again and the one with the best penalised likelihood
(half a log of the word count per further language) is kept.

Scale: trigram counts are summed per task, then by Spark; the model is ``BUCKETS`` floats
per language, whatever the corpus, and documents are scored where they are read, in slices.
Texts are never shuffled.

Defined cases: no letter, null or empty text, or nothing to learn from give ``und`` with
score 0; ties go to the language first in alphabetical order; a null doc_id is neither
learned from nor held out; repeated rows are scored alike. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import flat, slices

BUCKETS = 1 << 15  # hashed trigrams
SMOOTH = 0.5
ROUNDS = 12  # EM steps over all languages
REFIT_ROUNDS = 8  # EM steps of one language set
MAX_LANGUAGES = 4  # largest language set that is fitted

_CLASS = np.arange(256, dtype=np.uint8)  # letters and bytes of longer code points; the rest ends a word
_CLASS[:128] = 0
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every letter byte, first byte of every word in it, document of every word)."""
    data, offsets = flat(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    c = _CLASS[data]
    if len(c) > 1:  # capital letters of the Latin-1 block differ from small ones by 0x20
        capital = (c[:-1] == 0xC3) & (c[1:] >= 0x80) & (c[1:] <= 0x9E) & (c[1:] != 0x97)
        c[1:][capital] += 0x20
    starts = offsets[:-1][np.diff(offsets) > 0]
    before = np.zeros_like(c)
    before[1:] = c[:-1]
    before[starts] = 0
    after = np.zeros_like(c)
    after[:-1] = c[1:]
    after[starts[1:] - 1] = 0
    letter = np.flatnonzero(c)
    code = before[letter].astype(np.uint32)
    code = (code << np.uint32(8)) | c[letter]
    code = (code << np.uint32(8)) | after[letter]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    words = np.flatnonzero(before[letter] == 0)
    doc = np.searchsorted(offsets, letter[words], side="right") - 1
    return code.astype(np.int64), words, doc


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    for part in slices(batches, "text"):
        langs = part.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            mine = part.column("text").filter(pa.array([x == lang for x in langs]))
            total[lang] += np.bincount(trigrams(mine)[0], minlength=BUCKETS)
    for lang, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])],
            names=["lang", "bucket", "n"],
        )


def remainder(doc_id, by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(by))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (language x bucket) from (text, lang)."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.dropna().mapInArrow(_count, "lang string, bucket int, n bigint")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    langs = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((len(langs), BUCKETS))
    if langs:
        at = found.column("lang").combine_chunks().dictionary_encode()
        names = {x: i for i, x in enumerate(langs)}
        to = np.array([names[x] for x in at.dictionary.to_pylist()])
        table[to[at.indices.to_numpy()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    table += SMOOTH
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums between the borders ``first`` (all segments hold at least one row)."""
    return np.add.reduceat(values, first, axis=0)


def fit_mixture(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over words: (shares per document, log-likelihood per document).

    ``like`` holds word likelihoods scaled by the word's best language, ``first`` the
    first word of each document, ``allowed`` the languages each document may use.
    """
    sizes = np.diff(np.append(first, len(like)))
    owner = np.repeat(np.arange(len(first)), sizes)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    share = share.astype(np.float32)
    for _ in range(rounds):
        part = like * share[owner]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        new = _segment_sums(part, first) / sizes[:, None]
        moved = np.abs(new - share).max()
        share = new.astype(np.float32)
        if moved < 1e-3:
            break
    total = np.log(np.maximum((like * share[owner]).sum(axis=1), 1e-30))
    return share, _segment_sums(total.astype(np.float64), first)


def mixtures(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """Language shares of every text (texts x languages); all zero without letters."""
    n, k = len(column), len(model)
    out = np.zeros((n, k), np.float32)
    bucket, words, doc = trigrams(column)
    if not len(words) or not k:
        return out
    log_like = np.stack([np.add.reduceat(model[j][bucket], words) for j in range(k)], axis=1)
    best = log_like.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(log_like - best, -60.0))
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    which = doc[first]
    sizes = np.diff(np.append(first, len(doc)))
    single = _segment_sums((log_like - best).astype(np.float64), first)
    top = single.argmax(axis=1)
    chosen = np.zeros((len(first), k), np.float32)
    chosen[np.arange(len(first)), top] = 1
    penalty = 0.5 * np.log(np.maximum(sizes, 2)) + 1
    score = single.max(axis=1)
    # a mixture cannot gain more than every word taking its best language
    open_ = np.flatnonzero(-score > penalty) if k > 1 else np.zeros(0, np.int64)
    if len(open_):
        take = np.repeat(np.isin(np.arange(len(first)), open_), sizes)
        sub, sub_first = like[take], np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
        share, _ = fit_mixture(sub, sub_first, np.ones((len(open_), k), np.float32), ROUNDS)
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
        todo = np.arange(len(open_))
        for size in range(2, min(k, MAX_LANGUAGES) + 1):
            take = np.repeat(np.isin(np.arange(len(open_)), todo), sizes[open_])
            starts = np.concatenate([[0], np.cumsum(sizes[open_[todo]])[:-1]])
            fitted, like_of = fit_mixture(sub[take], starts, (rank[todo] < size).astype(np.float32), REFIT_ROUNDS)
            at = open_[todo]
            value = like_of - (size - 1) * penalty[at]
            better = value > score[at]
            chosen[at[better]] = fitted[better]
            score[at[better]] = value[better]
            todo = todo[better]
            if not len(todo):
                break
    out[which] = chosen
    return out


def _has_letter(column: pa.Array) -> np.ndarray:
    """Any letter of any script."""
    ascii_ = pc.match_substring_regex(column.cast(pa.large_string()), "[A-Za-z]").fill_null(False)
    found = ascii_.to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~found):
        found[i] = any(ch.isalpha() for ch in column[i].as_py() or "")
    return found


SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>"


def decided(text: pa.Array, langs: list[str], model: np.ndarray) -> np.ndarray:
    """Language shares of every text; all 0 where the language is ``und``."""
    share = mixtures(text, model)
    known = _has_letter(text) & (len(langs) > 0)
    lost = known & (share.sum(axis=1) == 0)  # letters the trigrams do not see
    share[~known] = 0
    if len(langs):
        share[lost, 0] = 1
    return share


def _predict(langs: list[str], model: np.ndarray):
    names = np.array([*langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text = part.column("text")
            share = decided(text, langs, model)
            known = share.sum(axis=1) > 0
            best = np.where(known, share.argmax(axis=1) if len(langs) else 0, len(langs))
            value = np.clip(share.max(axis=1), 0, 1) if len(langs) else np.zeros(len(known))
            used = [[(langs[j], float(row[j])) for j in np.argsort(-row, kind="stable") if row[j] > 0] for row in share]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(value.astype(np.float64)),
                    pa.array([[a for a, _ in x] for x in used], pa.list_(pa.string())),
                    pa.array([[b for _, b in x] for x in used], pa.list_(pa.float64())),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return run


def identify(docs: DataFrame, train: DataFrame, held_out=None) -> DataFrame:
    """Predicted language, its share and the whole mixture of every row of ``docs``.

    ``train`` has (text, lang). ``held_out`` is a boolean column to pass on.
    """
    langs, model = learn(train)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_predict(langs, model), SCHEMA)


LEAST_SHARE = 0.5


def keep_identified(docs: DataFrame, train: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Rows of ``docs`` with letters and one language of at least that share, with their own columns."""
    langs, model = learn(train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            share = decided(part.column("text"), langs, model)
            sure = share.max(axis=1) >= least if len(langs) else np.zeros(part.num_rows, bool)
            yield part.filter(pa.array(sure))

    return docs.mapInArrow(run, docs.schema)
