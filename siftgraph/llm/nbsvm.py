"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators are hashed byte trigrams, and which share of the words repeats the word one,
two or three places before (a repeated n-gram, whatever its words). They are scaled by the smoothed log-count ratio of the two classes and by the row's length; a
linear hinge-loss model is fitted to them by dual coordinate descent, and its margins are
turned into probabilities by a logistic curve fitted on rows the descent did not see.

Scale: the fit takes at most ``FIT_ROWS`` labelled rows, those with the smallest hash of
their id; their ids are joined to the texts by a broadcast of that many rows, so no text is
shuffled, and one task fits. All rows are scored where they are read.

Defined cases: null counts as empty text; an empty text has no indicator and gets the
curve's value at margin zero; without labels of both classes every score is the share of
label 1, or 0.5 without labels; a null doc_id is scored but never learned from; repeated
label rows count once, by the smallest label. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import flat, hash_words, slices, split_words

GRAMS = 1 << 16  # hashed byte trigrams
LAGS = (1, 2, 3)  # a word equal to the one 1, 2 or 3 before: repeated word n-grams of any word
SHARES = 8  # indicators per lag, one for each eighth of the words
BUCKETS = GRAMS + len(LAGS) * SHARES
FIT_ROWS = 16_000
CALIBRATE = 5  # every fifth row is kept for the curve
EPOCHS = 12
PENALTY = 1.0  # hinge-loss weight C
SMOOTH = 1.0
DOCS_AT_ONCE = 256


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every text, as one array with offsets."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    repeats = _repeats(column)
    found, sizes = [], np.zeros(n, np.int64)
    for lo in range(0, n, DOCS_AT_ONCE):
        hi = min(n, lo + DOCS_AT_ONCE)
        part, at = data[offsets[lo] : offsets[hi]].astype(np.uint32), offsets[lo : hi + 1] - offsets[lo]
        if not len(part):
            continue
        starts = at[:-1][np.diff(at) > 0]
        before, after = np.zeros_like(part), np.zeros_like(part)
        before[1:], after[:-1] = part[:-1], part[1:]
        before[starts] = 0
        after[starts[1:] - 1] = 0
        code = ((before << np.uint32(16)) | (part << np.uint32(8)) | after) * np.uint32(0x9E3779B1)
        doc = np.repeat(np.arange(hi - lo), np.diff(at))
        seen = np.zeros((hi - lo) * BUCKETS, bool)
        seen[doc * BUCKETS + (code >> np.uint32(16))] = True
        for k, eighth in enumerate(repeats[:, lo:hi]):
            some = np.flatnonzero(eighth)
            seen[some * BUCKETS + GRAMS + k * SHARES + eighth[some] - 1] = True
        keys = np.flatnonzero(seen)
        found.append((keys % BUCKETS).astype(np.int32))
        sizes[lo:hi] = np.bincount(keys // BUCKETS, minlength=hi - lo)
    joined = np.concatenate(found) if found else np.zeros(0, np.int32)
    return joined, np.concatenate([[0], np.cumsum(sizes)])


def _repeats(column: pa.Array) -> np.ndarray:
    """Per lag and text: 0 without a repeat, else the eighth its share of the words falls in (1..8)."""
    words = split_words(column)
    h, doc = hash_words(words), words.document()
    out = np.zeros((len(LAGS), len(column)), np.int64)
    for k, lag in enumerate(LAGS):
        again = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
        n = np.bincount(doc[lag:][again], minlength=len(column))
        share = np.ceil(n * SHARES / np.maximum(words.counts, 1)).astype(np.int64)
        out[k] = np.minimum(share, SHARES)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        values, offsets = indicators(part.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("label"), lists], names=["doc_id", "label", "grams"]
        )


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Per bucket: log of its smoothed share among label 1 over that among label 0."""
    counts = np.full((2, BUCKETS), SMOOTH)
    for x, y in zip(rows, label, strict=True):
        counts[y, x] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float, epochs: int) -> np.ndarray:
    """Weights of the L1-loss support vector machine; the last weight is the bias."""
    w = np.zeros(BUCKETS + 1)
    alpha = np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[x] += step * v
                w[-1] += step
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w


def logistic_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with smoothed targets so that it stays finite."""
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (target - p))
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Model as one array: trigram weights, bias, curve slope, curve intercept."""
    model = np.zeros(BUCKETS + 3)
    if not len(label) or label.min() == label.max():
        share = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        model[-1] = np.log(share / (1 - share))
        return model
    late = np.arange(len(rows)) % CALIBRATE == CALIBRATE - 1
    if len(set(label[~late])) < 2 or len(set(label[late])) < 2:
        late = np.zeros(len(rows), bool)
    ratio = log_count_ratio([x for x, l in zip(rows, late, strict=True) if not l], label[~late])
    values = []
    for x in rows:
        v = ratio[x]
        values.append(v / max(np.sqrt(v @ v), 1e-12))
    early = np.flatnonzero(~late)
    w = dual_descent([rows[i] for i in early], [values[i] for i in early], 2.0 * label[early] - 1, PENALTY, EPOCHS)
    held = np.flatnonzero(late) if late.any() else early
    margin = np.array([w[rows[i]] @ values[i] + w[-1] for i in held])
    slope, intercept = logistic_curve(margin, label[held])
    model[:BUCKETS] = w[:-1] * ratio
    model[BUCKETS:] = w[-1], slope, intercept
    return np.concatenate([model, ratio * ratio])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, label, ids = [], [], []
    for part in batches:
        ids += part.column("doc_id").to_pylist()
        label += part.column("label").to_pylist()
        rows += [np.array(x.values) for x in part.column("grams")]
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    model = fit([rows[i] for i in order], np.array(label, np.int64)[order])
    yield pa.RecordBatch.from_arrays([pa.array([model.tolist()], pa.list_(pa.float64()))], names=["model"])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Model from (doc_id, text) and (doc_id, label 0 or 1)."""
    ids = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"))
        .dropna()
        .filter("label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(ids), "doc_id")  # fit_rows rows at most
    grams = chosen.mapInArrow(_features, "doc_id bigint, label int, grams array<int>")
    found = grams.repartition(1).mapInArrow(_fit_task, "model array<double>").toArrow()
    return np.array(found.column("model")[0].as_py()) if found.num_rows else fit([], np.zeros(0, np.int64))


def scores(column: pa.Array, model: np.ndarray) -> np.ndarray:
    bias, slope, intercept = model[BUCKETS : BUCKETS + 3]
    margin = np.full(len(column), bias)
    if len(model) > BUCKETS + 3:
        values, offsets = indicators(column)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            at = offsets[:-1][full]
            weight = np.add.reduceat(model[:BUCKETS][values], at)
            norm = np.sqrt(np.add.reduceat(model[BUCKETS + 3 :][values], at))
            margin[full] += weight / np.maximum(norm, 1e-12)
    return 1 / (1 + np.exp(-np.clip(slope * margin + intercept, -30, 30)))


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def _score(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            s = scores(part.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def classify(docs: DataFrame, labels: DataFrame, held_out=None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted label of every row; ``labels`` has (doc_id, label)."""
    model = learn(docs, labels, fit_rows)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_score(model), SCHEMA)
