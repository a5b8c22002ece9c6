"""Language mixture, quality classifier and language model: held-out accuracy and exact parts."""

import math
import zlib

import numpy as np
import pyarrow as pa
from helpers import words_of
from pyspark.sql import functions as F

from siftgraph.llm import gru_lm, language_mixture, nbsvm
from siftgraph.llm.queries import QUERIES


def fold(i, by):
    return zlib.crc32(str(i).encode()) % by


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = QUERIES["op3_language_mixture"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(held) > 40 and np.mean(held) > 0.97


def test_language_edges(docs, awkward, nothing):
    got = language_mixture.identify(docs, docs).collect()
    assert len(got) == len(awkward)
    blank = {15, 16, 17, 23}
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in blank), r
        assert r.lang_pred == "und" or r.lang_pred in ("en", "de", "fr")
    assert {r.lang_pred for r in language_mixture.identify(docs, nothing).collect()} == {"und"}
    assert language_mixture.identify(nothing, docs).collect() == []
    kept = language_mixture.keep_identified(docs, docs)
    assert kept.columns == docs.columns and not blank & {r.doc_id for r in kept.collect()}


def test_language_stage_decides_as_the_query(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    rows += [(100 + i, t, "en") for i, t in enumerate(["12 \u2013 34", "\u20ac 5 \u20ac", "\u4e2d\u6587", "!!", "\U0001f600", "a", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.filter("doc_id < 100")
    got = language_mixture.identify(docs, train).collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {100, 101, 103, 104, 106, 107}
    sure = {r.doc_id for r in got if r.lang_pred != "und" and r.score >= language_mixture.LEAST_SHARE}
    assert {r.doc_id for r in language_mixture.keep_identified(docs, train).collect()} == sure


def test_mixture_finds_shares():
    rng = np.random.default_rng(0)
    kind = np.repeat([0, 1, 2], [600, 300, 0])
    like = np.where(np.arange(3) == kind[:, None], 1.0, 0.05) * rng.uniform(0.5, 1, (900, 3))
    share, _ = language_mixture.fit_mixture(like.astype(np.float32), np.array([0]), np.ones((1, 3)), 30)
    assert abs(share[0, 0] - 2 / 3) < 0.05 and share[0, 2] < 0.05


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op4_nbsvm_quality"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(right) > 80 and np.mean(right) > 0.95


def test_quality_edges(spark, docs, awkward, nothing):
    labels = spark.createDataFrame([(10, 1), (11, 1), (21, 0), (23, 0), (23, 0), (None, 1), (18, None)], "doc_id long, label int")
    got = nbsvm.classify(docs, labels).collect()
    assert len(got) == len(awkward)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (10, 11)}) == 1
    assert {r.score for r in nbsvm.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert nbsvm.classify(nothing, labels).collect() == []


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.array([0, 2 + rng.integers(5)]) if k % 2 else np.array([1, 2 + rng.integers(5)]) for k in range(60)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(60)])
    w = nbsvm.dual_descent(rows, [np.ones(2)] * 60, y, 1.0, 50)
    assert all(y[k] * (w[rows[k]].sum() + w[-1]) > 0 for k in range(60))


def test_base_scores_by_brute_force(docs, awkward, nothing):
    held = language_mixture.remainder("doc_id", 7) == 2
    got = gru_lm.score(docs, held).collect()
    counts, n = {}, 0
    bags = []
    for i, t, *_ in awkward:
        w = [*words_of(t, lower=True), ("end",)]
        bags.append((i, w))
        if i is not None and fold(i, 7) != 2:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
                n += 1
    want = sorted(
        (str(i), len(w), sum(x in counts for x in w), round(sum(math.log10((counts.get(x, 0) + 1) / (n + len(counts) + 1)) for x in w), 6))
        for i, w in bags
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert gru_lm.score(nothing, held).collect() == []
    unlearned = gru_lm.score(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in unlearned)


def _vocabulary():
    head = [(k * 7919 + 1, k % 32, 500 - k) for k in range(40)]
    return gru_lm.Vocabulary(head, {t: (600 * (t < 4) + 3000 * (t == 5), 9) for t in range(6)}, 9000, 400)


def test_network_gradient():
    vocab = _vocabulary()
    w = {k: v.astype(np.float64) for k, v in gru_lm.first_weights(vocab).items()}
    g = np.random.default_rng(2)
    ids = g.choice([0, 1, 5, 33, 39, gru_lm.HEAD + 1, gru_lm.HEAD + 5], (6, 3))
    begin = g.random((6, 3)) < 0.2
    h0 = np.zeros((3, gru_lm.HIDDEN))

    def loss(w):
        h, total = h0, 0.0
        for t in range(len(ids)):
            h = h * ~begin[t][:, None]
            total -= gru_lm.log_probability(w, h, ids[t]).sum()
            h, _ = gru_lm.step(w, h, ids[t])
        return total

    _, grad = gru_lm._window_slopes(w, h0, ids, begin)
    for k in w:
        for _ in range(6):
            at = tuple(g.integers(0, s) for s in w[k].shape) if k not in ("x", "wh", "bh") else (int(ids[1, 0]) % len(w[k]), *[g.integers(0, s) for s in w[k].shape[1:]])
            up = {a: b.copy() for a, b in w.items()}
            down = {a: b.copy() for a, b in w.items()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grad[k][at]) < 1e-4, k


def test_probabilities_sum_to_one_and_state_is_carried():
    vocab = _vocabulary()
    w = gru_lm.first_weights(vocab)
    h = np.random.default_rng(5).standard_normal((1, gru_lm.HIDDEN)).astype(np.float32)
    every = np.arange(gru_lm.HEAD + gru_lm.TAILS)
    p = np.exp(gru_lm.log_probability(w, np.repeat(h, len(every), axis=0), every))
    assert abs(p.sum() - 1) < 1e-4
    ids = np.array([0, 3, 39, gru_lm.HEAD + 2] * 30)
    offsets = np.array([0, 50, 51, 120])
    whole = gru_lm.sequence_scores(w, ids, offsets)
    for a, b, s in zip(offsets[:-1], offsets[1:], whole):
        h, total = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0
        for x in ids[a:b]:
            total += gru_lm.log_probability(w, h, np.array([x]))[0]
            h, _ = gru_lm.step(w, h, np.array([x]))
        assert abs(total - s) < 1e-2


def test_model_beats_base_held_out(spark, small):
    got = QUERIES["op7_gru_language_model"](spark, small).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_tokens_of_null_batch():
    hashes, tail, offsets = gru_lm.tokens(pa.array([None, "", "a b"]))
    assert list(np.diff(offsets)) == [1, 1, 3] and (hashes[[0, 1, 4]] == gru_lm.END).all() and tail[0] == gru_lm.TAILS - 1
