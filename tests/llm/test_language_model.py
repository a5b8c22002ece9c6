"""Work of the language model a token: what is done once a word, a window or a shuffle."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgraph.llm import gru_lm


def _vocabulary():
    head = [(k * 7919 + 1, k % 32, 2000 - k) for k in range(1000)]
    return gru_lm.Vocabulary(head, {t: (600 * (t < 4) + 9000 * (t == 5), 9) for t in range(6)}, 1_600_000, 2000)


def test_softmax_is_taken_once_a_window_over_all_head_classes(monkeypatch):
    calls = []
    plain = gru_lm._picked
    monkeypatch.setattr(gru_lm, "_picked", lambda *a: calls.append(1) or plain(*a))
    w = gru_lm.first_weights(_vocabulary())
    g = np.random.default_rng(3)
    ids = g.integers(0, gru_lm.HEAD + gru_lm.TAILS, (8, 40))
    gru_lm._window_slopes(w, np.zeros((40, gru_lm.HIDDEN), np.float32), ids, np.zeros(ids.shape, bool))
    assert len(np.unique(gru_lm.classes(ids))) > 30 and len(calls) == 2


def test_every_word_of_a_slice_is_looked_up_once(monkeypatch):
    asked = []
    plain = gru_lm.Vocabulary.ids
    monkeypatch.setattr(gru_lm.Vocabulary, "ids", lambda self, h, t: asked.append(len(h)) or plain(self, h, t))
    texts = ["a b A b", "", "b c", None]
    words, tails, offsets = gru_lm.tokens(pa.array(texts))
    known = np.unique(words[:4])  # a and b
    rows = [(0, 0, "", int(k), 3) for k in known.view(np.int64)] + [(0, 1, t or "", 0, 0) for t in texts]
    columns = list(zip(*rows, strict=True))
    n = len(rows)
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(range(n), pa.int64()),
            pa.array([False] * n), pa.array([True] * n), pa.array(columns[2]), pa.array(columns[3], pa.int64()),
            pa.array(columns[4], pa.int64()),
        ],
        names=["block", "kind", "doc_id", "held_out", "learn", "text", "word", "c"],
    )
    vocab = _vocabulary()
    got = pa.Table.from_batches(gru_lm._encode_task(vocab)(iter([batch])))
    assert asked == [4]  # a, b, c and the end, of ten tokens
    assert got.column("n_tokens").to_pylist() == [5, 1, 3, 1] and got.column("n_known").to_pylist() == [4, 0, 1, 0]
    low, high = np.log10(1 / (vocab.n + vocab.v + 1)), np.log10(4 / (vocab.n + vocab.v + 1))
    assert np.allclose(got.column("base_score").to_numpy(), [4 * high + low, low, high + 2 * low, low])
    ids = np.concatenate([np.frombuffer(x, gru_lm.ID) for x in got.column("ids").to_pylist()])
    assert ids.tolist() == plain(vocab, words, tails).tolist()


def test_counts_of_words_need_one_window(spark):
    rows = [(k, k % 3 > 0, f"w{k % 5} w{k % 2} the") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, learn boolean, text string").repartition(3)
    words = gru_lm.counted(docs, [10, 20])
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Sort [") == 1
    one = words.groupBy("word").agg(F.count_if("first").alias("firsts"), F.countDistinct("c").alias("cs"), F.max("c").alias("c"))
    found = one.collect()
    assert all(r.firsts == 1 and r.cs == 1 for r in found)
    learned = [[*t.split(), "end"] for _, ok, t in rows if ok]
    assert sum(r.c for r in found) == sum(map(len, learned))


@pytest.mark.parametrize("scale", [1, 300])  # at 300 logits lie beyond what exp can hold
def test_network_by_plain_formulas(scale):
    w = {k: v.astype(np.float64) for k, v in gru_lm.first_weights(_vocabulary()).items()}
    w["wc"], w["wh"] = w["wc"] * scale, w["wh"] * scale
    g = np.random.default_rng(7)
    h = g.uniform(-1, 1, (200, gru_lm.HIDDEN))
    ids = g.integers(0, gru_lm.HEAD + gru_lm.TAILS, 200)
    k = gru_lm.HIDDEN
    logits = h @ w["wc"] + w["bc"]
    want = []
    for row, i, logit in zip(h, ids, logits, strict=True):
        c = gru_lm.classes(np.array([i]))[0]
        p = logit[c] - np.logaddexp.reduce(logit)
        if i < gru_lm.HEAD:
            block = slice(c * gru_lm.PER_CLASS, (c + 1) * gru_lm.PER_CLASS)
            members = w["wh"][block] @ row + w["bh"][block]
            p += members[i % gru_lm.PER_CLASS] - np.logaddexp.reduce(members)
        want.append(p)
    assert (np.abs(logits).max() > gru_lm.SAFE) == (scale > 1)
    assert np.allclose(gru_lm.log_probability(w, h, ids), want)
    x, u = w["x"][ids], h @ w["u"]
    z, r = (1 / (1 + np.exp(-x[:, a : a + k] - u[:, a : a + k])) for a in (0, k))
    n = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
    assert np.allclose(gru_lm.step(w, h, ids)[0], (1 - z) * n + z * h)
