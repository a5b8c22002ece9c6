"""The whole job on every row: what the network learns from, and how texts travel."""

import numpy as np
import pyarrow as pa
import pytest

from siftgraph.llm import gru_lm, rlz


def _vocabulary():
    head = [(k * 7919 + 1, k % 32, 500 - k) for k in range(40)]
    return gru_lm.Vocabulary(head, {t: (600 * (t < 4) + 3000 * (t == 5), 9) for t in range(6)}, 9000, 400)


@pytest.mark.parametrize("least", [gru_lm.LEAST_TOKENS, 1])
def test_network_learns_from_every_training_document(spark, monkeypatch, least):
    """Only rows of tokens that were seen are moved, in one reading of all parts as in many of the whole."""
    monkeypatch.setattr(gru_lm, "LEAST_TOKENS", least)
    monkeypatch.setattr(gru_lm, "SHARD_TOKENS", 500)
    vocab = _vocabulary()
    rows = [(k, k % 7 != 2, 50, np.full(50, k, gru_lm.ID).tobytes()) for k in range(40)]
    encoded = spark.createDataFrame(rows, "doc_id bigint, learn boolean, n_tokens bigint, ids binary").repartition(3)
    before, after = gru_lm.first_weights(vocab)["x"], gru_lm.fit(encoded, vocab)["x"]
    moved = np.abs(after - before).max(axis=1) > 1e-6
    assert moved[:40].tolist() == [k % 7 != 2 for k in range(40)] and not moved[40:].any()


def test_texts_travel_packed_and_come_back_whole():
    texts = [None, "", " \t", "été 中文 \U0001f600", " ".join(f"word{k % 90} of a text" for k in range(2000))]
    names = {"doc": pa.int64(), "crc": pa.int64(), "doc_id": pa.int64()}
    part = pa.RecordBatch.from_pydict({**{n: pa.array([1, 2, 3, 4, None], t) for n, t in names.items()}, "text": texts})
    (out,) = rlz._packed([part])
    got = [rlz._unpacked(p, n) for p, n in zip(out.column("packed").to_pylist(), out.column("size").to_pylist())]
    assert got == [(t or "").encode() for t in texts] and out.column("doc_id").to_pylist()[4] is None
    assert 4 * len(out.column("packed")[4].as_py()) < len(texts[4])
