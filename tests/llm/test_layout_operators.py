"""Sharding, mixing, token files and the pipeline."""

import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftgraph.llm import hilbert, raking, token_output
from siftgraph.llm.queries import default_tokenizer
from siftgraph.llm.tables import shared_folder


def test_curve_visits_neighbours(spark):
    bits, dims = 3, 3
    cells = spark.range(1 << (bits * dims)).select(
        *[F.expr(f"shiftright(id, {bits * k}) & {(1 << bits) - 1}").cast("int").alias(f"c{k}") for k in range(dims)]
    )
    got = cells.withColumn("h", hilbert.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(1 << (bits * dims)))
    points = np.array([[r.c0, r.c1, r.c2] for r in got])
    assert (np.abs(np.diff(points, axis=0)).sum(axis=1) == 1).all()


def test_shards(docs, awkward, nothing):
    got = hilbert.shard(docs, 5).collect()
    assert len(got) == len(awkward)
    sizes = {s: sorted(r.slot for r in got if r.shard == s) for s in range(5)}
    counts = [len(v) for v in sizes.values()]
    assert max(counts) - min(counts) <= 1 and all(v == list(range(len(v))) for v in sizes.values())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in awkward)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert hilbert.shard(nothing, 5).collect() == []
    few = hilbert.shard(docs.limit(3), 24).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_shard_files(spark, docs, awkward):
    target = shared_folder(spark, "shards")
    distinct = docs.dropDuplicates(["doc_id"])
    hilbert.write_shards(distinct, target, 4)
    back = spark.read.parquet(target)
    assert back.count() == distinct.count() and set(docs.columns) <= set(back.columns)


def test_raking_meets_every_margin(spark, docs):
    rows = [(f"s{i % 3}", f"l{i % 2}", f"t{(i // 6) % 2}", 5 + 7 * i) for i in range(12)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {
        "source": spark.createDataFrame([("s0", 0.2), ("s1", 0.3), ("s2", 0.5), ("missing", 9.0)], "source string, share double"),
        "lang": spark.createDataFrame([("l0", 1.0), ("l1", 1.0)], "lang string, share double"),
        "topic": spark.createDataFrame([("t0", 0.9), ("t1", 0.1)], "topic string, share double"),
    }
    fit = raking.rake(cells, targets)
    total = sum(r[3] for r in rows)
    for d, want in (("source", {"s0": 0.2, "s1": 0.3, "s2": 0.5}), ("lang", {"l0": 0.5, "l1": 0.5}), ("topic", {"t0": 0.9, "t1": 0.1})):
        have = {r[d]: r.w / total for r in fit.groupBy(d).agg(F.sum("w").alias("w")).collect()}
        assert all(abs(have[k] - v) < 1e-6 for k, v in want.items())
    both = [r.w for r in fit.orderBy("source", "lang", "topic").collect()]
    few, raking.BROADCAST_CELLS = raking.BROADCAST_CELLS, 0
    try:
        many = [r.w for r in raking.rake(cells, targets, 6).orderBy("source", "lang", "topic").collect()]
    finally:
        raking.BROADCAST_CELLS = few
    assert np.allclose(both, many, rtol=1e-3)


def test_drawing(docs, awkward, nothing):
    got = raking.draw(docs).collect()
    assert len(got) == len(awkward)
    assert all(0 <= r.probability <= 1 and r.weight >= 0 for r in got)
    assert max(r.probability for r in got) == 1
    taken = raking.sample(docs)
    assert taken.columns == docs.columns
    assert sorted(str(r.doc_id) for r in taken.collect()) == sorted(str(r.doc_id) for r in got if r.selected)
    assert raking.draw(nothing).collect() == [] and raking.sample(nothing).collect() == []


def test_ids_are_those_of_the_whole_text(spark, awkward, small):
    path = default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    texts = [t for _, t, *_ in awkward] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["á b c d\x1ce\u0085f", "I'll we'VE 's 't", "İΣ ẞ", "<|endoftext|>x <|startoftext|>"]
    texts += ["hello <|endoftext|> world", "<|EndOfText|>", "a<|startoftext|>b", "<|endoftext", "|>", None, ""]
    for by_word in (True, False):
        ids, offsets = token_output.encode(pa.array(texts, pa.string()), path, by_word=by_word)
        for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
            assert ids[a:b].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


def test_token_files(spark, docs, awkward, nothing):
    target = shared_folder(spark, "tokens")
    token_output.write_tokens(docs, target, default_tokenizer(), metadata=["lang", "n", "block"])
    back = token_output.token_index(spark, target).collect()
    rows = sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((str(i), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in back) == sorted(want)
    plan = token_output.read_tokens(spark, target, ("doc_id", "lang")).filter("doc_id = 12")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12)]" in plan and "ids" not in plan.split("ReadSchema")[-1]
    names = [f for f in os.listdir(target.removeprefix("file:")) if f.endswith(".parquet")]
    column = pq.ParquetFile(os.path.join(target.removeprefix("file:"), names[0])).metadata.row_group(0).column(0)
    assert column.has_offset_index and column.has_column_index
    empty = shared_folder(spark, "tokens")
    token_output.write_tokens(nothing, empty, default_tokenizer())
    assert token_output.token_index(spark, empty).collect() == []


def test_pipeline_against_plain_python(spark, small):
    """Every stage's decision recomputed on what the stage before kept."""
    from test_text_operators import brute_components, brute_leaks

    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = corpus_pipeline.stored(stage(spark, docs, small), name) if name != "token_ids" else stage(spark, docs, small)
        after = out.collect()
        if name != "token_ids":
            assert out.columns == docs.columns and len(after) <= len(before)
        rows = [(r.doc_id, r.text) for r in before]
        ids = {r.doc_id for r in after}
        if name == "language_id":
            assert len(ids) > 0.97 * len(rows)
        elif name == "near_dedup":
            assert ids == set(brute_components(rows).values())
        elif name == "decontamination":
            assert ids == {i for i, _ in rows} - {i for i, _ in brute_leaks(rows, items)}
        elif name == "mixing":
            assert ids == {r.doc_id for r in raking.draw(docs).filter("selected").collect()} and ids
        else:
            assert ids == {i for i, _ in rows}
            last = max(after, key=lambda r: r.start)
            assert last.start + last.n_tokens == sum(r.n_tokens for r in after)
        kept.append(len(after))
        docs = out
    assert corpus_pipeline.run(spark, small).count() == kept[-1]
