"""Work that grows with the tables: what a query moves, holds and asks of one task."""

import re

import numpy as np

from siftgraph.operators import linkpred as L


def test_tail_ranks_deal_entities_to_large_blocks(spark, small, monkeypatch):
    """A small fixed block would copy every query to a number of blocks that grows with the entities."""
    from siftgraph.plans.catalog import REGISTRY

    blocks = []
    real = L.filtered_tail_ranks

    def seen(*args, **kwargs):
        blocks.append(kwargs.get("block", L.BLOCK))
        return real(*args, **kwargs)

    monkeypatch.setattr(L, "filtered_tail_ranks", seen)
    REGISTRY["i12_ranking_metrics"].run(spark, small).collect()
    assert blocks and min(blocks) >= 1 << 16


def test_screening_in_single_precision_never_decides_near_the_limit():
    rng = np.random.default_rng(3)
    e = rng.normal(size=(700, 32))
    e[:50] = e[50] + rng.normal(size=(50, 32)) * 1e-9  # apart by less than single precision tells
    q = e[rng.integers(700, size=90)] + rng.normal(size=(90, 32)) * 0.3
    q[:40] = e[:40]
    for scale in (1.0, 1e12, 1e-30, 1e35):
        a, b = q * scale, e * scale
        dist = np.abs(a[:, None] - b[None]).sum(axis=2)
        limits = dist[np.arange(90), rng.integers(60, size=90)]
        count, _ = L.EntityBlock(b).closer(a, limits)
        exact = [sum(np.abs(b - x).sum(axis=1) < m) for x, m in zip(a, limits, strict=True)]
        assert count.tolist() == exact


def test_bayes_moves_words_once_for_all_voters(spark):
    """25 voters receive the words of a row and the cells of a word in one row each."""
    from pyspark.sql import functions as F

    from siftgraph.operators import bayes

    rows = spark.range(60).selectExpr("id", "cast(id % 2 AS int) AS label", "concat('b a b w', id) AS body", "explode(sequence(0, 24)) AS voter")
    texts = rows.filter("voter = 0").drop("voter")
    packed = bayes.packed_counts(texts.unionByName(texts.limit(1).withColumns({"id": F.lit(99).cast("long"), "body": F.lit("  ")})), "id")
    got = {r.id: dict(zip(r.words, r.ns, strict=True)) for r in packed.collect()}
    assert got[7] == {"a": 1, "b": 2, "w7": 1} and got[99] == {}
    assert "Exchange hashpartitioning(id" not in bayes.word_counts(texts, "id")._jdf.queryExecution().executedPlan().toString()
    model, _ = bayes.fit(packed, rows, "id")
    assert model.count() == model.select("word").distinct().count() == 64
    out = bayes.predict(model, rows.select("id", "voter"), packed, "id")
    assert out.count() == 60 * 25
    dealt = re.findall(r"hashpartitioning\(block#\d+,([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and not any("voter" in keys for keys in dealt)


def test_arriving_files_grow_with_the_scanned_tables(spark, small, monkeypatch, tmp_path):
    """No task writes a fixed share of all rows, and a trigger still takes half of the files."""
    from siftgraph.plans import io_checks
    from siftgraph.plans.fixtures import Tables

    t = Tables(spark, small)
    monkeypatch.setattr(io_checks, "scratch", lambda t, name: str(tmp_path / name))
    few, half = io_checks.arriving(t, t.documents, "few")
    assert len(spark.read.parquet(few).inputFiles()) == 4 and half == 2
    monkeypatch.setattr(io_checks, "ARRIVING_BYTES", io_checks.scanned_bytes(t.documents) // 9)
    many, half = io_checks.arriving(t, t.documents, "many")
    assert len(spark.read.parquet(many).inputFiles()) >= 9 and half >= 5


def test_csv_for_split_scan_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from siftgraph.plans import io_checks
    from siftgraph.plans.catalog import REGISTRY

    rows = spark.range(40).selectExpr("id AS doc_id", "'fr' AS lang", "'s' AS source", "concat('a. b', id) AS text", "1 AS n_chars")
    rows.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    monkeypatch.setattr(io_checks, "scratch", lambda t, name: str(tmp_path / name))
    try:
        got = REGISTRY["a01_csv_split_scan"].run(spark, str(tmp_path))
        assert sorted(r.text for r in got.collect()) == sorted(f'a.\nb{i} "q"' for i in range(40))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) >= 5


def test_stream_state_is_not_on_the_heap(spark):
    from siftgraph.streaming.incremental import withhold_and_dedupe_stream

    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.format("rate").load().selectExpr("value AS docid", "timestamp")
    withhold_and_dedupe_stream(stream, spark.range(1).selectExpr("id AS docid"), ["docid"])
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_margin_loss_moves_no_vector_with_a_triple(spark):
    rng = np.random.default_rng(8)
    e, r = rng.normal(size=(40, 6)), rng.normal(size=(3, 6))
    vec = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    triples = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(40, size=90), rng.integers(3, size=90), rng.integers(40, size=90), strict=True)]
    triples += triples[:5]  # copies count
    d = spark.createDataFrame(triples, "h long, r long, t long")
    bad = {(x.h, x.r, x.t): x.c for x in d.distinct().withColumn("c", L.draw_entity(5, L.F.lit(40), "h", "r", "t")).collect()}
    dist = lambda h, x, t: np.abs(e[h] + r[x] - e[t]).sum()
    want = np.mean([max(6.0 + dist(h, x, t) - dist(h, x, bad[h, x, t]), 0.0) for h, x, t in triples])
    for block in (L.BLOCK, 9):
        out = L.margin_loss(d, vec(e), vec(r), 40, block=block)
        got = out.first()
        assert got.n == 95 and abs(got.loss - want) < 1e-9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1  # relations with the cells that use them


def test_regrading_joins_rows_not_their_runs(spark, small):
    from siftgraph.plans.catalog import REGISTRY

    plan = REGISTRY["h45_regrade_on_swapped_labels"].run(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "(row_id" not in " ".join(x for x in plan.splitlines() if "Join" in x)
