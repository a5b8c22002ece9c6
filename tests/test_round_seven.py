"""Cases of the findings of round 4."""

import numpy as np
import pyarrow as pa
import pytest

from siftgraph.operators import embedding as E
from siftgraph.operators import linkpred as L
from siftgraph.sources import tables as T

ODD_CELLS = [None, "", " lead", "trail\t", "\n", "a\r\nb\r", "\x00", "a\x00b\"", '""', '" ,', "plain"]


@pytest.mark.parametrize("name", ["a01_csv_scan", "a01_csv_split_scan"])
def test_csv_keeps_white_space_and_nulls(spark, tmp_path, monkeypatch, name):
    """Empty texts become ' "q"': the blank in front was lost, and nulls came back as empty cells."""
    from siftgraph.plans import io_checks
    from siftgraph.plans.catalog import REGISTRY

    cells = [(a, b) for a in ODD_CELLS for b in ODD_CELLS]
    rows = [(i, a, b, "s" if b is None else b, 1) for i, (a, b) in enumerate(cells)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(io_checks, "scratch", lambda t, name: str(tmp_path / name))
    got = {r.doc_id: (r.text, r.lang, r.source) for r in REGISTRY[name].run(spark, str(tmp_path)).collect()}
    assert got == {i: (None if a is None else a + ' "q"', b, s) for i, a, b, s, _ in rows}
    # readers that are not asked for nulls give empty cells as before
    plain = T.read_csv(spark, str(tmp_path / "csv")).collect()
    assert sorted((int(r.doc_id), r.lang) for r in plain) == [(i, b or "") for i, _, b, _, _ in rows]


def test_loss_copies_a_vector_once_per_block_of_tails(spark, monkeypatch):
    """Vectors moved for the loss, counted in place of distances; pairs of small blocks took 32 copies of each."""
    n, block = 4096, 128
    vectors = lambda m: spark.range(m).selectExpr("id", "array(cast(id as float), cast(1 as float)) AS vec")
    triples = spark.range(3000).selectExpr("id AS h", "id % 3 AS r", f"(id * 7) % {n} AS t")

    def counted(batches):
        for part in batches:
            if moved := len(part) - part.column("vec").null_count:
                column = lambda v, kind: pa.array([v] * moved, kind)
                yield pa.RecordBatch.from_arrays(
                    [*(column(0, pa.int64()) for _ in range(3)), column(1, pa.int32()), column(0.0, pa.float64())],
                    names=["h", "r", "t0", "sign", "dist"],
                )

    want = L.margin_loss(triples, vectors(n), vectors(3), n, block=n).first()
    got = L.margin_loss(triples, vectors(n), vectors(3), n, block=block).first()
    assert got.n == 3000 and abs(got.loss - want.loss) < 1e-9
    monkeypatch.setattr(L, "_cell_distances", counted)
    copies = L.margin_loss(triples, vectors(n), vectors(3), n, block=block).first().n / n
    assert copies < 12


def test_last_round_of_training_returns_no_optimiser_state():
    rows = E.Vectors(*(x(5, 2) for x in [lambda n, d: np.arange(n)] + [lambda n, d: np.ones((n, d), np.float32)] * 3), np.zeros(5, np.int64), np.zeros(5))
    full, bare = (pa.Table.from_batches(rows.rows(0, E.ENTITY, *x)) for x in ((), (True,)))
    assert bare.schema == full.schema and bare.column("vec") == full.column("vec")
    assert bare.column("m").null_count == bare.column("v").null_count == 5 and full.column("m").null_count == 0


def test_large_arrivals_are_written_by_the_tasks_of_their_plan(spark, small, tmp_path, monkeypatch):
    from siftgraph.plans import io_checks
    from siftgraph.plans.fixtures import Tables

    t = Tables(spark, small)
    monkeypatch.setattr(io_checks, "scratch", lambda t, name: str(tmp_path / name))
    monkeypatch.setattr(io_checks, "DEALT_BYTES", 0, raising=False)
    path, files = io_checks.arriving(t, t.documents.repartition(5), "in")
    assert len(spark.read.parquet(path).inputFiles()) == 5 and files == 3
    assert spark.read.parquet(path).count() == t.documents.count()


@pytest.mark.parametrize("name, wanted", [("n02_streaming_dedupe", 4), ("n02_streaming_first_wins", 7)])
def test_streams_hold_what_their_result_needs(spark, small, monkeypatch, name, wanted):
    """Rows arrive with the columns of the result (and a time), and one query takes them, so state is held once."""
    from siftgraph.plans import io_checks
    from siftgraph.plans.catalog import REGISTRY

    seen, arriving, write = [], io_checks.arriving, io_checks.N.write_available
    monkeypatch.setattr(io_checks, "arriving", lambda t, df, *x: (seen.append(len(df.columns)), arriving(t, df, *x))[1])
    monkeypatch.setattr(io_checks.N, "write_available", lambda *x: (seen.append("run"), write(*x))[1])
    assert REGISTRY[name].run(spark, small).count() > 0
    assert seen == [wanted, "run"]


def test_first_wins_with_the_watermark_of_the_stream(spark, tmp_path):
    """A stream that has its watermark gives the same rows, and its rows are shuffled once."""
    from siftgraph.streaming.incremental import first_wins_stream, read_arriving, write_available

    rows = [(f"r{i:02}", i % 4, f"2024-01-01 00:{i:02}:00") for i in range(20, 0, -1)] + [("z", 9, "2024-01-03 00:00:00")]
    d = spark.createDataFrame(rows, "n string, k int, at string").selectExpr("n", "k", "timestamp(at) AS at")
    d.filter("k < 9").repartition(3).write.parquet(str(tmp_path / "in"))
    d.filter("k = 9").write.mode("append").parquet(str(tmp_path / "in"))
    gold, got = spark.createDataFrame([(3,)], "k int"), []
    before = {x: spark.conf.get(x) for x in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for own in (False, True):
            stream = read_arriving(spark, str(tmp_path / "in"), d.schema)
            stream = stream.withWatermark("at", "2 hours") if own else stream
            kept = first_wins_stream(stream, gold, ["n"], "at", "2 hours", ["k"], **({"watermarked": True} if own else {}))
            query = write_available(kept, str(tmp_path / f"out{own}"), str(tmp_path / f"state{own}"))
            query.awaitTermination()
            plan = query._jsq.explainInternal(False)
            got.append((sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / f"out{own}")).collect()), plan.count("Exchange hashpartitioning(k")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[0][0] == got[1][0] == [("r01", 1), ("r02", 2), ("r04", 0)]
    assert got[1][1] < got[0][1]


@pytest.mark.parametrize("dim, far", [(64, 1.0), (5, 1e6), (33, 1e-12)])
def test_vectors_without_clusters_are_compared_by_codes(monkeypatch, dim, far):
    """Exact counts, ties and outliers included, without single-precision passes over every pair."""
    rng = np.random.default_rng(dim)
    unit = lambda n: (x := rng.normal(size=(n, dim))) / np.linalg.norm(x, axis=1)[:, None]
    vectors, queries = unit(2500), unit(300) * 2.0
    vectors[7] *= far
    vectors[40:60] = vectors[39]  # equal distances
    gold = rng.integers(0, 60, size=300)
    limits = np.abs(queries - vectors[gold]).sum(axis=1)
    limits[:5] = 0.0
    want = np.array([(np.abs(vectors - q).sum(axis=1) < x).sum() for q, x in zip(queries, limits, strict=True)])
    block = L.EntityBlock(vectors)
    count, _ = block._by_codes(queries, limits)
    assert (count == want).all()
    assert (block._by_codes(queries * 40, limits * 40)[0] == [(np.abs(vectors - q * 40).sum(axis=1) < x * 40).sum() for q, x in zip(queries, limits, strict=True)]).all()
    if dim == 64:
        monkeypatch.setattr(L.EntityBlock, "_by_codes", lambda self, q, x: ("codes", len(q)))
        assert block.closer(queries, limits) == ("codes", 300)
        near = vectors[rng.integers(0, 2500, size=300)] + 1e-6  # next to an entity: bounds settle nearly all
        assert L.EntityBlock(vectors).closer(near, np.full(300, 1e-3))[0].sum() >= 300
