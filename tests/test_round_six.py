"""What a query moves and holds: rows joined once, buckets met by broadcast, groups in parts by size."""

import pytest
from test_round_five import large, plan_of  # noqa: F401

from siftgraph.operators import graph as GR
from siftgraph.operators import joins as J
from siftgraph.operators import sampling as K
from siftgraph.plans.catalog import REGISTRY
from siftgraph.plans.fixtures import Tables


def test_customers_meet_orders_not_line_items(spark, small, large):  # noqa: F811
    lines = plan_of(Tables(spark, small).candidates).splitlines()
    depth = {key: next(x.index("SortMergeJoin") for x in lines if "SortMergeJoin" in x and key in x) for key in ("o_custkey", "l_orderkey")}
    assert depth["o_custkey"] > depth["l_orderkey"]


@pytest.mark.parametrize("name", ["k10_weighted_draws", "e13_resume_columns", "e07_merge_sources"])
def test_rows_are_joined_from_the_base_tables_once(spark, small, name):
    assert "l_orderkey" not in plan_of(REGISTRY[name].run(spark, small))


def test_weights_meet_their_buckets_by_broadcast(spark, large):  # noqa: F811
    rows = spark.range(200).selectExpr("concat('r', id) AS row_id", "id % 7 AS w")
    out = K.weighted_draws(rows, "w", 500, ["row_id"])
    assert not [x for x in plan_of(out).splitlines() if "SortMergeJoin" in x and "__b" in x]
    weights = dict(rows.collect())
    got = [(r.draw, r.w, weights[r.row_id]) for r in out.collect()]
    assert sorted(d for d, _, _ in got) == list(range(500)) and all(a == b > 0 for _, a, b in got)


def test_release_reads_what_it_wrote(spark, tmp_path):
    from siftgraph.sources import tables as T

    columns = "docid long, subject string, predicate string, object string, a__score double, a__pred int, b__pred int"
    rows = [(i, f"s{i % 3}", "p", "o", i / 10, int(i > 3), int(i != 5)) for i in range(9)]
    signals = spark.createDataFrame(rows, columns)
    gold = signals.filter("docid = 8").select("docid", "subject", "predicate", "object")
    seen = []

    def edges(kept):
        seen.extend(kept.inputFiles())
        return GR.accepted_edges(kept, ["a__pred", "b__pred"], ["a__score"])

    T.write_release(signals, gold, edges, ["a__pred", "b__pred"], str(tmp_path))
    assert seen and all("all_signals" in f for f in seen)
    written = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/kg/edges").collect()
    want = GR.evidence_edges(signals, gold, ["a__pred", "b__pred"], ["a__score"]).collect()
    assert {(r.docid, r.mean_score) for r in written} == {(str(r.docid), str(r.mean_score)) for r in want}
    published = spark.read.parquet(f"{tmp_path}/silver/published")
    assert {(int(r.docid), r.label) for r in published.collect()} == {(i, int(i > 3)) for i in range(8) if (i > 3) == (i != 5)}


def test_groups_are_made_in_parts_by_size(spark, small, monkeypatch):
    monkeypatch.setattr(J, "KEY_BYTES", 4096)
    edges = Tables(spark, small).repeated
    plan = plan_of(GR.graph_summary(edges))
    wanted = -(-J.scanned_bytes(edges.select("subject", "predicate", "object")) // 4096)
    assert wanted > 8 and f", {wanted}), REPARTITION_BY_NUM" in plan


def test_components_read_the_edges_once_and_keep_lone_nodes(spark):
    rows = [("a", "b"), ("b", "c"), ("d", "d"), ("f", "e"), (None, "g"), ("e", "f"), ("h", None)]
    edges = spark.createDataFrame(rows, "subject string, object string")
    out = GR.connected_components(edges)
    want = {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "g": "g", "h": "h", None: None}
    assert {r.node: r.component for r in out.collect()} == want and out.count() == len(want)
    assert "LocalTableScan" not in plan_of(out)
