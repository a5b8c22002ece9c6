"""End-to-end flows on the smallest tables."""

from pyspark.sql import functions as F

from siftgraph.operators import graph as GR
from siftgraph.plans import flows
from siftgraph.plans.fixtures import Tables
from siftgraph.plans.join_checks import plain_gold


def test_corpus_to_release(spark, small):
    t = Tables(spark, small)
    raw = t.repeated.withColumn("text", F.concat("subject", F.lit(" [[x|knows]] "), "object"))
    base = flows.prepare_corpus(raw, plain_gold(t)).cache()
    assert base.filter("text like '%[[%'").count() == 0
    assert base.groupBy("docid", "subject", "predicate", "object").count().filter("count > 1").count() == 0
    scores = base.select("row_id", F.col("a_score").alias("score"))
    keyed = base.select("docid", "subject", "predicate", "object", F.lit(0.5).alias("s"), (F.col("a_score") > 0.5).cast("int").alias("l"))
    wide = flows.merge_signals(
        base.drop("label"),
        {"m1": (scores, 0.3), "m2": (scores, 0.6)},
        {"rc": (keyed, "s", "l")},
        {"vote2": ["m1", "m2"]},
        {"agree2": ["m1", "m2"]},
    )
    assert wide.count() == base.count()
    gold = t.gold.filter("false")
    out = flows.publish(wide, gold, ["m1__pred", "m2__pred", "rc__pred"], ["m1__score", "m2__score"])
    pub = out["published"]
    assert pub.filter("label not in (0, 1)").count() == 0
    assert out["edges"].count() == pub.filter("label = 1").count()
    assert out["all_signals"].columns[:6] == ["docid", "text", "subject", "predicate", "object", "agree3_label"]
    stats = flows.graph_statistics(out["edges"]).first()
    assert stats["n_edges"] == out["edges"].count() and stats["largest"] <= stats["n_nodes"]


def test_benchmark_table(spark, small):
    t = Tables(spark, small)
    rows = flows.evaluate_runs(t.runs, "config", n_boot=500).collect()
    assert len(rows) == 18
    assert all(r.ci_lo <= r.f1 <= r.ci_hi for r in rows)


def test_graph_comparison(spark, small):
    t = Tables(spark, small)
    m = t.mentions
    ents = GR.dense_ids(GR.node_names(m))
    rels = GR.dense_ids(m.select(F.col("predicate").alias("name")))
    ids = GR.index_triples(m, ents, rels).select(
        "h", "r", "t", (F.col("alpha__pred") == 1).alias("ok"), F.col("alpha__score").alias("mean_score")
    )
    out = flows.compare_training_graphs(
        ids, "ok", ents.select("id"), rels.select("id"), 60, variants=("denoised", "weighted"), dim=8, epochs=1
    ).collect()
    assert {r.variant for r in out} == {"denoised", "weighted"}
    assert all(0 < r.mrr <= 1 and 0 <= r.tc_f1 <= 1 for r in out)
