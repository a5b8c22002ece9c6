"""Brute-force and property tests on small frames, skewed on purpose."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftgraph.functions.answers import parse_yes_no, unambiguous_ids
from siftgraph.operators import bootstrap as BS
from siftgraph.operators import ensemble as G
from siftgraph.operators import graph as GR
from siftgraph.operators import joins as J
from siftgraph.operators import linkpred as L
from siftgraph.operators import metrics as M
from siftgraph.operators import ranking as K
from siftgraph.operators import roc as R
from siftgraph.operators import sampling as S
from siftgraph.sources import tables as T


def scored(spark, n=4000, seed=1):
    """Rows with one predicate on a third of them, crowded scores and some nulls."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        predicate = "hot" if rnd.random() < 0.34 else f"p{rnd.randrange(12)}"
        y = int(rnd.random() < 0.6)
        s = rnd.choice([0.0, 1.0, round(rnd.random(), 3), 1 - rnd.random() * 1e-6])
        rows.append((i, predicate, y, s if y or rnd.random() < 0.5 else round(s / 2, 4)))
    return spark.createDataFrame(rows, "row_id long, predicate string, label int, score double"), rows


def test_ordered_rank_equals_row_number(spark):
    d, _ = scored(spark)
    h = d.withColumn("h", K.hash_key(3, "row_id"))
    want = F.row_number().over(Window.partitionBy("predicate").orderBy("h", "row_id")) - 1
    ranked = K.ordered_rank(h.withColumn("want", want), "h", ["row_id"], ["predicate"])
    assert ranked.filter("rank <> want").count() == 0 and ranked.count() == 4000


def test_quantiles_and_median(spark):
    d, rows = scored(spark)
    got = K.exact_quantiles(d, "score", {"a": 0.1, "b": 0.5, "c": 0.977}, K.unit_bucket("score")).first()
    want = np.quantile([r[3] for r in rows], [0.1, 0.5, 0.977])
    assert np.allclose(list(got), want)
    med = K.upper_median(d, "score", K.unit_bucket("score"), ["predicate"]).collect()
    for p, m in med:
        v = sorted(r[3] for r in rows if r[1] == p)
        assert m == v[len(v) // 2]


def test_unit_bucket_is_monotone(spark):
    xs = sorted({*np.linspace(-1, 1, 4001).tolist(), 1e-300, -1e-300, 1e-12, 1 - 1e-16, 1 - 1e-9, 1.5, -1.5})
    d = spark.createDataFrame([(float(x),) for x in xs], "x double")
    b = [r[0] for r in d.select(K.unit_bucket("x")).collect()]
    assert b == sorted(b)


def test_auc_and_youden_brute_force(spark):
    d, rows = scored(spark, 800)
    pos = np.array([r[3] for r in rows if r[2] == 1])
    neg = np.array([r[3] for r in rows if r[2] == 0])
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(R.auc(d, "score", "label").first()["auc"] - want) < 1e-12
    best = max(
        ((pos >= t).mean() - (neg >= t).mean(), t) for t in {r[3] for r in rows}
    )
    y = R.youden(d, "score", "label").first()
    assert abs(y["youden_j"] - best[0]) < 1e-12 and y["youden_threshold"] == best[1]


def test_youden_without_gain(spark):
    d = spark.createDataFrame([(0.1, 1), (0.9, 0)], "score double, label int")
    y = R.youden(d, "score", "label").first()
    assert y["youden_threshold"] == float("inf") and y["youden_f1"] == 0


def test_bootstrap_matches_row_resampling(spark):
    d, rows = scored(spark, 500)
    got = BS.bootstrap_f1(d, F.col("score") >= 0.5, F.col("label") == 1, n_boot=4000).first()
    y, p = np.array([r[2] for r in rows]), np.array([int(r[3] >= 0.5) for r in rows])
    i = np.random.default_rng(0).integers(0, 500, (4000, 500))
    tp = ((y[i] == 1) & (p[i] == 1)).sum(1)
    f = 2 * tp / (2 * tp + ((y[i] == 0) & (p[i] == 1)).sum(1) + ((y[i] == 1) & (p[i] == 0)).sum(1))
    lo, hi = np.percentile(f, [2.5, 97.5])
    assert abs(got["ci_lo"] - lo) < 0.006 and abs(got["ci_hi"] - hi) < 0.006
    assert got["ci_lo"] <= got["f1"] <= got["ci_hi"]


def test_paired_bootstrap(spark):
    d, _ = scored(spark, 500)
    same = BS.paired_bootstrap(d, F.col("label") == 1, F.col("score") >= 0.5, F.col("score") >= 0.5, n_boot=500)
    assert same.first()["mean_diff"] == 0 and same.first()["p_a_better"] == 0
    better = BS.paired_bootstrap(d, F.col("label") == 1, F.col("label") == 1, F.col("score") >= 0.5, n_boot=500)
    assert better.first()["p_a_better"] == 1.0


def test_folds_are_balanced(spark):
    d, _ = scored(spark)
    f = S.predicate_folds(d, "row_id", 5)
    sizes = f.groupBy("predicate").pivot("fold", range(5)).count().fillna(0).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in sizes)
    assert sum(sum(r[1:]) for r in sizes) == 4000


def test_exact_sample_sizes(spark):
    d, _ = scored(spark, 700)
    a = {r.row_id for r in S.exact_sample(d, 123, ["row_id"]).collect()}
    assert len(a) == 123
    assert a < {r.row_id for r in S.exact_sample(d, 200, ["row_id"]).collect()}
    assert S.exact_sample(d, 9999, ["row_id"]).count() == 700


def test_weighted_draws_hit_once_and_in_proportion(spark):
    rows = [(i, 1.0 if i else 49.0) for i in range(50)]
    d = spark.createDataFrame(rows, "row_id long, w double")
    got = S.weighted_draws(d, "w", 4000, ["row_id"])
    assert got.count() == 4000 and got.select("draw").distinct().count() == 4000
    assert abs(got.filter("row_id = 0").count() / 4000 - 0.5) < 0.04


def test_small_weights_keep_their_ratio(spark):
    rows = [(i, w * 1e-9) for i, w in enumerate([1.0, 2.0, 5.0, 0.0, -1.0])] + [(5, None)]
    d = spark.createDataFrame(rows, "row_id long, w double")
    got = dict(S.weighted_draws(d, "w", 8000, ["row_id"]).groupBy("row_id").count().collect())
    assert got.keys() == {0, 1, 2} and sum(got.values()) == 8000
    assert all(abs(got[i] / 8000 - w / 8) < 0.02 for i, w in enumerate([1, 2, 5]))
    # beside a huge weight, a small one is neither raised nor lost
    two = spark.createDataFrame([(0, 1e9), (1, 1.0)], "row_id long, w double")
    shares = {r.row_id: int(r.f) for r in two.select("row_id", S.fixed_point(F.col("w") / 1e9).alias("f")).collect()}
    assert shares == {0: 1 << 60, 1: pytest.approx((1 << 60) / 1e9, rel=1e-9)}


def test_withhold_first_wins_on_hot_key(spark):
    rows = [(f"{i:05d}", 1, "s", "p", "hot" if i % 3 else f"o{i}") for i in range(900)]
    d = spark.createDataFrame(rows, "row_id string, docid int, subject string, predicate string, object string")
    gold = d.filter("object = 'o3'")
    out = J.withhold_and_dedupe(d, gold)
    assert out.filter("object = 'hot'").first()["row_id"] == "00001"
    assert out.count() == 300 and out.filter("object = 'o3'").count() == 0
    counts = J.withhold_counts(d, gold).first()
    assert counts["n_total"] == sum(list(counts)[1:]) == 900
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_consensus_relations(spark):
    rows = [(a, b, c) for a in (0, 1, None) for b in (0, 1, None) for c in (0, 1, None)]
    d = spark.createDataFrame(rows, "a__pred int, b__pred int, c__pred int")
    names = G.signal_columns(d)
    out = d.select("*", G.unanimous_flag(names).alias("u"), G.majority_flag(names).alias("v"), G.published_label(names).alias("l"))
    for r in out.collect():
        votes = [x or 0 for x in r[:3]]
        assert r.v == int(sum(votes) > 1.5)
        assert r.u == (1 if sum(votes) == 3 else 0 if sum(votes) == 0 else -5)
        assert r.l == (r[0] if None not in r[:3] and len(set(r[:3])) == 1 else -1)
        assert not (r.u == 1 and r.v == 0)


def test_merge_sources_stops_on_mismatch(spark):
    base = spark.createDataFrame([("1", 1, "s", "p", "o"), ("2", 2, "s", "p", "o")], "row_id string, docid int, subject string, predicate string, object string")
    src = base.withColumn("x", F.lit(5)).withColumn("docid", F.when(F.col("row_id") == "2", 9).otherwise(F.col("docid")))
    ok = J.merge_sources(base, {"m": src.filter("row_id = '1'")}, {"m": ["x"]}).orderBy("row_id").collect()
    assert [r.x for r in ok] == ["5", ""]
    with pytest.raises(Exception, match="key mismatch at row 2"):
        J.merge_sources(base, {"m": src}, {"m": ["x"]}).collect()


def test_one_to_one_join_rejects_duplicates(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError):
        J.one_to_one_join(a, a.union(a), ["k"])
    with pytest.raises(ValueError):
        J.one_to_one_join(a, a.filter("k = 1"), ["k"])
    assert J.one_to_one_join(a, a, ["k"]).count() == 2


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(260)}", f"n{rnd.randrange(260)}") for _ in range(170)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"n{i}") for i in range(60)] + [("loop", "loop")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for n in list(parent):
        groups.setdefault(find(n), []).append(n)
    want = {n: min(g) for g in groups.values() for n in g}
    d = spark.createDataFrame(pairs, "subject string, object string")
    got = {r.node: r.component for r in GR.connected_components(d).collect()}
    assert got == want


def test_variants_share_no_test_triple(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(40), rnd.randrange(3), rnd.randrange(40), rnd.random() < 0.6, rnd.random()) for _ in range(3000)]
    d = spark.createDataFrame(rows, "h long, r long, t long, ok boolean, s double")
    v = GR.training_variants(d, "ok", 200, "s")
    keys = ["h", "r", "t"]
    for name in ("raw", "denoised", "control", "weighted"):
        assert v[name].join(v["test"], keys).count() == 0
    assert v["control"].count() == v["denoised"].count()
    assert v["weighted"].filter("confidence < 1e-4").count() == 0


def test_tail_ranks_brute_force(spark):
    rng = np.random.default_rng(4)
    e, r = rng.normal(size=(60, 8)), rng.normal(size=(3, 8))
    e[7] = e[8]  # equal vectors must not count as closer
    triples = [(i, int(rng.integers(60)), int(rng.integers(3)), int(rng.integers(60))) for i in range(90)]
    known = {(h, x, t) for _, h, x, t in triples} | {(h, x, int(rng.integers(60))) for _, h, x, _ in triples}
    d = spark.createDataFrame(triples, "q long, h long, r long, t long")
    k = spark.createDataFrame(sorted(known), "h long, r long, t long")
    vec = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    for block, tile in ((16, 1000), (16, 7), (1000, 20)):
        got = {x.q: x["rank"] for x in L.filtered_tail_ranks(d, vec(e), vec(r), k, block, tile).collect()}
        for q, h, x, t in triples:
            dist = np.abs(e - (e[h] + r[x])).sum(axis=1)
            others = [j for j in range(60) if j != t and (h, x, j) not in known]
            assert got[q] == 1 + sum(dist[j] < dist[t] for j in others)


def test_entity_block_counts_without_measuring():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 8
    e = centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 16)) * 0.2
    e[:40] = e[40]  # ties with the limit
    q = e[rng.integers(3000, size=50)] + rng.normal(size=(50, 16)) * 0.1
    q[0] = e[40]
    dist = np.abs(q[:, None] - e[None]).sum(axis=2)
    limits = np.array([dist[i, rng.integers(3000)] for i in range(50)])
    limits[:3] = 0.0, dist[1].max() + 1, dist[2, 40]
    count, measured = L.EntityBlock(e).closer(q, limits)
    assert count.tolist() == (dist < limits[:, None]).sum(axis=1).tolist()
    assert measured.sum() < 0.25 * dist.size
    one = L.EntityBlock(e[:1])
    assert one.closer(q, limits)[0].tolist() == (dist[:, 0] < limits).tolist()


def test_tail_ranks_report_their_work(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(size=(6, 8))[rng.integers(6, size=500)] * 9 + rng.normal(size=(500, 8)) * 0.01
    vec = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    test = spark.createDataFrame([(q, q, 0, (q * 7) % 500) for q in range(60)], "q long, h long, r long, t long")
    known = test.select("h", "r", "t")
    got = L.filtered_tail_ranks(test, vec(e), vec(np.zeros((1, 8))), known, block=100, work=True)
    total = got.agg(F.sum("measured").alias("m"), F.sum("candidates").alias("c"), F.count(F.lit(1)).alias("n")).first()
    assert (total.c, total.n) == (60 * 500, 60) and total.m < 0.6 * total.c


def test_corruption_keeps_trying(spark):
    """All but one entity is a known tail: draws are repeated until that one is found."""
    n = 40
    known = spark.createDataFrame([(0, 0, t) for t in range(n) if t != 17], "h long, r long, t long")
    test = spark.createDataFrame([(q, 0, 0, 1) for q in range(5)], "q long, h long, r long, t long")
    got = L.corrupt_tails(test, known, n, attempts=2).collect()
    assert len(got) == 5 and all(r.t == 17 for r in got)


def test_training_lowers_the_loss(spark):
    rows = [(i, 0, (i + 1) % 12) for i in range(12)] + [(i, 1, (i + 2) % 12) for i in range(12)]
    train = spark.createDataFrame(rows, "h long, r long, t long")
    ents, rels = spark.range(12), spark.range(2)
    loss = []
    for epochs in (0, 4):
        e, r = L.train_translation(train, ents, rels, 12, dim=8, epochs=epochs, rate=0.3)
        loss.append(L.margin_loss(train, e, r, 12).first()["loss"])
    norms = e.select(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("n"))
    assert loss[1] < loss[0] and norms.filter("n > 1 + 1e-6").count() == 0  # single precision


def test_empty_denominators(spark):
    d = spark.createDataFrame([(0, 0), (0, 0)], "p int, g int")
    m = M.confusion(d, F.col("p") == 1, F.col("g") == 1).first()
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_parse_answers(spark):
    rows = [("כן.", "1"), ("Nothing", "unknown"), ("I say no", "0"), ("<think>no</think>\nYES!", "1"), ("", "unknown")]
    d = spark.createDataFrame(rows, "raw string, want string")
    assert d.filter(parse_yes_no("raw") != F.col("want")).count() == 0


def test_unambiguous_ids():
    assert unambiguous_ids(["a", "b"], ["b", "c"], ["d", "a"]) == [[], ["c"], ["d"]]


def test_csv_with_mark_and_multiline(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes('docid,text,subject\n1,"a\n""b"", c",\n2,,"x|y"\n'.encode("utf-8-sig"))
    rows = T.read_csv(spark, str(path)).orderBy("docid").collect()
    assert rows[0].asDict() == {"docid": "1", "text": 'a\n"b", c', "subject": ""}
    assert rows[1].text == "" and rows[1].subject == "x|y"


def test_scores_keep_file_order(spark, tmp_path):
    path = tmp_path / "scores.txt"
    path.write_text("0.5\n\n0.25\n  \n1e-3\n")
    rows = T.read_scores(spark, str(path)).orderBy("row_id").collect()
    assert [(r.row_id, round(r.score, 6)) for r in rows] == [(0, 0.5), (1, 0.25), (2, 0.001)]


def test_verified_write_is_resumable(spark, tmp_path):
    d = spark.range(10).toDF("x")
    path = str(tmp_path / "t")
    assert T.recorded_rows(spark, path) is None
    assert T.write_verified(d, path, expected=10) == 10
    assert T.write_verified(d.filter("false"), path, expected=10) == 10
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(RuntimeError):
        T.write_verified(d, path, expected=11)


def test_bucketed_tables_join_without_shuffle(spark):
    base = spark.range(500).withColumn("row_id", F.col("id").cast("string")).drop("id")
    spark.sql("DROP TABLE IF EXISTS bucketed_base")
    spark.sql("DROP TABLE IF EXISTS bucketed_scores")
    T.write_bucketed(base, "bucketed_base", 4)
    T.write_bucketed(base.withColumn("score", F.rand(1)), "bucketed_scores", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = J.attach_scores(spark.table("bucketed_base"), spark.table("bucketed_scores"), "m")
        assert joined.count() == 500
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE bucketed_base")
        spark.sql("DROP TABLE bucketed_scores")


def test_cross_training_collects_and_cuts_no_vocabulary(spark):
    from siftgraph.operators import learn

    rows = [(i, "s", "o", "pq"[i % 2], f"{'left right'.split()[i % 2]} rare{i}") for i in range(24)]
    df = spark.createDataFrame(rows, "row long, subject string, object string, predicate string, text string")
    vocabulary = spark.createDataFrame([("p", 0), ("q", 1)], "predicate string, id int")
    out = learn.cross_train_denoise(df, vocabulary, "row", 3, hashed=None).collect()
    assert len(out) == 24 and all((r.vote_correct, r.vote_total, r.cleaned_label) == (2, 2, 1) for r in out)
