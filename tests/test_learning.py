"""Cross-training products and resumable scoring against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftgraph.operators import bayes
from siftgraph.operators.feature_cache import cached_features, compact
from siftgraph.operators.sampling import first_wins
from siftgraph.sources.score_sink import ScoreSink
from siftgraph.streaming.incremental import first_wins_stream, read_arriving, write_available


def plain_bayes(trained, asked):
    """{(row, voter): label} by a loop over rows, voters and labels."""
    voters = {}
    vocabulary = set()
    for words, voter, label in trained.values():
        counts, docs = voters.setdefault(voter, ({}, Counter()))
        counts.setdefault(label, Counter()).update(words)
        docs[label] += 1
        vocabulary.update(words)
    out = {}
    for (row, voter), words in asked.items():
        if voter not in voters:
            continue
        counts, docs = voters[voter]
        every = sum(docs.values()) + len(docs)
        read = [w for w in words if w in vocabulary]
        score = {
            y: math.log((docs[y] + 1) / every)
            + sum(math.log(counts[y][w] + 1) for w in read)
            - len(read) * math.log(sum(counts[y].values()) + len(vocabulary))
            for y in docs
        }
        out[row, voter] = min(score, key=lambda y: (-round(score[y], 9), y))
    return out


def bayes_case(spark, rng, n, labels):
    """Rows that all hold one word, some empty, labels of very different size."""
    texts = {}
    for i in range(n):
        words = [] if rng.random() < 0.05 else ["everywhere"] + [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(0, 9))]
        label = 0 if rng.random() < 0.4 else rng.randrange(labels)
        texts[f"r{i}"] = (words + [f"of{label}"] * (rng.random() < 0.7), i % 3, label)
    rows = spark.createDataFrame([(i, v, y, " ".join(w)) for i, (w, v, y) in texts.items()], "id string, voter int, label int, body string")
    return texts, rows


def test_blocked_bayes_equals_plain_python(spark, monkeypatch):
    rng = random.Random(5)
    texts, rows = bayes_case(spark, rng, 150, 7)
    words = bayes.word_counts(rows, "id")
    model, vocabulary = bayes.fit(words, rows, "id")
    others = {f"g{i}": ([f"w{rng.randrange(60)}" for _ in range(8)] + ["never-seen"] * 3, None, None) for i in range(40)}
    gold = spark.createDataFrame([(i, " ".join(w)) for i, (w, _, _) in others.items()], "id string, body string")
    known = bayes.word_counts(gold, "id").join(vocabulary, "word", "left_semi")
    ask = lambda df: df.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("voter"))
    for block_rows, spread in ((bayes.BLOCK_ROWS, bayes.SPREAD), (7, 3)):
        monkeypatch.setattr(bayes, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(bayes, "SPREAD", spread)
        for df, source, own in ((rows, texts, words), (gold, others, known)):
            got = {(r.id, r.voter): r.prediction for r in bayes.predict(model, ask(df), own, "id").collect()}
            # voter 3 has no training rows and does not vote
            assert got == plain_bayes(texts, {(i, v): w for i, (w, _, _) in source.items() for v in range(4)})


def test_blocked_bayes_moves_a_frequent_word_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(bayes, "BLOCK_ROWS", 10)
    monkeypatch.setattr(bayes, "SPREAD", 4)
    rows = spark.range(400).selectExpr("id", "0 AS voter", "cast(id % 2 AS int) AS label", "concat('all side', id % 2) AS body")
    words = bayes.word_counts(rows, "id")
    model, _ = bayes.fit(words, rows, "id")
    plan = bayes.predict(model, rows.select("id", "voter"), words, "id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert plan.join(rows, "id").filter("prediction <> label").count() == 0
    assert {len(r.labels) for r in model.filter("word = 'all'").collect()} == {2}


def counting():
    """A loader that is sent to the workers by value."""

    def load():
        return lambda pdf: pdf["text"].str.count(" ")

    return load


def test_score_sink_survives_every_kind_of_cut(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a " * (i % 5)) for i in range(300)], "id long, text string")
    path, spaces = str(tmp_path / "sink"), counting()

    def failing():
        return lambda pdf: 1 / 0

    sink = ScoreSink.open(rows, path, "id", ["text"], 7)
    assert sink.scores().count() == 0 and sink.committed() == {}
    assert sink.run(spaces, ["text"], most=2) == sum(sink.committed().values())
    with pytest.raises(Exception):  # noqa: B017
        sink.run(failing, ["text"])
    assert len(sink.committed()) == 2
    # a chunk whose scores were written, but not committed: they are not read and not kept
    left = tmp_path / "sink" / "scores" / "chunk=2"
    spark.createDataFrame([(1, 99.0)], "id long, score double").write.mode("overwrite").parquet(str(left))
    first = set(sink.scores().collect())
    again = ScoreSink.open(rows.limit(0), path, "id", ["text"], 7)  # the rows were staged before
    assert first == set(again.scores().collect())
    again.run(spaces, ["text"])
    got = again.scores().collect()
    assert sorted((r.id, r.score) for r in got) == [(i, float(i % 5)) for i in range(300)]
    assert again.run(failing, ["text"]) == 0  # nothing is left to score
    with pytest.raises(ValueError):
        ScoreSink.open(rows, path, "id", ["text"], 8)


def test_score_sink_checks_the_scorer(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a b") for i in range(20)], "id long, text string")
    sink = ScoreSink.open(rows, str(tmp_path / "s"), "id", ["text"], 2)

    def short():
        return lambda pdf: pdf["text"].str.count(" ").iloc[:0]

    with pytest.raises(Exception):  # noqa: B017
        sink.run(short, ["text"])
    assert sink.scores().count() == 0
    empty = ScoreSink.open(rows.limit(0), str(tmp_path / "e"), "id", ["text"], 1)
    assert empty.scores().count() == 0


def test_first_wins_stream_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    keys = ["docid", "subject", "predicate", "object"]
    rows = []
    for i in range(400):
        key = 0 if rng.random() < 0.33 else rng.randrange(60)
        rows.append((i, key, "s", "p", None if key == 7 else "o", f"payload {i}", 1000 + rng.randrange(3000)))
    schema = "n long, docid long, subject string, predicate string, object string, extra string, at long"
    rng.shuffle(rows)
    gold = spark.createDataFrame([(3, "s", "p", "o")], "docid long, subject string, predicate string, object string")
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    end = [(10**6, -1, "s", "p", "o", "end", 10**9)]
    for k, part in enumerate([rows[i::5] for i in range(5)] + [end]):
        df = spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds("at"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = read_arriving(spark, source, df.schema, files_per_trigger=1)
        write_available(first_wins_stream(stream, gold, ["n"], "at", "2 hours"), sink, state).awaitTermination()
        if k == 4:
            assert spark.read.schema(df.schema).parquet(sink).count() == 0  # the watermark has passed no session
    got = {(r.docid, r.object): (r.n, r.extra) for r in spark.read.parquet(sink).filter("docid >= 0").collect()}
    batch = first_wins(spark.createDataFrame(rows, schema).join(gold, keys, "left_anti"), keys, "n")
    assert got == {(r.docid, r.object): (r.n, r.extra) for r in batch.collect()}
    assert spark.read.parquet(sink).filter("docid >= 0").count() == len(got)


def test_feature_cache_encodes_what_changed(spark, tmp_path):
    rows = [(i, f"text of {i % 7}") for i in range(50)] + [(50, None), (51, "")]
    make = lambda rs: spark.createDataFrame(rs, "id long, body string")
    encode = lambda df: df.withColumn("size", F.length("body"))
    for name in ("cache_a", "cache_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    run = lambda rs, by="v1": cached_features(make(rs), "cache_a", "id", "body", by, encode, 4, str(tmp_path / "a"))
    try:
        found, n = run(rows)
        assert n == 52 and {(r.id, r.body, r["size"]) for r in found.collect()} == {(i, t, None if t is None else len(t)) for i, t in rows}
        assert run(rows)[1] == 0
        changed = [(i, "another" if i == 3 else t) for i, t in rows]
        found, n = run(changed)
        assert n == 1 and {r["size"] for r in found.filter("id = 3").collect()} == {7} and found.count() == 52
        assert run(rows)[1] == 0  # the earlier text is still there
        assert run([*changed, (60, "x"), (60, "x")])[1] == 1  # a repeated row is encoded once
        assert run(changed, "v2")[1] == 52
        compact("cache_a", make(changed), "id", "body", "v2", "cache_b", 4, str(tmp_path / "b"))
        assert spark.table("cache_b").count() == 52
        assert run([])[1] == 0
    finally:
        for name in ("cache_a", "cache_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
