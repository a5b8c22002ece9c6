"""Grid training against a plain numpy version of the same batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgraph.operators import embedding as E
from siftgraph.operators import linkpred as L

DIM, RATE, BATCH = 6, 0.05, 7


class Plain:
    """Adam in double precision, one row at a time; gradients of a batch are added up by row."""

    def __init__(self, vectors):
        self.x = {i: np.array(v, float) for i, v in vectors.items()}
        self.m = {i: np.zeros(DIM) for i in vectors}
        self.v = {i: np.zeros(DIM) for i in vectors}
        self.n = dict.fromkeys(vectors, 0)
        self.used = dict.fromkeys(vectors, 0)

    def copy(self):
        other = Plain({})
        other.x, other.m, other.v = ({i: a.copy() for i, a in d.items()} for d in (self.x, self.m, self.v))
        other.n, other.used = dict(self.n), dict.fromkeys(self.x, 0)
        return other

    def step(self, grads, unit):
        for i, g in grads.items():
            self.n[i] += 1
            self.used[i] += 1
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            rate = RATE * np.sqrt(1 - 0.999 ** self.n[i]) / (1 - 0.9 ** self.n[i])
            self.x[i] = self.x[i] - rate * self.m[i] / (np.sqrt(self.v[i]) + 1e-8)
            if unit and (norm := np.linalg.norm(self.x[i])) > 1:
                self.x[i] = self.x[i] / norm


def plain_task(ents, rels, ids, rows, draws, margin):
    """Batches of one task; returns the summed loss."""
    ids, total = sorted(ids), 0.0
    rows = sorted(rows, key=lambda x: draws[x].place)
    for a in range(0, len(rows), BATCH):
        part, e_grad, r_grad = rows[a : a + BATCH], {}, {}
        for x in part:
            h, r, t = x
            other = ids[int(draws[x].u * len(ids))]
            nh, nt = (other, t) if draws[x].head_side else (h, other)
            good, bad = ents.x[h] + rels.x[r] - ents.x[t], ents.x[nh] + rels.x[r] - ents.x[nt]
            loss = margin + abs(good).sum() - abs(bad).sum()
            if loss <= 0:
                continue
            total += loss
            gs, bs = np.sign(good), np.sign(bad)
            for i, g in ((h, gs), (t, -gs), (nh, -bs), (nt, bs)):
                e_grad[i] = e_grad.get(i, 0) + g
            r_grad[r] = r_grad.get(r, 0) + gs - bs
        ents.step({i: g / len(part) for i, g in e_grad.items()}, True)
        rels.step({i: g / len(part) for i, g in r_grad.items()}, False)
    return total


def plain_training(triples, ents, rels, bucket, buckets, draws, margin):
    ents, rels, losses = Plain(ents), Plain(rels), []
    for drawn in draws:
        total = 0.0
        for k in range(buckets):
            copies = []
            for task in range(buckets):
                pair = {task, (k - task) % buckets}
                if min(pair) != task:
                    continue
                rows = [x for x in triples if {bucket[x[0]], bucket[x[2]]} == pair and (bucket[x[0]] + bucket[x[2]]) % buckets == k]
                own = rels.copy()
                total += plain_task(ents, own, [i for i in ents.x if bucket[i] in pair], rows, drawn, margin)
                copies.append((own, {x[1] for x in rows}))
            for r in rels.x:
                mine = [c for c, used in copies if r in used]
                if mine:
                    w = np.array([max(c.used[r], 1e-9) for c in mine])
                    for name in ("x", "m", "v"):
                        getattr(rels, name)[r] = sum(getattr(c, name)[r] * a for c, a in zip(mine, w, strict=True)) / w.sum()
                    rels.n[r] = max(c.n[r] for c in mine)
        losses.append(total / len(triples))
    return ents.x, rels.x, losses


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "id long, vec array<double>")


def collected(df):
    return {r.id: np.array(r.vec) for r in df.collect()}


@pytest.mark.parametrize("buckets", [1, 3, 4])
def test_grid_equals_plain_batches(spark, buckets):
    rng = np.random.default_rng(buckets)
    ents = {i: rng.normal(size=DIM) * 0.2 for i in range(40)}
    rels = {i: rng.normal(size=DIM) * 0.2 for i in range(4)}  # the last one is in no triple
    # a third of the triples share one tail
    triples = sorted({(int(rng.integers(40)), int(rng.integers(3)), 5 if rng.random() < 0.33 else int(rng.integers(40))) for _ in range(120)})
    where = spark.range(40).select("id", E.bucket_of("id", buckets).alias("b"))
    frame_of = spark.createDataFrame(triples, "h long, r long, t long")
    draws = [{(x.id, x.r, x.t): x for x in E.drawn_epoch(frame_of, epoch, 42).collect()} for epoch in (0, 1)]
    assert draws[0] != draws[1] and {x.head_side for x in draws[0].values()} == {True, False}
    want = plain_training(triples, ents, rels, {r.id: r.b for r in where.collect()}, buckets, draws, 1.0)
    got = E.train_on_grid(
        frame_of, frame(spark, ents), frame(spark, rels),
        2, DIM, RATE, 1.0, BATCH, buckets=buckets,
    )
    for mine, theirs in zip(got[:2], want[:2], strict=True):
        mine = collected(mine)
        assert mine.keys() == theirs.keys()
        assert all(np.allclose(mine[i], theirs[i], atol=2e-4) for i in mine)
    losses = {r.epoch: (r.loss, r.n) for r in got[2].collect()}
    assert losses.keys() == {0, 1}
    for epoch, loss in enumerate(want[2]):
        assert abs(losses[epoch][0] - loss) < 1e-3 and losses[epoch][1] == len(triples)


def test_every_pair_of_buckets_meets_once(spark):
    for n in (1, 2, 5, 8):
        pairs = spark.range(n).crossJoin(spark.range(n).withColumnRenamed("id", "j")).withColumn("k", F.expr(f"(id + j) % {n}"))
        rows = pairs.collect()
        for k in range(n):
            task = {r.id: r.t for r in spark.range(n).select("id", E.task_of(F.col("id"), k, n).alias("t")).collect()}
            assert all(task[r.id] == task[r.j] for r in rows if r.k == k)
            assert all(sum(v == t for v in task.values()) <= 2 for t in task.values())


def test_training_by_weight_and_without_triples(spark):
    rows = [(i, 0, (i + 1) % 30, 1.0 if i % 2 else 1e-4) for i in range(30)]
    train = spark.createDataFrame(rows, "h long, r long, t long, c double")
    ents, rels = spark.range(30), spark.range(1)
    e, r = L.train_translation(train, ents, rels, 30, dim=8, epochs=3, rate=0.05, weight="c")
    moved = L.triple_distance(train, e, r).groupBy(F.col("c") > 0.5).agg(F.avg("distance")).collect()
    assert len(moved) == 2 and e.count() == 30
    same, _ = L.train_translation(train.limit(0), ents, rels, 30, dim=8, epochs=1)
    start = L.initial_vectors(ents, 30, 8, 42, True)
    a, b = collected(same), collected(start)
    assert all(np.allclose(a[i], b[i], atol=1e-6) for i in b)
