"""Translation embeddings: training, filtered tail ranking, triple classification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import cut_lineage
from .embedding import BATCH, MARGIN, train_on_grid
from .metrics import f1_of, ratio
from .ranking import hash_key, null_safe_join, prefix_sums, value_counts, with_totals

BLOCK = 1 << 16  # entities a task holds as one matrix
TILE = 1 << 16  # queries of a task
LEAST_TILE = 256  # queries of a task where there are cores without work
PAIRS = 1 << 21  # bounds held at once
DISTANCES = 1 << 13  # distances measured at once
SCREENED = 1 << 16  # distances in single precision at once
DENSE = 0.25  # share of open pairs from which all pairs of a cell are screened
LOOSE = 0.5  # share of open pairs from which cells are left and all pairs are compared by codes
TRIAL = 64  # queries that tell that share
CODE_BITS, CODE_DIMS = 12, 16  # so many codes add up in 16 bits
CODE_ROWS, CODE_COLUMNS = 64, 1024  # pairs compared at once
SINGLE = 1e30  # larger components are not screened in single precision
ATTEMPTS = 16
QUANTILE_STEPS = 199
QUANTILE_RANGE = (0.01, 0.99)
TAIL, USED, HEAD, ASKED = 0, 1, 2, 3  # rows of a cell of the loss


def _vectors(table: DataFrame, key: str, out: str) -> DataFrame:
    return table.select(F.col("id").alias(key), F.col("vec").cast("array<double>").alias(out))


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays."""
    parts = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def translated(h: Column, r: Column) -> Column:
    return F.zip_with(h, r, lambda x, y: x + y)


def triple_distance(triples: DataFrame, entities: DataFrame, relations: DataFrame, out="distance"):
    """L1 distance of head + relation from the tail, per triple."""
    d = (
        triples.join(_vectors(entities, "h", "__h"), "h")
        .join(_vectors(relations, "r", "__r"), "r")
        .join(_vectors(entities, "t", "__t"), "t")
    )
    dist = l1(translated(F.col("__h"), F.col("__r")), F.col("__t"))
    return d.withColumn(out, dist).drop("__h", "__r", "__t")


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long list values as one 2-d array."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _row_l1(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.abs(rows - q).sum(axis=1)


def _measured(df: DataFrame, keep: Sequence[str], a: str, b: str) -> DataFrame:
    """Columns ``keep`` and ``dist``, the L1 distance of two vectors, summed as in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                dist = _row_l1(_matrix(part.column(a)), _matrix(part.column(b)))
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(dist)], names=[*keep, "dist"])

    types = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", dist double")


def _screened(queries: np.ndarray, entities: np.ndarray) -> np.ndarray:
    """L1 distances in single precision, of columns of ``queries`` from columns of ``entities``."""
    total = np.zeros((queries.shape[1], entities.shape[1]), np.float32)
    part = np.empty_like(total)
    for q, e in zip(queries, entities, strict=True):
        np.subtract(q[:, None], e[None, :], out=part)
        np.abs(part, out=part)
        total += part
    return total


class EntityBlock:
    """Entities of a block in cells around pivots, for exact counts that mostly need no distance.

    With p the pivot of an entity e, the triangle inequality bounds the distance of a query q:
    |d(q, p) - d(e, p)| <= d(q, e) <= d(q, p) + d(e, p). A cell whose nearest point is too far
    is skipped, one whose farthest point is near enough is counted whole, and in the others
    only entities that the bounds leave open are measured. Where they leave many open, single
    precision decides first, and double precision what lies within its error of the limit.
    Where they leave most open on a trial, as with vectors that form no clusters, all pairs are
    compared by codes of 12 bits a component, and only what lies within their error is measured.
    """

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        k = max(1, int(n**0.5))
        pivots = vectors[:: max(1, n // k)]
        near = np.full(n, np.inf)
        cell = np.zeros(n, np.int64)
        for i, p in enumerate(pivots):
            d = _row_l1(vectors, p)
            closer = d < near
            near[closer], cell[closer] = d[closer], i
        order = np.lexsort((near, cell))
        self.pivots, self.vectors, self.near = pivots, vectors[order], near[order]
        self.first = np.searchsorted(cell[order], np.arange(len(pivots) + 1))
        self.size = np.diff(self.first)
        ends = np.maximum(self.first[1:] - 1, 0)
        self.radius = np.where(self.size > 0, self.near[ends], 0.0)
        most = np.abs(vectors).max(initial=0.0)
        self.single = np.ascontiguousarray(self.vectors.T, np.float32) if most < SINGLE else None
        self.reach = np.abs(vectors).sum(axis=1).max(initial=0.0)
        self.codes = None

    def closer(self, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query: entities strictly closer than its limit, and how many were measured."""
        plain = self.single is not None and np.abs(queries).max(initial=0.0) < SINGLE and np.isfinite(limits).all()
        if plain and len(queries) >= 4 * TRIAL:
            trial = np.arange(0, len(queries), len(queries) // TRIAL)
            if self._by_cells(queries[trial], limits[trial])[1].mean() >= LOOSE * len(self.vectors):
                return self._by_codes(queries, limits)
        return self._by_cells(queries, limits)

    def _coded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes by component, their sums by vector, and how far a vector is from its codes."""
        top = (1 << CODE_BITS) - 1
        codes = np.clip(np.rint((vectors - self.low) / self.step), 0, top)
        off = np.abs(vectors - (self.low + codes * self.step)).sum(axis=1)
        return np.ascontiguousarray(codes.T.astype(np.uint16)), codes.sum(axis=1).astype(np.int32), off

    def _by_codes(self, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`closer` over all pairs: |a - b| is 2 max(a, b) - a - b, so codes take a maximum and a sum."""
        n = len(self.vectors)
        if self.codes is None:
            self.low = min(self.vectors.min(), queries.min())
            self.step = max(max(self.vectors.max(), queries.max()) - self.low, 1e-30) / ((1 << CODE_BITS) - 1)
            self.codes = self._coded(self.vectors)
        (codes, sums, off), (asking, asked_sums, asked_off) = self.codes, self._coded(queries)
        error = asked_off + off.max() + 1e-9 * (1.0 + limits + np.abs(queries).sum(axis=1) + self.reach)  # rounding never decides
        most = queries.shape[1] << CODE_BITS
        sure = np.clip(np.floor((limits - error) / self.step), -1, most).astype(np.int32) + asked_sums
        last = np.clip(np.ceil((limits + error) / self.step), -1, most).astype(np.int32) + asked_sums
        count = np.zeros(len(queries), np.int64)
        held = [np.empty(CODE_ROWS * CODE_COLUMNS, kind) for kind in (np.int32, np.uint16, np.uint16)]
        for i in range(0, len(queries), CODE_ROWS):
            q = np.arange(i, min(i + CODE_ROWS, len(queries)))
            ask = asking[:, q, None]
            for j in range(0, n, CODE_COLUMNS):
                to = slice(j, min(j + CODE_COLUMNS, n))
                shape = len(q), to.stop - j
                dist, some, part = (x[: shape[0] * shape[1]].reshape(shape) for x in held)
                for d in range(0, len(codes), CODE_DIMS):
                    for k in range(d, min(d + CODE_DIMS, len(codes))):
                        out = some if k == d else part
                        np.copyto(out, ask[k])  # written out first: a maximum with a repeated value is slow
                        np.maximum(out, codes[k, to], out=out)
                        if k > d:
                            np.add(some, part, out=some)
                    np.add(dist, some, out=dist) if d else np.copyto(dist, some)
                dist *= 2
                dist -= sums[to]
                inside = dist < sure[q, None]
                count[q] += [np.count_nonzero(x) for x in inside]
                asked, of = divmod(np.flatnonzero((dist <= last[q, None]) ^ inside), shape[1])
                for k in range(0, len(asked), DISTANCES):
                    a, e = q[asked[k : k + DISTANCES]], of[k : k + DISTANCES] + j
                    hit = np.abs(self.vectors[e] - queries[a]).sum(axis=1) < limits[a]
                    np.add.at(count, a[hit], 1)
        return count, np.full(len(queries), n)

    def _by_cells(self, queries: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, measured = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        dim = queries.shape[1]
        single = self.single is not None and np.abs(queries).max(initial=0.0) < SINGLE
        asking = np.ascontiguousarray(queries.T, np.float32) if single else None
        error = 2.0**-22 * (dim + 4) * (limits + np.abs(queries).sum(axis=1) + self.reach) + 1e-30
        for c in np.flatnonzero(self.size).tolist():
            to_pivot = _row_l1(queries, self.pivots[c])
            slack = 1e-9 * (1.0 + to_pivot + limits)  # rounding never decides
            count[to_pivot + self.radius[c] < limits - slack] += self.size[c]
            open_ = np.flatnonzero(
                (to_pivot + self.radius[c] >= limits - slack) & (to_pivot - self.radius[c] <= limits + slack)
            )
            near = self.near[self.first[c] : self.first[c + 1]]
            rows = max(1, PAIRS // len(near))
            for i in range(0, len(open_), rows):
                q = open_[i : i + rows]
                d, limit, s = to_pivot[q, None], limits[q, None], slack[q, None]
                sure = d + near < limit - s
                left = ~sure & (np.abs(d - near) <= limit + s)
                count[q] += sure.sum(axis=1)
                measured[q] += left.sum(axis=1)
                if single and left.sum() >= DENSE * left.size:
                    step = max(1, SCREENED // len(near))
                    for j in range(0, len(q), step):
                        a = q[j : j + step]
                        dist = _screened(asking[:, a], self.single[:, self.first[c] : self.first[c + 1]])
                        inside = left[j : j + step] & (dist < (limits[a] - error[a])[:, None])
                        count[a] += inside.sum(axis=1)
                        left[j : j + step] &= ~inside & (dist <= (limits[a] + error[a])[:, None])
                asked, of = np.nonzero(left)
                for j in range(0, len(asked), DISTANCES):
                    a, e = q[asked[j : j + DISTANCES]], of[j : j + DISTANCES] + self.first[c]
                    hit = np.abs(self.vectors[e] - queries[a]).sum(axis=1) < limits[a]
                    np.add.at(count, a[hit], 1)
        return count, measured


def _closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, tile, query): a block's entities, then the queries of a tile."""
    key, held, block = None, [], None
    for part in batches:
        place = np.stack([part.column(c).to_numpy() for c in ("eb", "tile")])
        asks = part.column("query").to_numpy(zero_copy_only=False)
        new = (np.diff(place, axis=1) != 0).any(axis=0) | (asks[1:] != asks[:-1])
        edges = np.flatnonzero(new) + 1
        for a, b in zip([0, *edges], [*edges, len(asks)], strict=True):
            if a == b:
                continue
            some = part.slice(a, b - a)
            if (here := tuple(place[:, a])) != key:
                key, held, block = here, [], None
            if not asks[a]:
                held.append(_matrix(some.column("vec")))
                continue
            if block is None:
                if not held:
                    continue
                block, held = EntityBlock(np.concatenate(held)), []
            count, measured = block.closer(_matrix(some.column("vec")), some.column("dist").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [some.column("id"), pa.array(count), pa.array(measured), pa.array(np.full(b - a, len(block.vectors)))],
                names=["q", "closer", "measured", "candidates"],
            )


def filtered_tail_ranks(
    test: DataFrame, entities: DataFrame, relations: DataFrame, known: DataFrame, block: int = BLOCK, tile: int = TILE,
    work: bool = False,
) -> DataFrame:
    """(q, h, r, t, rank): filtered rank of the true tail among all entities, L1 distance.

    Entities are hashed into blocks, queries into tiles; a task takes one block and one tile,
    and :class:`EntityBlock` leaves out most distances. Known true tails are measured once
    per (h, r), not per query: a running count along the distance says how many are closer.
    ``work`` adds the number of measured and of all candidates of each query.
    """
    queries = (
        test.join(_vectors(entities, "h", "__h"), "h")
        .join(_vectors(relations, "r", "__r"), "r")
        .join(_vectors(entities, "t", "gold_vec"), "t")
        .withColumn("qvec", translated(F.col("__h"), F.col("__r")))
        .select("q", "h", "r", "t", "qvec", "gold_vec")
    )
    limits = cut_lineage(_measured(queries, ["q", "h", "r", "t", "qvec"], "qvec", "gold_vec"))
    n_e, n_q = max(1, -(-entities.count() // block)), limits.count()
    cores = test.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-n_q // tile), min(-(-cores // n_e), n_q // LEAST_TILE))
    vec = F.col("vec").cast("array<double>").alias("vec")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = entities.select(
        dealt("id", n_e).alias("eb"), F.lit(False).alias("query"), F.col("id").cast("long").alias("id"), vec, F.lit(0.0).alias("dist")
    ).withColumn("tile", every(tiles))
    left = limits.select(
        every(n_e).alias("eb"), F.lit(True).alias("query"), F.col("q").cast("long").alias("id"), F.col("qvec").alias("vec"), "dist"
    ).withColumn("tile", dealt("id", tiles))
    # more partitions than cells, so that few cells meet in one
    cells = right.unionByName(left).repartition(4 * n_e * tiles, "eb", "tile").sortWithinPartitions("eb", "tile", "query", "id")
    counts = cells.mapInArrow(_closer, "q long, closer long, measured long, candidates long")
    sums = ["closer", "measured", "candidates"] if work else ["closer"]
    closer = counts.groupBy("q").agg(*[F.sum(c).alias(c) for c in sums])

    pairs = limits.select("h", "r", "qvec").dropDuplicates(["h", "r"])
    others = known.select("h", "r", F.col("t").alias("id")).distinct()
    tails = others.join(pairs, ["h", "r"]).join(entities.select("id", vec), "id")
    at = _measured(tails, ["h", "r"], "qvec", "vec").withColumn("n", F.lit(1))
    at = at.unionByName(limits.select("h", "r", "dist", F.lit(0).alias("n")))
    before = Window.partitionBy("h", "r").orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)
    nearer = at.groupBy("h", "r", "dist").agg(F.sum("n").alias("n")).withColumn("known_closer", F.sum("n").over(before))
    rank = F.col("closer") - F.coalesce("known_closer", F.lit(0)) + 1
    return (
        limits.join(closer, "q")
        .join(nearer.drop("n"), ["h", "r", "dist"], "left")
        .select("q", "h", "r", "t", rank.alias("rank"), *sums[1:])
    )


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    hits = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranks.agg(
        F.avg(1.0 / F.col("rank")).alias("mrr"),
        hits(1).alias("hits_at_1"),
        hits(10).alias("hits_at_10"),
        F.count(F.lit(1)).alias("n_test"),
    )


def draw_entity(seed: int, n: Column, *cols: str) -> Column:
    """Reproducible entity id in [0, n)."""
    digest = F.substring(hash_key(seed, *cols), 1, 13)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), n)


def corrupt_tails(
    test: DataFrame, known: DataFrame, n_entities: int, seed: int = 43, attempts: int = ATTEMPTS
) -> DataFrame:
    """(q, h, r, t): one negative per test triple whose tail is no known true tail.

    Draws are numbered; the first draw that survives an anti-join with the known triples
    is taken. Rows whose draws were all known get further draws until none is left.
    """
    truth = known.select("h", "r", "t").distinct()
    todo, done, start = test.select("q", "h", "r"), None, 0
    while True:
        tries = todo.withColumn("__k", F.explode(F.sequence(F.lit(start), F.lit(start + attempts - 1))))
        tries = tries.withColumn("t", draw_entity(seed, F.lit(n_entities), "q", "__k"))
        first = (
            tries.join(truth, ["h", "r", "t"], "left_anti")
            .groupBy("q", "h", "r")
            .agg(F.min_by("t", "__k").alias("t"))
        )
        done = first if done is None else done.unionByName(first)
        todo = todo.join(first.select("q"), "q", "left_anti")
        if todo.isEmpty():
            return done
        start += attempts
        if start > 64 * max(n_entities, 64):
            raise ValueError("some (h, r) has every entity as a known tail")
        done, todo = cut_lineage(done), cut_lineage(todo)


def quantile_grid(df: DataFrame, value: str, probs: Sequence[float], bucket: Column) -> DataFrame:
    """(prob, quantile) by linear interpolation; each distinct value only emits the
    positions that fall on it."""
    counts = value_counts(df, value)
    cum = prefix_sums(counts, value, ["n"], bucket)
    cum = with_totals(cum, counts.agg(F.sum("n").alias("__total")))
    cells = F.array(*[F.lit(float(p)) for p in probs])
    at = lambda p: (F.col("__total") - 1) * p
    start, stop = F.col("cum_n") - F.col("n"), F.col("cum_n")
    inside = lambda x: (x >= start) & (x < stop)
    touched = F.filter(cells, lambda p: inside(F.floor(at(p))) | inside(F.ceil(at(p))))
    hits = cum.withColumn("prob", F.explode(touched))
    h = at(F.col("prob"))
    lo = F.max(F.when(inside(F.floor(h)), F.col(value)))
    hi = F.max(F.when(inside(F.ceil(h)), F.col(value)))
    frac = F.max(h - F.floor(h))
    return hits.groupBy("prob").agg((lo + (hi - lo) * frac).alias("quantile"))


def classification_probs() -> list[float]:
    low, high = QUANTILE_RANGE
    return [low + (high - low) * i / (QUANTILE_STEPS - 1) for i in range(QUANTILE_STEPS)]


def classify_triples(
    positives: DataFrame, negatives: DataFrame, n_validation: int, bucket: Column | None = None
) -> DataFrame:
    """Distance threshold tuned on the first ``n_validation`` queries, scored on the rest.

    Both inputs hold (q, distance), q = 0..n-1. Candidate thresholds are 199 quantiles of
    the validation distances; the lowest with the best accuracy is used; a triple is
    accepted when its distance is strictly below it.
    """
    both = positives.select("q", "distance", F.lit(1).alias("y")).unionByName(
        negatives.select("q", "distance", F.lit(0).alias("y"))
    )
    both = cut_lineage(both)  # distances are read several times below
    bucket = F.floor(F.col("distance") * 16) if bucket is None else bucket
    val = both.filter(F.col("q") < n_validation)
    grid = quantile_grid(val, "distance", classification_probs(), bucket)
    # 199 numbers in one row: a fixed-size array next to every row
    packed = grid.agg(F.array_sort(F.collect_set("quantile")).alias("__grid"))
    v = with_totals(val, packed)
    below = F.size(F.filter("__grid", lambda t: t <= F.col("distance")))
    bins = v.groupBy(below.alias("bin")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    # threshold number i accepts a row when the row's distance is below it: bin <= i
    steps = bins.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(QUANTILE_STEPS - 1))))
    accepted = F.col("bin") <= F.col("i")
    right = F.sum(F.when(accepted, F.col("pos")).otherwise(F.col("neg")))
    thresholds = packed.select(F.posexplode("__grid").alias("i", "threshold"))
    scored = steps.groupBy("i").agg(right.alias("n_right")).join(thresholds, "i")
    best = scored.agg(
        F.max_by("threshold", F.struct(F.col("n_right"), -F.col("threshold"))).alias("tc_threshold")
    )
    test = with_totals(both.filter(F.col("q") >= n_validation), best)
    hit = F.col("distance") < F.col("tc_threshold")
    pos = F.col("y") == 1
    c = test.groupBy("tc_threshold").agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(~hit & ~pos).alias("tn"),
    )
    recall, specificity = (
        ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        ratio(F.col("tn"), F.col("fp") + F.col("tn")),
    )
    return c.select(
        ((recall + specificity) / 2).alias("tc_accuracy"),
        f1_of().alias("tc_f1"),
        "tc_threshold",
        (F.col("tp") + F.col("fn")).alias("tc_n_eval"),
    )


def initial_vectors(ids: DataFrame, n: int, dim: int, seed: int, unit: bool) -> DataFrame:
    """(id, vec): reproducible uniform vectors within sqrt(6 / (n + dim)), entities with norm at most 1."""
    bound = (6.0 / (n + dim)) ** 0.5
    draw = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id").cast("long"), i), 11)
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: draw(i) * (2 * bound / 2.0**53) - bound)
    drawn = ids.select("id", v.alias("vec"))
    return drawn.withColumn("vec", clip_norm(F.col("vec"))) if unit else drawn


def clip_norm(v: Column, limit: float = 1.0) -> Column:
    """Vector scaled to norm at most ``limit``; vector and norm are computed once."""

    def scaled(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y * y))
        factor = F.when(norm > limit, F.lit(limit) / norm).otherwise(1.0)
        return let(factor, lambda f: F.transform(x, lambda y: y * f))

    return let(v, scaled)


def train_translation(
    train: DataFrame,
    entities: DataFrame,
    relations: DataFrame,
    n_entities: int,
    dim: int = 128,
    epochs: int = 50,
    rate: float = 1e-3,
    margin: float = MARGIN,
    seed: int = 42,
    weight: str | None = None,
    batch: int = BATCH,
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Margin-ranking translation embeddings of entities and relations, by :func:`.embedding.train_on_grid`."""
    ent = initial_vectors(entities, n_entities, dim, seed, True)  # a function of the id: read once, not worth its disk
    rel = cut_lineage(initial_vectors(relations, relations.count(), dim, seed + 1, False))
    ent, rel, _ = train_on_grid(train, ent, rel, epochs, dim, rate, margin, batch, seed, weight, buckets)
    return ent, rel


def _cell_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cell, part): tails, relations, then each head followed by what is asked about it."""
    cell, held, tables, last = None, ([], []), None, None
    matrix = lambda c: np.asarray(c.flatten()).reshape(len(c), -1)

    def table(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([p.column("h").to_numpy() for p in parts])
        order = np.argsort(ids, kind="stable")
        vectors = np.concatenate([matrix(p.column("vec")) for p in parts])
        return ids[order], vectors if (np.diff(order) == 1).all() else vectors[order]

    for part in batches:
        kinds = part.column("kind").to_numpy()
        place = np.stack([part.column("cell").to_numpy(), np.minimum(kinds, HEAD)])
        edges = np.flatnonzero((np.diff(place, axis=1) != 0).any(axis=0)) + 1
        for a, b in zip([0, *edges], [*edges, part.num_rows], strict=True):
            if a == b:
                continue
            some = part.slice(a, b - a)
            if place[0, a] != cell:
                cell, held, tables, last = place[0, a], ([], []), None, None
            if kinds[a] < HEAD:
                held[kinds[a]].append(some)
                continue
            if tables is None:
                if not held[TAIL] or not held[USED]:
                    continue
                tables, held = [table(x) for x in held], ([], [])
            heads, asked = (some.filter(pa.array(kinds[a:b] == k)) for k in (HEAD, ASKED))
            mine = [*([last] if last else []), *([(heads.column("h").to_numpy(), matrix(heads.column("vec")))] if len(heads) else [])]
            if not mine:
                continue
            hids, hv = (np.concatenate(x) for x in zip(*mine, strict=True))
            last = hids[-1:], hv[-1:]
            (ids, e), (rids, r) = tables
            for i in range(0, len(asked), DISTANCES):
                rows = asked.slice(i, DISTANCES)
                h, x, t = (rows.column(c).to_numpy() for c in ("h", "r", "t"))
                at = [np.minimum(np.searchsorted(k, v), len(k) - 1) for k, v in ((hids, h), (rids, x), (ids, t))]
                there = (hids[at[0]] == h) & (rids[at[1]] == x) & (ids[at[2]] == t)
                moved = hv[at[0]].astype(np.float64) + r[at[1]]
                out = [rows.column(c) for c in ("h", "r", "t0", "sign")] + [pa.array(_row_l1(moved, e[at[2]]))]
                found = pa.RecordBatch.from_arrays(out, names=["h", "r", "t0", "sign", "dist"])
                yield found.filter(pa.array(there))


def _cells(n_entities: int, cores: int, held: int) -> tuple[int, int]:
    """(head groups, tail blocks): no block over ``held`` entities, otherwise the fewest copies with a cell a core."""
    most = max(1, n_entities // LEAST_TILE)
    tails = max(-(-n_entities // held), min(int(cores**0.5), most), 1)
    return min(-(-cores // tails), most), tails


def margin_loss(train: DataFrame, ent: DataFrame, rel: DataFrame, n_entities: int, margin=MARGIN, seed=5, block: int = BLOCK):
    """Mean hinge loss against one corrupted tail per triple.

    Vectors are dealt to cells of a group of heads and a block of tails: a task holds the block
    (``2 * block`` vectors of doubles, twice as many of floats) and heads stream past with their
    triples, so a vector is copied once per block or group, and no triple moves with a vector.
    Vectors move as floats where both tables have them as such; distances are in double precision.
    """
    base = train.select(*[F.col(c).cast("long").alias(c) for c in ("h", "r", "t")])
    single = all(dict(x.dtypes)["vec"] == "array<float>" for x in (ent, rel))
    kind, held = ("array<float>", 4 * block) if single else ("array<double>", 2 * block)
    groups, blocks = _cells(n_entities, train.sparkSession.sparkContext.defaultParallelism, held)
    of = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    drawn = draw_entity(seed, F.lit(n_entities), "h", "r", "t")
    sides = F.inline(F.array(F.struct(F.col("t").alias("__t"), F.lit(1).alias("__s")), F.struct(drawn.alias("__t"), F.lit(-1).alias("__s"))))
    asked = base.select("h", "r", F.col("t").alias("t0"), sides).withColumnsRenamed({"__t": "t", "__s": "sign"})
    asked = asked.withColumns({"cell": of("h", groups) * blocks + of("t", blocks), "kind": F.lit(ASKED), "vec": F.lit(None).cast(kind)})
    columns = ["cell", "kind", "h", "r", "t", "t0", "sign", "vec"]

    def moved(vectors: DataFrame, what: int) -> DataFrame:
        none = {c: F.lit(None).cast("int" if c == "sign" else "long") for c in ("r", "t", "t0", "sign")}
        return vectors.select("cell", F.col("id").cast("long").alias("h"), F.col("vec").cast(kind).alias("vec")).withColumns({"kind": F.lit(what), **none}).select(*columns)

    tails = ent.withColumn("__o", every(groups)).withColumn("cell", F.col("__o") * blocks + of("id", blocks))
    heads = ent.withColumn("__o", every(blocks)).withColumn("cell", of("id", groups) * blocks + F.col("__o"))
    used = rel.join(asked.select("cell", F.col("r").alias("id")).distinct(), "id")
    rows = moved(tails, TAIL).unionByName(moved(used, USED)).unionByName(moved(heads, HEAD)).unionByName(asked.select(*columns))
    # more partitions than cells, so that few cells meet in one
    cells = rows.repartition(4 * groups * blocks, "cell").sortWithinPartitions("cell", F.least("kind", F.lit(HEAD)), "h", "kind")
    measured = cells.mapInArrow(_cell_distances, "h long, r long, t0 long, sign int, dist double")
    # repeated triples have the same distances: a mean per triple counts each of its copies
    good, bad = (F.avg(F.when(F.col("sign") == s, F.col("dist"))) for s in (1, -1))
    per = measured.groupBy("h", "r", "t0").agg(good.alias("gd"), bad.alias("bd"), F.count_if(F.col("sign") == 1).alias("n"))
    hinge = F.greatest(F.lit(margin) + F.col("gd") - F.col("bd"), F.lit(0.0))
    return per.agg((F.sum(hinge * F.col("n")) / F.sum("n")).alias("loss"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def link_prediction(
    test: DataFrame, entities: DataFrame, relations: DataFrame, known: DataFrame, n_entities: int,
    n_test: int,
) -> DataFrame:
    """MRR, hits, and triple classification of one trained variant in one row."""
    ranks = ranking_metrics(filtered_tail_ranks(test, entities, relations, known))
    pos = triple_distance(test, entities, relations)
    neg = triple_distance(corrupt_tails(test, known, n_entities), entities, relations)
    return null_safe_join(ranks, classify_triples(pos, neg, n_test // 5), [])
