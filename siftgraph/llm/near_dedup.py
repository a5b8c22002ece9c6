"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

1. Every document gets a SuperMinHash signature of its distinct word shingles, the set size
   and a 128-bit hash of the set. Documents with equal sets form one class; only its
   smallest document goes on, so copies cost one aggregation.
2. Bands of the signature file the classes into buckets. In each bucket every class is
   paired with the smallest one; the signatures drop clearly different pairs and the full
   shingle sets decide the rest.
3. Union-find (per partition, then star contraction) groups the links. Classes of buckets
   that still hold several groups are filed under their rarest shingles (prefix filter), and
   pairs across groups that meet there are verified too, so a link is not lost because it
   misses the bucket's smallest class.

With 40 bands of 4, a pair at similarity 0.75 shares no band with probability 3e-7. The
estimate from all 192 places has there a standard deviation of 0.022 for unions of 100
shingles and 0.031, the binomial one, for large unions. The test at 0.55 drops such a pair
with at most 8e-10 (binomial tail), far below the banding, whatever the set sizes; set sizes
alone exclude a pair exactly where the smaller set is less than 0.75 of the larger.

Scale: texts are shuffled once and only those with a partner candidate are kept; a class
that many others pair with is split over salted groups of ``MEMBERS``; all joins are on
ids or shingles; links stay distributed. Shingles are counted and posted only for classes of
buckets that are still mixed; no bucket is held in one task.

Defined cases: null, empty and blank texts have an empty set and no link; fewer words than
a shingle make one shingle; rows with one doc_id are one node; a null doc_id comes
first and is its own name. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .tables import stored
from .words import hash_words, mix, shingles, slices, split_words

SHINGLE = 5  # words
M = 192  # signature length
BAND = 4
BANDS = 40  # the other places only sharpen the estimate
DEVIATIONS = 6.4  # below the asked similarity, in binomial standard deviations: not verified
PERCENT = 75
MEMBERS = 256  # texts verified per group against one hub
SIGN_BYTES = 1 << 20  # text bytes signed at once; a permutation takes M bytes per open shingle
FIRST = -(2**63)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_HALF = np.uint64(32)


def least_alike(percent: int = PERCENT, m: int = M) -> float:
    """Share of equal signature places below which a pair is not verified: 0.55 for 75 and 192."""
    p = percent / 100
    return p - DEVIATIONS * (p * (1 - p) / m) ** 0.5


def _draw(seed: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Step ``j`` of every element: the slot it swaps with (j..m-1), and its value (rank, uniform)."""
    x = mix(seed + np.uint64(int(_STEP) * (j + 1) % (1 << 64)))
    slot = ((x >> _HALF) * np.uint64(m - j)) >> _HALF
    return slot.astype(np.int64) + j, (x & _LOW) | np.uint64(j << 32)


def superminhash(elements: np.ndarray, offsets: np.ndarray, m: int = M) -> np.ndarray:
    """Signatures (documents x m, uint16) of element sets given as one array with offsets.

    Each element ranks the m places by its own random permutation; a place keeps the
    smallest rank plus uniform. All elements take step 0, 1, ... together, and those of a
    document stop once no place of it can improve.
    """
    n = len(offsets) - 1
    best = np.full(n * m, _FULL)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    seed = mix(elements)
    first, value = _draw(seed, 0, m)
    np.minimum.at(best, owner * m + first, value)
    perm = second = None
    for j in range(1, m):
        worst = best.reshape(n, m).max(axis=1)
        open_ = (worst >> _HALF >= np.uint64(j))[owner]
        if not open_.any():
            break
        if not open_.all():
            owner, seed, first = owner[open_], seed[open_], first[open_]
            if perm is not None:
                perm = perm[open_]
            elif second is not None:
                second = second[open_]
        slot, value = _draw(seed, j, m)
        if j == 1:
            place, second = np.where(slot == first, 0, slot), slot
        else:
            rows = np.arange(len(owner))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(owner), 1))
                for at, other in ((0, first), (1, second)):
                    held = perm[rows, other]
                    perm[rows, other] = perm[:, at]
                    perm[:, at] = held
            place = perm[rows, slot].astype(np.int64)
            perm[rows, slot] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(best, owner * m + place, value)
    return (mix(best) >> np.uint64(48)).astype(np.uint16).reshape(n, m)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, as one array with offsets."""
    words = split_words(texts, lower=True)
    hashes, offsets = shingles(words, hash_words(words), size)
    parts = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        part = np.sort(hashes[a:b])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        parts.append(part)
    sizes = np.array([len(p) for p in parts], np.int64)
    joined = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return joined, np.concatenate([[0], np.cumsum(sizes)])


def _rows_of(values: np.ndarray) -> pa.Array:
    """One binary value per row of a 2-d array."""
    n, width = len(values), values.shape[1] * values.itemsize
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(values.tobytes())]
    )


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _describe(size: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SIGN_BYTES):
            sets, offsets = shingle_sets(part.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc"),
                    pa.array(np.diff(offsets)),
                    pa.array(_sums(mix(sets), offsets)),
                    pa.array(_sums(mix(sets ^ _STEP), offsets)),
                    _rows_of(superminhash(sets, offsets, m)),
                ],
                names=["doc", "n", "a", "b", "sig"],
            )

    return run


def _bands(band: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            reps = part.column("rep").to_numpy()
            sig = _signatures(part.column("sig"))
            for k in range(bands):
                key = np.full(len(reps), np.uint64(int(_STEP) * (k + 1) % (1 << 64)))
                for place in sig[:, k * band : (k + 1) * band].T:
                    key = mix(key + place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(reps), pa.array(np.full(len(reps), k, np.int16))],
                    names=["key", "rep", "band"],
                )

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _alike(least: float):
    """Pairs whose signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                near = (_signatures(part.column("sig_a")) == _signatures(part.column("sig_b"))).mean(axis=1) >= least
                yield part.select(["hub", "rep"]).filter(pa.array(near))

    return run


def _filed(size: int):
    """One row per shingle of each text: (shingle, doc, mark of the set, set size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SIGN_BYTES):
            sets, offsets = shingle_sets(part.column("text"), size)
            sizes = np.diff(offsets)
            spread = lambda values: pa.array(np.repeat(values, sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sets.view(np.int64)),
                    spread(part.column("doc").to_numpy()),
                    spread(_sums(mix(sets), offsets)),
                    spread(sizes),
                ],
                names=["shingle", "doc", "mark", "n"],
            )

    return run


def across_groups(texts: DataFrame, groups: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(hub, rep): every pair from different groups that its full sets may still link.

    Prefix filter: shingles are ordered by how many of these texts hold them, rarest first.
    Sets of x and y shingles with the asked similarity share at least
    ``o = percent / (100 + percent) * (x + y)``, so the first shared one lies at a place of at
    most ``x - o`` and ``y - o``. Texts that share a template but have enough shingles of their
    own meet nowhere. A posting pairs the rows outside its largest group with all rows, so the
    members of one group are never paired with each other. Shingles found once are counted,
    not sent on. ``texts`` has (doc, text), ``groups`` (rep, comp).
    """
    members = texts.join(groups.select(F.col("rep").alias("doc")), "doc", "left_semi")
    filed = stored(members.mapInArrow(_filed(size), "shingle bigint, doc bigint, mark bigint, n bigint"), "filed")
    often = filed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rarest_last = Window.partitionBy("doc", "mark").orderBy(F.col("df").desc(), F.col("shingle").desc())
    placed = filed.join(often, "shingle").withColumn("place", F.col("n") - F.row_number().over(rarest_last))
    prefix = placed.filter(100 * F.col("place") <= (100 - percent) * F.col("n"))
    posted = prefix.join(groups.withColumnRenamed("rep", "doc"), "doc").select("shingle", "doc", "comp", "n", "place")
    posted = stored(posted, "postings")
    counts = posted.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = counts.groupBy("shingle").agg(
        F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")
    )
    shared = largest.filter("comps > 1").select("shingle", F.col("top.comp").alias("main"))
    few = posted.join(shared, "shingle").filter("comp <> main").select(*(F.col(c).alias(f"few_{c}") for c in [*posted.columns, "main"]))
    least = percent * (F.col("n") + F.col("few_n"))
    fits = lambda n, place: (100 + percent) * (F.col(n) - F.col(place)) >= least
    met = few.join(
        posted,
        (F.col("shingle") == F.col("few_shingle"))
        & (F.col("comp") != F.col("few_comp"))
        & ((F.col("comp") == F.col("few_main")) | (F.col("few_doc") < F.col("doc")))
        & fits("n", "place")
        & fits("few_n", "few_place"),
    )
    return met.select(F.least("doc", "few_doc").alias("hub"), F.greatest("doc", "few_doc").alias("rep")).distinct()


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (hub, salt, member); the hub itself is member false."""
        now, hub_set = None, None
        for part in slices(batches, "text"):
            sets, offsets = shingle_sets(part.column("text"), size)
            hubs, salts, docs, member = (part.column(c).to_pylist() for c in ("hub", "salt", "doc", "member"))
            left, right = [], []
            for i, (hub, salt, doc, is_member) in enumerate(zip(hubs, salts, docs, member, strict=True)):
                mine = sets[offsets[i] : offsets[i + 1]]
                if not is_member:
                    now, hub_set = (hub, salt), mine.copy()
                    continue
                if now != (hub, salt):
                    raise ValueError("a group came without its hub")
                place = np.searchsorted(hub_set, mine)
                place[place == len(hub_set)] = 0
                shared = int((hub_set[place] == mine).sum()) if len(hub_set) else 0
                if shared and 100 * shared >= percent * (len(mine) + len(hub_set) - shared):
                    left.append(hub)
                    right.append(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["hub", "rep"]
            )

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: at most one link per node is left."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for part in batches:
        for a, b in zip(part.column("hub").to_pylist(), part.column("rep").to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    links = [(root(x), x) for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["hub", "rep"]
    )


PAIR = "hub bigint, rep bigint"


def group_links(links: DataFrame) -> DataFrame:
    """(node, component): union-find inside partitions, star contraction between them."""
    return connected_components(links.mapInArrow(_forest, PAIR), "hub", "rep")


def _verified(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; ``texts`` has (doc, text)."""
    counts = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    groups = F.ceil(F.col("n") / MEMBERS).cast("int")
    salted = pairs.join(counts, "hub").select(
        "hub", F.pmod(F.xxhash64("rep"), groups).cast("int").alias("salt"), F.col("rep").alias("doc"), F.lit(True).alias("member")
    )
    # groups without a member get no hub row either way: they are only read and passed over
    hubs = counts.select(
        "hub", F.explode(F.sequence(F.lit(0), groups - 1)).alias("salt"), F.col("hub").alias("doc"), F.lit(False).alias("member")
    )
    roles = salted.unionByName(hubs)
    rows = texts.join(roles, "doc").select("hub", "salt", "member", "doc", "text")
    sorted_rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member", "doc")
    return sorted_rows.mapInArrow(_verify(size, percent), PAIR)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, m: int = M, band: int = BAND, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (smallest document with the same set), per document."""
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("doc"),
        F.col("text").cast("string").alias("text"),
    )
    signed = stored(keyed.mapInArrow(_describe(size, m), "doc bigint, n bigint, a bigint, b bigint, sig binary"), "signatures")
    keys = ["n", "a", "b"]
    classes = signed.filter("n > 0").groupBy(*keys).agg(F.min("doc").alias("rep"), F.any_value("sig").alias("sig"))
    # a document id with several texts stands for several classes: the node keeps each of them
    reps = stored(classes, "classes")

    buckets = reps.select("rep", "sig").mapInArrow(_bands(band, bands), "key bigint, rep bigint, band smallint")
    in_bucket = Window.partitionBy("key")
    shared = buckets.withColumns(
        {"hub": F.min("rep").over(in_bucket), "k": F.count(F.lit(1)).over(in_bucket)}
    ).filter("k > 1")
    shared = stored(shared, "buckets")
    sigs = reps.select("rep", "n", "sig")
    pairs = shared.filter("hub <> rep").select("hub", "rep").distinct()
    pairs = _likely(pairs, sigs, percent, least_alike(percent, m))
    pairs = stored(pairs, "pairs")
    wanted = shared.select(F.col("rep").alias("doc")).distinct()
    texts = stored(
        keyed.join(wanted, "doc", "left_semi").dropDuplicates(["doc", "text"]), "texts"
    )
    links = stored(_verified(texts, pairs, size, percent), "links")
    grouped = group_links(links)

    # buckets with several groups: pairs that the smallest class does not decide
    placed = shared.filter("k > 2").join(grouped, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp")
    )
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    open_ = stored(placed.join(mixed.select("key"), "key").select("rep", "comp").distinct(), "open")
    rest = across_groups(texts, open_, size, percent).join(pairs, ["hub", "rep"], "left_anti")
    rest = stored(_likely(rest, sigs, percent, least_alike(percent, m)), "rest")
    if not rest.isEmpty():
        links = links.unionByName(stored(_verified(texts, rest, size, percent), "more_links"))
        grouped = group_links(links)

    named = reps.select(*keys, "rep").join(grouped, F.col("rep") == F.col("node"), "left").select(
        *keys, "rep", F.coalesce("component", "rep").alias("component")
    )
    out = signed.select("doc", *keys).join(named, keys, "left")
    first = lambda c: F.when(F.col(c) != FIRST, F.col(c))
    return out.withColumns(
        {"component": F.coalesce("component", "doc"), "rep": F.coalesce("rep", "doc")}
    ).select(
        first("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        first("component").alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
        first("rep").alias("class_id"),
    )


def _likely(pairs: DataFrame, sigs: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs that the set sizes allow and whose signatures agree often enough."""
    a = sigs.select(F.col("rep").alias("hub"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    b = sigs.select("rep", F.col("sig").alias("sig_b"), "n")
    fits = 100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")
    placed = pairs.join(a, "hub").join(b, "rep").filter(fits)
    return placed.select("hub", "rep", "sig_a", "sig_b").mapInArrow(_alike(least), PAIR)


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` that name their group, with their own columns.

    Of identical rows (same id and text) one stays; rows without a word all stay.
    """
    kept = near_duplicates(docs, size, percent).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    stay = docs.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__kept")), "left_semi")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    again = Window.partitionBy("doc_id", F.crc32(text.cast("binary"))).orderBy(F.lit(0))
    numbered = stay.withColumn("__again", F.row_number().over(again))
    return numbered.filter((F.col("__again") == 1) | ~text.rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns)
