"""Evidence graph: edges, indexing, degrees, components, neighbourhoods, variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ensemble import mean_score, positive_signals, published_label
from .joins import in_key_parts, withhold_evaluation
from .ranking import (
    exact_quantiles,
    first_per_key,
    hash_key,
    null_safe_join,
    ordered_rank,
)
from .sampling import drop_triples, exact_sample, shared_vocabulary_test, size_matched_control

EDGE_COLUMNS = ("subject", "predicate", "object", "docid", "n_signals_pos", "mean_score")
MIN_CONFIDENCE = 1e-4
MAX_ROUNDS = 64


def evidence_edges(
    df: DataFrame,
    gold: DataFrame,
    consensus: Sequence[str],
    scores: Sequence[str],
    signals: Sequence[str] | None = None,
) -> DataFrame:
    """Edges of rows every consensus signal accepts, evaluation rows withheld.

    ``n_signals_pos`` counts all ``signals`` that say 1.
    """
    return accepted_edges(withhold_evaluation(df, gold), consensus, scores, signals)


def accepted_edges(
    kept: DataFrame, consensus: Sequence[str], scores: Sequence[str], signals: Sequence[str] | None = None
) -> DataFrame:
    """Edges of rows every consensus signal accepts, of rows without evaluation rows."""
    return kept.filter(published_label(consensus) == 1).select(
        "subject",
        "predicate",
        "object",
        "docid",
        positive_signals(signals or consensus).alias("n_signals_pos"),
        mean_score(scores).alias("mean_score"),
    )


def node_names(edges: DataFrame, head="subject", tail="object") -> DataFrame:
    return edges.select(F.explode(F.array(head, tail)).alias("name")).distinct()


def dense_ids(names: DataFrame, column: str = "name", seed: int = 0) -> DataFrame:
    """Dense ids 0..n-1 in md5 order; reproducible, no one-task numbering."""
    d = names.select(column).distinct().withColumn("__h", hash_key(seed, column))
    return ordered_rank(d, "__h", [column], name="id").drop("__h")


def index_triples(edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges with h, r, t ids joined in."""
    e = entities.select(F.col("name"), F.col("id"))
    heads = e.select(F.col("name").alias("subject"), F.col("id").alias("h"))
    tails = e.select(F.col("name").alias("object"), F.col("id").alias("t"))
    rels = relations.select(F.col("name").alias("predicate"), F.col("id").alias("r"))
    return edges.join(heads, "subject").join(tails, "object").join(rels, "predicate")


def degrees(edges: DataFrame, head="subject", tail="object") -> DataFrame:
    """Degree per node; both ends count, so a self-loop counts twice."""
    ends = edges.select(F.explode(F.array(head, tail)).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_summary(edges: DataFrame, head="subject", tail="object") -> DataFrame:
    d = degrees(edges, head, tail)
    basic = d.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"),
    )
    median = exact_quantiles(d, "degree", {"median_degree": 0.5}, F.floor(F.col("degree") / 16))
    return null_safe_join(basic, median, [])


def connected_components(
    edges: DataFrame, head="subject", tail="object", max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """(node, component) where the component is named by its smallest node.

    Alternates two star operations until nothing changes: every node points its larger
    neighbours, then its smaller ones, to the smallest node it knows. Both need one
    pre-aggregated minimum per node and one equi-join, never a node's neighbour list,
    and the number of rounds grows with the logarithm of the graph. State is
    checkpointed each round; the edges are read once, into parts that keep their size.
    """
    up = F.col(head) >= F.col(tail)  # null stays where it is
    one, other = (F.when(up, F.col(a)).otherwise(F.col(b)) for a, b in ((head, tail), (tail, head)))
    cores = edges.sparkSession.sparkContext.defaultParallelism
    linked = in_key_parts(edges.select(one.alias("u"), other.alias("v")), ["u", "v"], cores)
    linked = cut_lineage(linked.distinct())
    nodes = node_names(linked, "u", "v").withColumnRenamed("name", "node")
    pairs = linked.filter("u <> v")
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        moved = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        pairs = cut_lineage(small)
        state = tuple(
            pairs.agg(
                F.count(F.lit(1)),
                F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
            ).first()
        )
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = pairs.groupBy("u").agg(F.min("v").alias("component"))
    joined = nodes.join(labels, nodes["node"] == labels["u"], "left")
    return joined.select("node", F.coalesce("component", "node").alias("component"))


def component_summary(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    s = sizes.agg(
        F.count(F.lit(1)).alias("n_components"),
        F.max("size").alias("largest"),
        F.sum("size").alias("n_nodes"),
    )
    return s.withColumn("largest_share", F.col("largest") / F.col("n_nodes"))


def graph_summary(edges: DataFrame, frequent: int = 100) -> DataFrame:
    """One row: edges, unique triples, duplicates, relations (all, frequent), documents.

    Triples and documents are grouped in parts that keep their size as the tables grow.
    """
    keys, cores = ["subject", "predicate", "object"], edges.sparkSession.sparkContext.defaultParallelism
    triples = in_key_parts(edges.select(*keys), keys, cores).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per_relation = triples.groupBy("predicate").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("unique_triples")
    )
    a = per_relation.agg(
        F.sum("n").alias("n_edges"),
        F.sum("unique_triples").alias("unique_triples"),
        F.count(F.lit(1)).alias("n_relations"),
        F.count_if(F.col("n") >= frequent).alias("frequent_relations"),
    )
    docs = in_key_parts(edges.select("docid"), ["docid"], cores).distinct().agg(F.count("docid").alias("source_docs"))
    out = null_safe_join(a, docs, [])
    return out.withColumn("n_duplicates", F.col("n_edges") - F.col("unique_triples"))


def top_relations(edges: DataFrame, n: int = 5) -> DataFrame:
    counts = edges.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "predicate").limit(n)


def ego_network(edges: DataFrame, entity: str, top: int | None = 10) -> DataFrame:
    """Edges touching an entity, best-scored per (predicate, neighbour), top-k by score."""
    touching = edges.filter((F.col("subject") == entity) | (F.col("object") == entity))
    other = F.when(F.col("subject") == entity, F.col("object")).otherwise(F.col("subject"))
    best = first_per_key(
        touching.withColumn("neighbor", other),
        ["predicate", "neighbor"],
        [F.col("mean_score").desc(), "docid", "subject", "object"],
    )
    if top is None:
        return best
    return best.orderBy(F.col("mean_score").desc(), "predicate", "neighbor").limit(top)


def unique_triples(triples: DataFrame) -> DataFrame:
    return triples.select("h", "r", "t").distinct()


def triple_confidence(triples: DataFrame, score: str = "mean_score") -> DataFrame:
    """Best mention score per triple, at least 1e-4."""
    best = triples.groupBy("h", "r", "t").agg(F.max(score).alias("confidence"))
    return best.withColumn("confidence", F.greatest("confidence", F.lit(MIN_CONFIDENCE)))


def training_variants(
    triples: DataFrame, accepted: str, n_test: int, score: str = "mean_score", seed: int = 42
) -> dict[str, DataFrame]:
    """raw, denoised, control and weighted training graphs and the shared test triples.

    The split is made on unique triples, so no mention of a test triple stays in any
    training graph. Mentions are aggregated to unique triples once; that table and the
    test pick are checkpointed because every variant reads them.
    """
    keys = ["h", "r", "t"]
    unique = cut_lineage(
        triples.groupBy(*keys).agg(
            F.max(F.col(accepted)).alias("__ok"),
            F.greatest(F.max(score), F.lit(MIN_CONFIDENCE)).alias("confidence"),
        )
    )
    picked = cut_lineage(exact_sample(unique.filter("__ok").select(*keys), n_test, keys, seed))
    train = cut_lineage(drop_triples(unique, picked))
    raw, denoised = train.select(*keys), train.filter("__ok").select(*keys)
    control = cut_lineage(size_matched_control(raw, denoised, keys, seed + 1))
    return {
        "raw": raw,
        "denoised": denoised,
        "control": control,
        "weighted": train.select(*keys, "confidence"),
        "test": shared_vocabulary_test(picked, [raw, denoised, control]),
    }


def known_tails(triples: DataFrame) -> DataFrame:
    """(h, r, t) of the full graph, kept as rows for joins."""
    return unique_triples(triples)
