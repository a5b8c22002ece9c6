"""End-to-end flows built from the operators: corpus to release, benchmark, graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import threshold_pred
from ..functions.text import DEFAULT, Markup, clean_frame
from ..functions.verbalize import basic_relation, template_relation
from ..operators import bootstrap, ensemble, graph, linkpred, metrics, sampling
from ..operators.joins import NATURAL_KEY, attach_scores, attach_signal, withhold_and_dedupe
from ..sources.tables import release_tables


def prepare_corpus(
    raw: DataFrame,
    gold: DataFrame,
    row_id: str = "row_id",
    keys: Sequence[str] = NATURAL_KEY,
    templates: DataFrame | None = None,
    markup: Markup = DEFAULT,
) -> DataFrame:
    """Withhold evaluation rows, keep first occurrences, clean, add hypothesis columns.

    Withholding and deduplication run on the raw keys before the text is touched, so
    dropped rows are never cleaned.
    """
    kept = withhold_and_dedupe(raw, gold, keys, row_id)
    cleaned = clean_frame(kept, markup=markup)
    return template_relation(cleaned, templates).withColumn("basic_relation", basic_relation())


def merge_signals(
    base: DataFrame,
    scored: dict[str, tuple[DataFrame, float]],
    keyed: dict[str, tuple[DataFrame, str, str]] | None = None,
    subsets: dict[str, Sequence[str]] | None = None,
    unanimous: dict[str, Sequence[str]] | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """Wide signal table.

    ``scored``: name -> (row_id, score) table and threshold. ``keyed``: name -> table with
    the natural key, its score and its label column. ``subsets`` and ``unanimous`` name
    further votes over signal names.
    """
    out = base
    for name, (table, cut) in scored.items():
        out = attach_scores(out, table, name, row_id)
        out = out.withColumn(f"{name}__pred", threshold_pred(f"{name}__score", cut))
    for name, (table, score, label) in (keyed or {}).items():
        signal = table.select(
            *NATURAL_KEY, F.col(score).alias(f"{name}__score"), F.col(label).cast("tinyint").alias(f"{name}__pred")
        )
        out = attach_signal(out, signal, [f"{name}__score", f"{name}__pred"])
    preds = ensemble.signal_columns(out)
    out = out.withColumn("vote_all__pred", ensemble.majority_flag(preds))
    for name, members in (subsets or {}).items():
        out = out.withColumn(f"{name}__pred", ensemble.majority_flag([f"{m}__pred" for m in members]))
    for name, members in (unanimous or {}).items():
        out = out.withColumn(f"{name}__pred", ensemble.unanimous_flag([f"{m}__pred" for m in members]))
    return out


def publish(
    signals: DataFrame,
    gold: DataFrame,
    consensus: Sequence[str],
    scores: Sequence[str],
    all_signals: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Release tables and evidence edges, evaluation rows withheld from all of them."""
    tables = release_tables(signals, gold, consensus)
    tables["edges"] = graph.evidence_edges(signals, gold, consensus, scores, all_signals)
    return tables


def evaluate_runs(
    runs: DataFrame, config: str, predicate: str = "predicate", min_n: int = 10, n_boot: int = bootstrap.N_BOOT
) -> DataFrame:
    """Per configuration: metrics, interval, macro F1 over all and over large predicates."""
    p, g = F.col("pred") == "1", F.col("label") == 1
    table = metrics.hard_label_metrics(runs, [config])
    ci = bootstrap.bootstrap_f1(runs, p, g, [config], n_boot).drop("f1")
    macro = metrics.predicate_macro_f1(runs, p, g, [config], predicate)
    large = metrics.predicate_macro_f1(runs, p, g, [config], predicate, min_n)
    return (
        table.join(ci, config)
        .join(macro.withColumnRenamed("macro_f1", "macro_f1_all"), config)
        .join(large.withColumnRenamed("macro_f1", f"macro_f1_min{min_n}"), config)
    )


def graph_statistics(edges: DataFrame) -> DataFrame:
    """One row of graph statistics: counts, degrees, components."""
    from ..operators.ranking import with_totals

    out = with_totals(graph.graph_summary(edges), graph.degree_summary(edges))
    comps = graph.component_summary(graph.connected_components(edges)).drop("n_nodes")
    return with_totals(out, comps)


def compare_training_graphs(
    triples: DataFrame,
    accepted: str,
    entities: DataFrame,
    relations: DataFrame,
    n_test: int,
    score: str = "mean_score",
    variants: Sequence[str] = ("raw", "denoised", "control", "weighted"),
    **training,
) -> DataFrame:
    """Train one embedding per variant and score all on the shared test triples."""
    graphs = graph.training_variants(triples, accepted, n_test, score)
    n_entities = entities.count()
    test = graph.dense_ids(
        graphs["test"].select(F.concat_ws("|", "h", "r", "t").alias("name"))
    ).withColumnRenamed("id", "q")
    named = graphs["test"].withColumn("name", F.concat_ws("|", "h", "r", "t"))
    test = named.join(test, "name").select("q", "h", "r", "t")
    size = test.count()
    rows = {}
    for name in variants:
        weight = "confidence" if name == "weighted" else None
        e, r = linkpred.train_translation(
            graphs[name], entities, relations, n_entities, weight=weight, **training
        )
        rows[name] = linkpred.link_prediction(
            test, e, r, graph.known_tails(triples), n_entities, size
        )
    return sampling.union_tagged(rows, "variant")
