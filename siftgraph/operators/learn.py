"""Scoring and cross-training at corpus scale with pyspark.ml and pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, WS
from ..functions.verbalize import typed_pair
from ..session import cut_lineage
from .bayes import fit, packed_counts, predict
from .ensemble import vote_summary
from .metrics import class_macro_f1, hard_label_metrics
from .sampling import capped_sample, label_set, other_splits, predicate_folds, train_split

FEATURES = 1 << 14
FOLD_COUNTS = (3, 5, 7, 10)


def hypothesis_overlap(hypothesis, text) -> Column:
    """Native scorer: share of distinct hypothesis tokens found in the passage."""

    def tokens(c):
        c = F.col(c) if isinstance(c, str) else c
        return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)))

    h = tokens(hypothesis)
    shared = F.size(F.array_intersect(h, tokens(text))).cast("double")
    return F.when(F.size(h) == 0, F.lit(0.0)).otherwise(shared / F.size(h))


Scorer = Callable[[pd.DataFrame], pd.Series]


def score_pairs(
    df: DataFrame, load: Callable[[], Scorer], row_id: str, columns: Sequence[str], id_type: str = "string"
) -> DataFrame:
    """(row_id, score) from a user scorer, loaded once per task, fed Arrow batches.

    Rows are ordered by text length inside a partition, so a batch holds similar lengths.
    """
    longest = F.length(F.col(columns[0])).desc()
    data = df.select(row_id, *columns).sortWithinPartitions(longest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for pdf in batches:
            scores = scorer(pdf).astype("float64")
            if len(scores) != len(pdf):
                raise ValueError(f"{len(scores)} scores for {len(pdf)} rows")
            yield pd.DataFrame({row_id: pdf[row_id], "score": scores})

    return data.mapInPandas(run, f"`{row_id}` {id_type}, score double")


def remaining_rows(df: DataFrame, scored: DataFrame, row_id: str) -> DataFrame:
    """Rows without a score yet: an interrupted scoring run continues with these."""
    return df.join(scored.select(row_id), row_id, "left_anti")


def predicate_features(df: DataFrame, vocabulary: DataFrame, row_id: str, text: str = "text"):
    """(row_id, predicate, label, words) for rows whose predicate is in the vocabulary.

    The vocabulary holds the classes of a classifier, one row each, and is broadcast: texts
    are never dealt by predicate.
    """
    v = F.broadcast(vocabulary.select("predicate", F.col("id").cast("double").alias("label")))
    body = F.concat_ws(" ", typed_pair(), F.col(text))
    rows = df.select(row_id, "predicate", body.alias("body"))
    return rows.join(v, "predicate").select(row_id, "predicate", "label", "body")


def feature_table(rows: DataFrame, row_id: str, hashed: int = FEATURES) -> tuple[DataFrame, PipelineModel]:
    """Word counts of the rows of :func:`predicate_features` in ``hashed`` buckets, stored once, and their encoder.

    Every k, fold and model reads the stored table.
    """
    tokens = RegexTokenizer(inputCol="body", outputCol="tokens", pattern=f"[{WS}]+")
    counts = HashingTF(inputCol="tokens", outputCol="features", numFeatures=hashed)
    encoder = Pipeline(stages=[tokens, counts]).fit(rows)
    return cut_lineage(encode_rows(rows, encoder, row_id)), encoder


def encode_rows(rows: DataFrame, encoder: PipelineModel, row_id: str) -> DataFrame:
    return encoder.transform(rows).select(row_id, "predicate", "label", "features")


def classifier() -> NaiveBayes:
    """Multinomial naive Bayes on word counts, trained and applied in the JVM."""
    return NaiveBayes(labelCol="label", featuresCol="features", smoothing=1.0)


def cross_train_votes(
    features: DataFrame, row_id: str, k: int, gold: DataFrame | None = None, seed: int = 42, model=None
) -> tuple[DataFrame, DataFrame | None]:
    """Votes of k models, each trained on one fold and applied to all other folds.

    ``features`` and ``gold`` are stored feature tables. Folds are ranked from ids alone,
    joined and stored. Returns long votes (row_id, fold, voter, correct) of the corpus, k - 1
    per row, and of the gold rows, k per row. The loop runs over folds only.
    """
    folds = predicate_folds(features.select(row_id, "predicate"), row_id, k, "predicate", seed)
    folded = cut_lineage(features.join(folds.select(row_id, "fold"), row_id))
    votes, gold_votes = None, None
    for i in range(k):
        fitted = (model or classifier()).fit(train_split(folded, i))
        correct = (F.col("prediction") == F.col("label")).cast("int").alias("correct")
        v = fitted.transform(other_splits(folded, i)).select(
            row_id, "predicate", "fold", F.lit(i).alias("voter"), correct
        )
        votes = v if votes is None else votes.unionByName(v)
        if gold is not None:
            g = fitted.transform(gold).select(row_id, F.lit(i).alias("voter"), correct)
            gold_votes = g if gold_votes is None else gold_votes.unionByName(g)
    return votes, gold_votes


def counted_votes(
    rows: DataFrame, words: DataFrame, row_id: str, ks: Sequence[int],
    gold: DataFrame | None = None, gold_words: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """(row_id, k, voter, correct): :func:`cross_train_votes` of naive Bayes over all words (:mod:`.bayes`).

    Votes on the ``gold`` rows if they are given, else on the rows of the other folds. All k
    are trained and applied together. Words outside the corpus are not read.
    """
    folded = None
    for k in ks:
        folds = predicate_folds(rows.select(row_id, "predicate"), row_id, k, "predicate", seed)
        folds = folds.select(row_id, F.lit(k).alias("k"), F.col("fold").cast("int").alias("fold"))
        folded = folds if folded is None else folded.unionByName(folds)
    folded = cut_lineage(folded.join(rows.select(row_id, "label"), row_id).withColumn("code", _voter_code("fold")))
    model, _ = fit(words, folded.select(row_id, "label", F.col("code").alias("voter")), row_id)
    voter = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("fold")
    if gold is None:
        own, asked = words, folded.withColumnRenamed("fold", "own").select(row_id, "label", "k", "own", voter).filter("own <> fold")
    else:
        own = gold_words
        every = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
        asked = gold.select(row_id, "label", every).select(row_id, "label", "k", voter)
    asked = asked.withColumn("voter", _voter_code("fold"))
    got = asked.join(predict(model, asked, own, row_id), [row_id, "voter"])
    correct = (F.col("prediction") == F.col("label")).cast("int").alias("correct")
    return got.select(row_id, "k", F.col("fold").alias("voter"), correct)


def _voter_code(fold: str) -> Column:
    return F.shiftleft("k", 16) + F.col(fold)


def cross_train_denoise(
    df: DataFrame, vocabulary: DataFrame, row_id: str, k: int, text: str = "text", seed: int = 42,
    hashed: int | None = FEATURES,
) -> DataFrame:
    """Vote counts, share and cleaned label per corpus row.

    Rows outside the vocabulary have no vote, hence share 0 and label 0. Without ``hashed``
    all words count.
    """
    rows = predicate_features(df, vocabulary, row_id, text)
    if hashed:
        votes, _ = cross_train_votes(feature_table(rows, row_id, hashed)[0], row_id, k, seed=seed)
    else:
        votes = counted_votes(rows, packed_counts(rows, row_id), row_id, [k], seed=seed)
    summary = vote_summary(votes, [row_id])
    out = df.select(row_id, "predicate").join(summary, row_id, "left")
    zero = {"vote_correct": 0, "vote_total": 0, "vote_fraction": 0.0, "cleaned_label": 0}
    return out.fillna(zero)


def cross_train_sweep(
    df: DataFrame, gold: DataFrame, vocabulary: DataFrame, row_id: str, label: str,
    ks: Sequence[int] = FOLD_COUNTS, models: dict | None = None, text: str = "text", hashed: int | None = FEATURES,
) -> DataFrame:
    """Per model and k: metrics of each fold model and of the vote (share > 0.5) on gold rows.

    ``models`` names unfitted estimators; the features are stored once for all of them. With
    neither ``models`` nor ``hashed``, naive Bayes counts all words.
    """
    rows, gold_rows = (predicate_features(x, vocabulary, row_id, text) for x in (df, gold))
    truth = gold.select(row_id, F.col(label).cast("int").alias("label_true"))
    if not hashed and not models:
        words, gold_words = packed_counts(rows, row_id), packed_counts(gold_rows, row_id)
        votes = counted_votes(rows, words, row_id, ks, gold_rows, gold_words)
        return _sweep_metrics(votes.withColumn("model", F.lit("bayes")), truth, row_id)
    features, encoder = feature_table(rows, row_id, hashed or FEATURES)
    gold_features = cut_lineage(encode_rows(gold_rows, encoder, row_id))
    out = None
    for name, model in (models or {"bayes": classifier()}).items():
        for k in ks:
            _, votes = cross_train_votes(features, row_id, k, gold_features, model=model)
            votes = votes.withColumns({"model": F.lit(name), "k": F.lit(k)})
            out = votes if out is None else out.unionByName(votes)
    return _sweep_metrics(out, truth, row_id)


def _sweep_metrics(votes: DataFrame, truth: DataFrame, row_id: str) -> DataFrame:
    """Metrics per (model, k, member): every fold model and the vote, from one pass over the votes."""
    run = ["model", "k"]
    member = F.concat(F.lit("fold_"), F.col("voter").cast("string")).alias("member")
    single = votes.select(row_id, *run, member, F.col("correct").cast("string").alias("pred"))
    ens = vote_summary(votes, [row_id, *run]).select(
        row_id, *run, F.lit("ensemble").alias("member"), F.col("cleaned_label").cast("string").alias("pred")
    )
    return hard_label_metrics(single.unionByName(ens).join(truth, row_id), [*run, "member"], "pred", "label_true")


def training_pilot(
    arms: dict[str, DataFrame], labels_from: str, evaluation: DataFrame, row_id: str, n_train: int,
    min_class: int, text: str = "text", seed: int = 42, hashed: int | None = FEATURES,
) -> DataFrame:
    """Size-matched comparison of training sets: one predicate classifier per arm.

    Labels are predicates frequent in arm ``labels_from`` and present in the evaluation
    rows; each arm trains on min(n_train, pool) rows. Without ``hashed`` all words count.
    """
    labels = label_set(arms[labels_from], evaluation, min_class)
    from .graph import dense_ids

    vocabulary = dense_ids(labels, "predicate").select("predicate", "id")
    ev = cut_lineage(predicate_features(evaluation, vocabulary, row_id, text))
    ev_words = None if hashed else packed_counts(ev, row_id)
    out = None
    for name, pool in arms.items():
        sample = capped_sample(pool, vocabulary, n_train, [row_id], seed)
        rows = predicate_features(sample, vocabulary, row_id, text)
        if hashed:
            train, encoder = feature_table(rows, row_id, hashed)
            fitted = classifier().fit(train)
            scored = fitted.transform(encode_rows(ev, encoder, row_id)).select("label", "prediction")
        else:
            rows = cut_lineage(rows)
            model, _ = fit(packed_counts(rows, row_id), rows.withColumn("voter", F.lit(0)), row_id)
            asked = ev.select(row_id, "label", F.lit(0).alias("voter"))
            scored = asked.join(predict(model, asked, ev_words, row_id), row_id).select("label", "prediction")
        m = class_macro_f1(scored, "prediction", "label").withColumn("arm", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def run_quality(metrics: DataFrame, expected_folds: int, by: str = "run") -> DataFrame:
    """Reject a run whose ensemble F1 is 0, that has NaN losses or too few folds.

    ``metrics``: (run, member, f1, loss) with member ``ensemble`` for the vote.
    """
    d = metrics.groupBy(by).agg(
        F.count_if(F.col("member") != "ensemble").alias("n_folds"),
        F.count_if((F.col("member") == "ensemble") & (F.col("f1") == 0)).alias("n_zero"),
        F.count_if(F.isnan("loss")).alias("n_nan"),
    )
    reason = (
        F.when(F.col("n_folds") < expected_folds, "missing folds")
        .when(F.col("n_zero") > 0, "ensemble F1 is 0")
        .when(F.col("n_nan") > 0, "loss is NaN")
    )
    return d.select(by, "n_folds", reason.alias("reason"), reason.isNull().alias("accepted"))
