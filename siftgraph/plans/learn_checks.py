"""Registered queries: cross-training, pilots, scoring and run quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import graph as GR
from ..operators import learn as LE
from ..operators.feature_cache import cached_features
from ..operators.metrics import hard_label_metrics
from ..session import checkpoint_root
from ..sources.score_sink import ScoreSink
from .fixtures import Tables
from .registry import F1_SQL, check, sql_confusion

OVERLAP = r"""WITH h AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(template_relation), '\S+')) AS hw,
        list_distinct(regexp_extract_all(lower(text), '\S+')) AS tw FROM questions)
    SELECT doc_id, len(list_intersect(hw, tw)) * 1e0 / len(hw) AS score FROM h"""


def language_rows(t: Tables):
    """Documents as (row, subject, object, predicate = language) classification rows."""
    return t.questions.select(
        "doc_id", "subject", "predicate", F.lit("").alias("object"), "text"
    )


def language_ids(t: Tables):
    names = t.documents.select(F.col("lang").alias("predicate"))
    return GR.dense_ids(names, "predicate").select("predicate", "id")


BODY_SQL = "concat(source, ' |  ', text)"


def bayes_sql(ks: tuple[int, ...]) -> str:
    """CTEs to ``votes`` (k, doc_id, fold, voter, correct): multinomial naive Bayes by counts.

    An unseen word has count 0 and, with smoothing 1, adds log 1 = 0, so only words met in
    training are joined.
    """
    return f"""tok AS (SELECT doc_id, lang AS y, unnest(list_filter(string_split_regex(lower({BODY_SQL}), '[ \\n\\t\\r]+'), lambda x: x <> '')) AS w
        FROM {{documents}}),
    tf AS (SELECT doc_id, y, w, count(*) AS n FROM tok GROUP BY ALL),
    size AS (SELECT doc_id, any_value(y) AS y, sum(n) AS n FROM tf GROUP BY 1),
    f AS (SELECT k, doc_id, lang AS y, (row_number() OVER (PARTITION BY k, lang ORDER BY md5('42|' || doc_id), doc_id) - 1) % k AS fold
          FROM {{documents}}, (SELECT unnest([{', '.join(map(str, ks))}]) AS k)),
    cnt AS (SELECT k, fold, tf.y, w, sum(n) AS c FROM tf JOIN f USING (doc_id) GROUP BY ALL),
    tot AS (SELECT k, fold, y, sum(c) AS t FROM cnt GROUP BY ALL),
    pri AS (SELECT k, fold, y, count(*) AS m FROM f GROUP BY ALL),
    base AS (SELECT k, fold, y, ln((m + 1) / (sum(m) OVER (PARTITION BY k, fold) + count(*) OVER (PARTITION BY k, fold))::DOUBLE) AS prior,
                    ln(t + (SELECT count(DISTINCT w) FROM tf)) AS denom FROM pri JOIN tot USING (k, fold, y)),
    met AS (SELECT k, fold, doc_id, cnt.y, sum(n * ln(c + 1)) AS s FROM tf JOIN cnt USING (w) GROUP BY ALL),
    scored AS (SELECT b.k, b.fold AS voter, z.doc_id, b.y, z.y AS truth, prior + coalesce(s, 0) - z.n * denom AS score
               FROM base b CROSS JOIN size z LEFT JOIN met ON met.k = b.k AND met.fold = b.fold AND met.doc_id = z.doc_id AND met.y = b.y),
    best AS (SELECT k, voter, doc_id, any_value(truth) AS truth, arg_max(y, score) AS got FROM scored GROUP BY ALL),
    votes AS (SELECT k, doc_id, voter, CAST(got = truth AS INT) AS correct, truth FROM best)"""


@check(
    "m01_cross_train_votes",
    "doc_id:i predicate:s vote_correct:i vote_total:i vote_fraction:d cleaned_label:i",
    f"""WITH {bayes_sql((3,))}, own AS (SELECT v.* FROM votes v JOIN f USING (k, doc_id) WHERE fold <> voter),
        s AS (SELECT doc_id, any_value(truth) AS predicate, sum(correct) AS vote_correct, count(*) AS vote_total FROM own GROUP BY 1)
        SELECT *, vote_correct / vote_total::DOUBLE AS vote_fraction, CAST(vote_correct / vote_total::DOUBLE > 0.5 AS INT) AS cleaned_label FROM s""",
)
def _(t: Tables):
    return LE.cross_train_denoise(language_rows(t), language_ids(t), "doc_id", 3, hashed=None)


@check(
    "m01_vote_totals",
    "vote_total:i n:i",
    "SELECT CASE WHEN lang = 'es' THEN 0 ELSE 2 END AS vote_total, count(*) AS n FROM {documents} GROUP BY 1",
)
def _(t: Tables):
    # one predicate is left out of the vocabulary: its rows get no vote
    vocab = GR.dense_ids(language_ids(t).filter("predicate <> 'es'"), "predicate")
    votes = LE.cross_train_denoise(language_rows(t), vocab, "doc_id", 3)
    return votes.groupBy("vote_total").agg(F.count(F.lit(1)).alias("n"))


@check(
    "m02_predicate_features",
    "doc_id:i predicate:s body:s",
    "SELECT doc_id, predicate, subject || ' |  ' || text AS body FROM questions WHERE predicate <> 'fr'",
)
def _(t: Tables):
    vocab = language_ids(t).filter("predicate <> 'fr'")
    return LE.predicate_features(language_rows(t), vocab, "doc_id")


@check(
    "m02_feature_cache",
    "doc_id:i n_words:i n_distinct:i generation:i encoded:i",
    f"""WITH w AS (SELECT doc_id, lang, list_filter(string_split_regex(lower({BODY_SQL}), '[ \\n\\t\\r]+'), lambda x: x <> '') AS w FROM {{documents}})
        SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS generation,
               (SELECT count(*) FROM {{documents}} WHERE lang = 'fr') AS encoded FROM w""",
)
def _(t: Tables):
    rows = LE.predicate_features(language_rows(t), language_ids(t), "doc_id")

    def encode(df):
        words = F.filter(F.split(F.lower("body"), f"[{WS}]+"), lambda w: w != "")
        counted = df.withColumn("words", words)
        return counted.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))}).drop("words")

    name = f"features_{uuid.uuid4().hex}"
    args = (name, "doc_id", "body", "word counts", encode, 8, f"{checkpoint_root(t.spark)}/{name}")
    # the second run meets the rows of one more language
    cached_features(rows.filter("predicate <> 'fr'"), *args)
    found, encoded = cached_features(rows, *args)
    return found.withColumn("encoded", F.lit(encoded))


@check(
    "m03_cross_train_sweep",
    "model:s k:i member:s tp:i fp:i fn:i tn:i f1:d",
    f"""WITH {bayes_sql(LE.FOLD_COUNTS)}, g AS (SELECT v.*, quality FROM votes v JOIN {{labels}} USING (doc_id)),
        single AS (SELECT k, 'fold_' || voter AS member, correct AS p, quality FROM g),
        ens AS (SELECT k, 'ensemble' AS member, CAST(avg(correct) > 0.5 AS INT) AS p, any_value(quality) AS quality FROM g GROUP BY k, doc_id),
        c AS (SELECT k, member, {sql_confusion('p = 1', 'quality = 1')} FROM (SELECT * FROM single UNION ALL SELECT * FROM ens) GROUP BY ALL)
        SELECT 'bayes' AS model, *, {F1_SQL} AS f1 FROM c""",
)
def _(t: Tables):
    gold = language_rows(t).join(t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    return LE.cross_train_sweep(language_rows(t), gold, language_ids(t), "doc_id", "label", hashed=None)


PILOT_SQL = f"""WITH tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower({BODY_SQL}), '[ \\n\\t\\r]+'), lambda x: x <> '')) AS w FROM {{documents}}),
    tf AS (SELECT doc_id, w, count(*) AS n FROM tok GROUP BY ALL),
    ev AS (SELECT doc_id, lang AS y FROM {{documents}} WHERE doc_id IN (SELECT doc_id FROM {{labels}} WHERE quality = 1)),
    pool AS (SELECT doc_id, lang AS y, length(text) AS len FROM {{documents}} WHERE doc_id NOT IN (SELECT doc_id FROM {{labels}})),
    lab AS (SELECT y FROM pool WHERE len >= 500 GROUP BY 1 HAVING count(*) >= 5 INTERSECT SELECT y FROM ev),
    arms AS (SELECT 'raw' AS arm, doc_id, y FROM pool UNION ALL SELECT 'denoised', doc_id, y FROM pool WHERE len >= 500),
    tr AS (SELECT arm, doc_id, y FROM arms WHERE y IN (SELECT y FROM lab)
           QUALIFY row_number() OVER (PARTITION BY arm ORDER BY md5('42|' || doc_id)) <= 200),
    cnt AS (SELECT arm, y, w, sum(n) AS c FROM tf JOIN tr USING (doc_id) GROUP BY ALL),
    voc AS (SELECT DISTINCT arm, w FROM cnt),
    base AS (SELECT arm, y, ln((m + 1) / (sum(m) OVER (PARTITION BY arm) + count(*) OVER (PARTITION BY arm))::DOUBLE) AS prior, ln(t + v) AS denom
             FROM (SELECT arm, y, count(*) AS m FROM tr GROUP BY ALL) JOIN (SELECT arm, y, sum(c) AS t FROM cnt GROUP BY ALL) USING (arm, y)
             JOIN (SELECT arm, count(*) AS v FROM voc GROUP BY 1) USING (arm)),
    known AS (SELECT arm, doc_id, sum(n) AS n FROM tf JOIN ev USING (doc_id) JOIN voc USING (w) GROUP BY ALL),
    met AS (SELECT arm, doc_id, cnt.y, sum(n * ln(c + 1)) AS s FROM tf JOIN ev USING (doc_id) JOIN cnt USING (w) GROUP BY ALL),
    scored AS (SELECT b.arm, ev.doc_id, ev.y AS truth, b.y, prior + coalesce(s, 0) - coalesce(known.n, 0) * denom AS score
               FROM base b CROSS JOIN ev LEFT JOIN known ON known.arm = b.arm AND known.doc_id = ev.doc_id
               LEFT JOIN met ON met.arm = b.arm AND met.doc_id = ev.doc_id AND met.y = b.y WHERE ev.y IN (SELECT y FROM lab)),
    got AS (SELECT arm, doc_id, any_value(truth) AS g, arg_max(y, score) AS p FROM scored GROUP BY ALL),
    cls AS (SELECT arm, p AS k FROM got UNION SELECT arm, g FROM got),
    per AS (SELECT c.arm, k, count(*) FILTER (WHERE p = k AND g = k) AS tp, count(*) FILTER (WHERE (p = k) <> (g = k)) AS err
            FROM cls c JOIN got USING (arm) GROUP BY ALL)
    SELECT per.arm, avg(CASE WHEN 2 * tp + err = 0 THEN 0 ELSE 2e0 * tp / (2 * tp + err) END) AS class_macro_f1, count(*) AS n_classes,
        any_value(n) AS n, any_value(acc) AS accuracy
    FROM per JOIN (SELECT arm, count(*) AS n, avg(CAST(p = g AS INT)) AS acc FROM got GROUP BY 1) USING (arm) GROUP BY per.arm"""


@check("m04_training_pilot", "arm:s class_macro_f1:d n_classes:i n:i accuracy:d", PILOT_SQL)
def _(t: Tables):
    rows = language_rows(t)
    gold = rows.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    pool = rows.join(t.labels.select("doc_id"), "doc_id", "left_anti")
    arms = {"raw": pool, "denoised": pool.filter(F.length("text") >= 500)}
    return LE.training_pilot(arms, "denoised", gold, "doc_id", 200, 5, hashed=None)


@check("m05_native_scorer", "doc_id:i score:d", OVERLAP)
def _(t: Tables):
    return t.questions.select("doc_id", LE.hypothesis_overlap("template_relation", "text").alias("score"))


@check(
    "m06_remaining_rows",
    "doc_id:i",
    "SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})",
)
def _(t: Tables):
    return LE.remaining_rows(t.documents, t.labels, "doc_id").select("doc_id")


@check("m06_resumed_scores", "doc_id:i score:d", "SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS score FROM {documents}")
def _(t: Tables):
    def load():
        return lambda pdf: pdf["text"].str.count(" ")

    path = f"{checkpoint_root(t.spark)}/scores-{uuid.uuid4().hex}"
    # a run that ends after one of three chunks, and one that goes on
    for most in (1, None):
        ScoreSink.open(t.documents, path, "doc_id", ["text"], 3).run(load, ["text"], most)
    return ScoreSink.open(t.documents, path, "doc_id", ["text"], 3).scores()


@check(
    "m07_run_quality",
    "run:s n_folds:i reason:s accepted:i",
    f"""WITH c AS (SELECT model, config, {sql_confusion("pred = '1'", "label = 1 AND model <> 'gamma'")} FROM runs GROUP BY ALL),
        m AS (SELECT model AS run, config, {F1_SQL} AS f1 FROM c), s AS (SELECT run, count(*) AS n_folds, max(f1) AS best FROM m GROUP BY 1)
        SELECT run, n_folds, CASE WHEN best = 0 THEN 'ensemble F1 is 0' WHEN run = 'beta' THEN 'loss is NaN' END AS reason,
               (best > 0 AND run <> 'beta') AS accepted FROM s""",
)
def _(t: Tables):
    # the third model's labels are all negative, the second one's loss is not a number
    runs = t.runs.withColumn("label", F.when(F.col("model") == "gamma", 0).otherwise(F.col("label")))
    m = hard_label_metrics(runs, ["model", "config"]).select(
        F.col("model").alias("run"), F.col("config").alias("member"), "f1"
    )
    m = m.withColumn("loss", F.when(F.col("run") == "beta", F.lit(float("nan"))).otherwise(0.1))
    vote = m.groupBy("run").agg(F.max("f1").alias("f1")).select(
        "run", F.lit("ensemble").alias("member"), "f1", F.lit(0.1).alias("loss")
    )
    return LE.run_quality(m.unionByName(vote), 6)
