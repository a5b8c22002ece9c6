"""Registered queries: key joins and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.answers import normalise_prediction
from ..functions.text import clean, word_count
from ..operators import ensemble as G
from ..operators import joins as J
from ..session import stored
from .fixtures import CONFIG_NAMES, FORMS, SHOTS, Tables
from .registry import F1_SQL, METRIC_COLUMNS, RATIOS_SQL, check, sql_confusion
from .text_checks import CLEAN_V3, words

KEY = "docid, subject, predicate, object"
EQ = " AND ".join(f"a.{c} = b.{c}" for c in J.NATURAL_KEY)

KEPT_SQL = f"""WITH held AS (SELECT DISTINCT docid, silver_subject AS subject, predicate, object FROM gold),
    free AS (SELECT a.* FROM repeated a ANTI JOIN held b ON {EQ}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY row_id) AS rn FROM free)
    SELECT row_id, {KEY}, a_score FROM ranked WHERE rn = 1"""


def plain_gold(t: Tables):
    return t.gold.drop("subject").withColumnRenamed("silver_subject", "subject")


@check("e01_withhold_dedupe", "row_id:s docid:i subject:s predicate:s object:s a_score:d", KEPT_SQL)
def _(t: Tables):
    return J.withhold_and_dedupe(t.repeated, plain_gold(t))


@check(
    "e01_withhold_counts",
    "n_total:i n_gold_removed:i n_duplicates:i n_kept:i",
    f"""WITH held AS (SELECT DISTINCT docid, silver_subject AS subject, predicate, object FROM gold),
        marks AS (SELECT a.*, (b.docid IS NOT NULL) AS in_gold,
                         row_number() OVER (PARTITION BY a.docid, a.subject, a.predicate, a.object ORDER BY row_id) AS rn
                  FROM repeated a LEFT JOIN held b ON {EQ})
        SELECT count(*) AS n_total, count(*) FILTER (WHERE in_gold) AS n_gold_removed,
               count(*) FILTER (WHERE NOT in_gold AND rn > 1) AS n_duplicates,
               count(*) FILTER (WHERE NOT in_gold AND rn = 1) AS n_kept FROM marks""",
)
def _(t: Tables):
    return J.withhold_counts(t.repeated, plain_gold(t))


@check(
    "e02_evaluation_mask",
    "row_id:s is_eval:i",
    """SELECT row_id, CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE g.docid = c.docid
              AND replace(replace(g.subject, '[[', ''), ']]', '') = c.subject
              AND g.predicate = c.predicate AND g.object = c.object) THEN 1 ELSE 0 END AS is_eval FROM candidates c""",
)
def _(t: Tables):
    return J.evaluation_mask(t.candidates, t.gold)


@check(
    "e03_one_to_one_join",
    "row_id:s a_score:d kind:s",
    "SELECT a.row_id, a.a_score, b.kind FROM candidates a JOIN candidates b ON a.row_id = b.row_id",
)
def _(t: Tables):
    left = t.candidates.select("row_id", "a_score")
    return J.one_to_one_join(left, t.candidates.select("row_id", "kind"), ["row_id"])


@check(
    "e03_one_to_one_report",
    "n_left_duplicates:i n_right_duplicates:i n_unmatched:i",
    f"""WITH l AS (SELECT {KEY}, count(*) AS n FROM repeated GROUP BY ALL),
             r AS (SELECT docid, silver_subject AS subject, predicate, object, count(*) AS n FROM gold GROUP BY ALL)
        SELECT (SELECT count(*) FROM l WHERE n > 1) AS n_left_duplicates,
               (SELECT count(*) FROM r WHERE n > 1) AS n_right_duplicates,
               (SELECT sum(a.n) FROM l a ANTI JOIN r b ON {EQ}) AS n_unmatched""",
)
def _(t: Tables):
    return J.one_to_one_report(t.repeated, plain_gold(t), J.NATURAL_KEY)


@check(
    "e04_key_set_difference",
    "only_left:i only_right:i",
    f"""WITH l AS (SELECT DISTINCT {KEY} FROM candidates),
             r AS (SELECT DISTINCT docid, subject, predicate, object FROM gold)
        SELECT (SELECT count(*) FROM l a ANTI JOIN r b ON {EQ}) AS only_left,
               (SELECT count(*) FROM r a ANTI JOIN l b ON {EQ}) AS only_right""",
)
def _(t: Tables):
    return J.key_set_difference(t.candidates, t.gold)


@check(
    "e05_version_diff",
    "n_rows:i n_changed:i mean_words_old:d mean_words_new:d",
    f"""{CLEAN_V3} SELECT count(*) AS n_rows, count(*) FILTER (WHERE m.text <> c.v3) AS n_changed,
        avg({words('m.text')}) AS mean_words_old, avg({words('c.v3')}) AS mean_words_new
        FROM marked m JOIN cleaned c ON m.doc_id = c.doc_id""",
)
def _(t: Tables):
    new = t.marked.select("doc_id", clean("text").alias("text"))
    return J.version_diff(t.marked, new, ["doc_id"], "text", word_count)


@check(
    "e06_attach_scores",
    "row_id:s score:d missing:i",
    """SELECT row_id, CASE WHEN c_score > 0 THEN CAST(c_score AS FLOAT) END AS score,
              CASE WHEN c_score > 0 THEN 0 ELSE 1 END AS missing FROM candidates""",
)
def _(t: Tables):
    scores = t.candidates.filter("c_score > 0").select("row_id", F.col("c_score").alias("score"))
    out = J.attach_scores(t.candidates.select("row_id"), scores, "gamma")
    return out.select(
        "row_id", F.col("gamma__score").alias("score"), F.col("gamma__score").isNull().alias("missing")
    )


@check(
    "e07_merge_sources",
    "row_id:s alpha:s gamma:s absent:s",
    """SELECT row_id, CAST(alpha__pred AS VARCHAR) AS alpha,
              coalesce(CAST(gamma__pred AS VARCHAR), '') AS gamma, '' AS absent FROM signals""",
)
def _(t: Tables):
    key = ["row_id", *J.NATURAL_KEY]
    s = stored(t.signals.select(*key, "alpha__pred", "gamma__pred"), "sources")
    gamma = s.filter("gamma__pred is not null").select(*key, F.col("gamma__pred").alias("gamma"))
    sources = {"alpha": s.select(*key, F.col("alpha__pred").alias("alpha")), "gamma": gamma}
    return J.merge_sources(
        s.select(*key), sources, {"alpha": ["alpha"], "gamma": ["gamma"], "absent": ["absent"]}
    )


@check(
    "e07_alignment_report",
    "n_aligned:i n_missing:i n_extra:i n_mismatch:i",
    """SELECT (SELECT count(*) FROM gold) AS n_aligned,
              (SELECT count(*) FROM candidates) - (SELECT count(*) FROM gold) AS n_missing, 0 AS n_extra,
              (SELECT count(*) FROM gold WHERE subject <> silver_subject) AS n_mismatch""",
)
def _(t: Tables):
    gold = t.gold.withColumnRenamed("item_id", "row_id")
    return J.alignment_report(t.candidates, gold, J.NATURAL_KEY)


@check(
    "e08_docid_alignment",
    "n_aligned:i n_missing:i n_extra:i n_mismatch:i",
    "SELECT count(*) AS n_aligned, 0 AS n_missing, 0 AS n_extra, 0 AS n_mismatch FROM candidates",
)
def _(t: Tables):
    return J.alignment_report(t.candidates, t.signals, ["docid"])


@check(
    "e09_attach_signal",
    "n_rows:i n_missing:i n_pos:i",
    f"""WITH s AS (SELECT {KEY}, CASE WHEN a_score >= 0.3 THEN 1 ELSE 0 END AS p FROM repeated WHERE label = 1)
        SELECT count(*) AS n_rows, count(*) FILTER (WHERE b.p IS NULL) AS n_missing,
               count(*) FILTER (WHERE b.p = 1) AS n_pos FROM candidates a LEFT JOIN s b ON {EQ}""",
)
def _(t: Tables):
    signal = t.repeated.filter("label = 1").withColumn("p", (F.col("a_score") >= 0.3).cast("int"))
    return J.attach_signal(t.candidates, signal, ["p"]).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("p").isNull()).alias("n_missing"),
        F.count_if(F.col("p") == 1).alias("n_pos"),
    )


@check(
    "e10_attach_first",
    "row_id:s first_row:s first_score:d",
    """WITH r AS (SELECT subject, predicate, min(row_id) AS first_row FROM repeated GROUP BY ALL)
       SELECT g.item_id AS row_id, r.first_row, x.a_score AS first_score FROM gold g
       LEFT JOIN r ON g.subject = r.subject AND g.predicate = r.predicate
       LEFT JOIN repeated x ON x.row_id = r.first_row""",
)
def _(t: Tables):
    other = t.repeated.select(
        "subject", "predicate", F.col("row_id").alias("first_row"), F.col("a_score").alias("first_score")
    )
    out = J.attach_first(
        t.gold, other, ["subject", "predicate"], ["first_row", "first_score"], ["first_row"]
    )
    return out.withColumnRenamed("item_id", "row_id")


@check(
    "e11_recover_text",
    "item_id:s text:s text_found:i",
    f"""WITH w AS (SELECT item_id, docid, subject, predicate, object FROM gold
                   UNION SELECT item_id, docid, silver_subject, predicate, object FROM gold WHERE label = 1),
             f AS (SELECT b.item_id, arg_min(a.row_id, a.row_id) AS found FROM repeated a JOIN w b ON {EQ} GROUP BY 1)
        SELECT g.item_id, coalesce(f.found, 'own text') AS text, (f.found IS NOT NULL) AS text_found
        FROM gold g LEFT JOIN f ON g.item_id = f.item_id""",
)
def _(t: Tables):
    items = t.gold.withColumn("alt_subject", F.when(F.col("label") == 1, F.col("silver_subject")))
    items = items.withColumn("text", F.lit("own text"))
    return J.recover_text(items, t.repeated.withColumn("text", F.col("row_id")))


SWAP_KEY = "docid, predicate, object"
SWAP_SQL = f"""WITH n AS (SELECT {SWAP_KEY}, arg_max(1 - label, row_id) AS new_label FROM repeated
                          WHERE a_score >= 0.9 GROUP BY ALL),
    s AS (SELECT c.row_id, coalesce(n.new_label, c.label) AS label, (n.new_label IS NOT NULL) AS label_joined,
                 coalesce(n.new_label <> c.label, FALSE) AS label_changed
          FROM candidates c LEFT JOIN n ON c.docid = n.docid AND c.predicate = n.predicate AND c.object = n.object)"""


def swapped(t: Tables):
    new = t.repeated.filter("a_score >= 0.9").withColumn("new_label", 1 - F.col("label"))
    return J.swap_labels(t.candidates, new)


@check("e12_swap_labels", "row_id:s label:i label_joined:i label_changed:i", f"{SWAP_SQL} SELECT * FROM s")
def _(t: Tables):
    return swapped(t)


@check(
    "e12_swap_counts",
    "n_rows:i n_joined:i n_changed:i n_missing:i",
    f"""{SWAP_SQL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE label_joined) AS n_joined,
        count(*) FILTER (WHERE label_changed) AS n_changed, count(*) FILTER (WHERE NOT label_joined) AS n_missing FROM s""",
)
def _(t: Tables):
    return J.swap_counts(swapped(t))


@check(
    "e13_resume_columns",
    "row_id:s label:i alpha__score:d resume_status:s",
    "SELECT row_id, label, alpha__score, 'merged' AS resume_status FROM signals",
)
def _(t: Tables):
    # both tables are projections of one stored run, so the rows are joined from the base tables once
    rows = stored(t.signals.select("row_id", "label", "alpha__score"), "resumed")
    earlier = rows.select("row_id", F.lit(9).alias("label"), "alpha__score")
    return J.resume_columns(rows.select("row_id", "label"), earlier)


@check(
    "e14_prediction_join",
    "id:s gold:s label:s mappable:i n:i",
    """SELECT CAST(conv_id AS VARCHAR) AS id, role AS gold, label, label IS NOT NULL AS mappable, count(*) AS n
       FROM (SELECT c.conv_id, g.role, CASE WHEN contains(c.text, 'the') THEN 'the' WHEN contains(c.text, 'of') THEN 'of' END AS label
             FROM {conversations} c JOIN (SELECT conv_id, turn, role FROM {conversations} WHERE role <> 'user') g
               ON c.conv_id = g.conv_id AND c.turn = g.turn) GROUP BY ALL""",
)
def _(t: Tables):
    ident = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    c = t.conversations.withColumn("id", ident)
    gold = c.select("id", F.when(F.col("role") != "user", F.col("role")).otherwise("").alias("gold"))
    # whole answers are parsed: some name a label, the others stay as they are and do not map
    labels = ["the", "of"]
    preds = c.select("id", normalise_prediction("text", labels).alias("prediction"))
    j = J.join_predictions(preds, gold, labels).withColumn("label", F.when(F.col("mappable"), F.col("prediction")))
    return j.groupBy(F.substring_index("id", "/", 1).alias("id"), "gold", "label", "mappable").agg(
        F.count(F.lit(1)).alias("n")
    )


@check(
    "e15_vocabulary_filter",
    "row_id:s",
    "SELECT row_id FROM candidates WHERE predicate IN (SELECT predicate FROM gold GROUP BY 1 HAVING count(*) >= 50)",
)
def _(t: Tables):
    vocab = t.gold.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).filter("n >= 50")
    return J.restrict_to_vocabulary(t.candidates, vocab)


# --- ensembles --------------------------------------------------------------------

PREDS = ["alpha__pred", "beta__pred", "gamma__pred"]
SCORES = ["alpha__score", "beta__score", "gamma__score"]
TEXT_VOTES = """WITH v AS (SELECT row_id, label, CASE WHEN linenumber = 7 THEN 'unknown' ELSE CAST(alpha__pred AS VARCHAR) END AS a,
    CAST(beta__pred AS VARCHAR) AS b, coalesce(CAST(gamma__pred AS VARCHAR), 'unknown') AS c FROM signals)"""


def text_votes(t: Tables):
    a = F.when(F.col("linenumber") == 7, "unknown").otherwise(F.col("alpha__pred").cast("string"))
    return t.signals.select(
        "row_id",
        "label",
        a.alias("a"),
        F.col("beta__pred").cast("string").alias("b"),
        F.coalesce(F.col("gamma__pred").cast("string"), F.lit("unknown")).alias("c"),
    )


def count_votes(value: str) -> str:
    return " + ".join(f"CASE WHEN {c} = '{value}' THEN 1 ELSE 0 END" for c in "abc")


@check(
    "g01_majority",
    "row_id:s vote:s",
    f"""{TEXT_VOTES}, n AS (SELECT row_id, {count_votes('1')} AS y, {count_votes('0')} AS z FROM v)
        SELECT row_id, CASE WHEN y > z THEN '1' WHEN z > y THEN '0' ELSE 'unknown' END AS vote FROM n""",
)
def _(t: Tables):
    return text_votes(t).select("row_id", G.majority_label(["a", "b", "c"]).alias("vote"))


WEIGHTS = {"a": 0.6, "b": 0.3, "c": 0.1}


@check(
    "g02_weighted_majority",
    "row_id:s vote:s",
    f"""{TEXT_VOTES}, n AS (SELECT row_id, {' + '.join(f"CASE WHEN {c} = '1' THEN {w}e0 ELSE 0e0 END" for c, w in WEIGHTS.items())} AS y,
            {' + '.join(f"CASE WHEN {c} IN ('0', '1') THEN {w}e0 ELSE 0e0 END" for c, w in WEIGHTS.items())} AS n FROM v)
        SELECT row_id, CASE WHEN n = 0 THEN 'unknown' WHEN y / n >= 0.5 THEN '1' ELSE '0' END AS vote FROM n""",
)
def _(t: Tables):
    return text_votes(t).select("row_id", G.weighted_majority_label(WEIGHTS).alias("vote"))


@check(
    "g03_soft_ensemble",
    "row_id:s score:d none:d",
    """SELECT row_id, CASE WHEN gamma__score IS NULL THEN (alpha__score + beta__score) / 2
              ELSE (alpha__score + beta__score + gamma__score) / 3 END AS score, 0.0 AS none FROM signals""",
)
def _(t: Tables):
    d = t.signals.withColumn("gamma__score", F.coalesce(F.col("gamma__score").cast("string"), F.lit("n/a")))
    return d.select(
        "row_id", G.soft_ensemble(SCORES).alias("score"), G.soft_ensemble(["subject"], 0.0).alias("none")
    )


FILLED = " + ".join(f"coalesce({p}, 0)" for p in PREDS)


@check(
    "g04_majority_of_all",
    "row_id:s vote:i",
    f"SELECT row_id, CASE WHEN ({FILLED}) > 1.5 THEN 1 ELSE 0 END AS vote FROM signals",
)
def _(t: Tables):
    return t.signals.select("row_id", G.majority_flag(PREDS).alias("vote"))


@check(
    "g05_majority_of_subset",
    "row_id:s vote:i",
    "SELECT row_id, CASE WHEN coalesce(beta__pred, 0) + coalesce(gamma__pred, 0) > 1 THEN 1 ELSE 0 END AS vote FROM signals",
)
def _(t: Tables):
    return t.signals.select("row_id", G.majority_flag(PREDS[1:]).alias("vote"))


@check(
    "g06_unanimity",
    "row_id:s agree3:i agree2:i",
    f"""SELECT row_id, CASE ({FILLED}) WHEN 3 THEN 1 WHEN 0 THEN 0 ELSE -5 END AS agree3,
        CASE alpha__pred + beta__pred WHEN 2 THEN 1 WHEN 0 THEN 0 ELSE -5 END AS agree2 FROM signals""",
)
def _(t: Tables):
    return t.signals.select(
        "row_id", G.unanimous_flag(PREDS).alias("agree3"), G.unanimous_flag(PREDS[:2]).alias("agree2")
    )


LABEL_SQL = "CASE WHEN alpha__pred = beta__pred AND beta__pred = gamma__pred THEN alpha__pred ELSE -1 END"


@check("g07_published_label", "row_id:s label:i", f"SELECT row_id, {LABEL_SQL} AS label FROM signals")
def _(t: Tables):
    return t.signals.select("row_id", G.published_label(PREDS).alias("label"))


@check(
    "g08_published_rows",
    "row_id:s label:i",
    f"SELECT * FROM (SELECT row_id, {LABEL_SQL} AS label FROM signals) x WHERE label >= 0",
)
def _(t: Tables):
    return G.published_rows(t.signals.select("row_id", G.published_label(PREDS).alias("label")))


@check(
    "g09_signal_counts",
    "row_id:s n_signals_pos:i mean_score:d",
    f"""SELECT row_id, {FILLED} AS n_signals_pos, round(CASE WHEN gamma__score IS NULL
        THEN (alpha__score + beta__score) / 2 ELSE (alpha__score + beta__score + gamma__score) / 3 END, 9) AS mean_score FROM signals""",
)
def _(t: Tables):
    return t.signals.select(
        "row_id",
        G.positive_signals(PREDS).alias("n_signals_pos"),
        G.mean_score(SCORES, digits=None).alias("mean_score"),
    )


@check(
    "g10_vote_summary",
    "row_id:s vote_correct:i vote_total:i vote_fraction:d cleaned_label:i",
    """WITH v AS (SELECT row_id, count(*) FILTER (WHERE pred = '1') AS vote_correct,
              count(*) FILTER (WHERE pred <> 'unknown') AS vote_total FROM runs GROUP BY 1)
       SELECT *, vote_correct / greatest(vote_total, 1) AS vote_fraction,
              CASE WHEN vote_correct / greatest(vote_total, 1) > 0.5 THEN 1 ELSE 0 END AS cleaned_label FROM v""",
)
def _(t: Tables):
    correct = F.when(F.col("pred") != "unknown", (F.col("pred") == "1").cast("int"))
    return G.vote_summary(t.runs.withColumn("correct", correct), ["row_id"])


CONFIG_F1 = f"""conf AS (SELECT model, config, {sql_confusion("pred = '1'", 'label = 1')} FROM runs GROUP BY ALL),
    scored AS (SELECT model, config, {F1_SQL} AS f1 FROM conf),
    best AS (SELECT model, arg_max(config, (round(f1, 12), -list_position({CONFIG_NAMES}, config))) AS config, max(f1) AS weight FROM scored GROUP BY model)"""


def best_configs(t: Tables):
    from ..operators.metrics import best_per_group, hard_label_metrics, run_ordinal

    m = hard_label_metrics(t.runs, ["model", "config"])
    m = m.withColumns({"key": F.round("f1", 12), "ordinal": run_ordinal("config", CONFIG_NAMES)})
    best = best_per_group(m, ["model"], ["ordinal"], "key")
    return best.select("model", "config", F.col("f1").alias("weight"))


@check(
    "g11_best_config_votes",
    "row_id:s majority:s weighted_majority:s",
    f"""WITH {CONFIG_F1}, picked AS (SELECT r.row_id, r.pred, b.weight FROM runs r JOIN best b ON r.config = b.config),
        agg AS (SELECT row_id, count(*) FILTER (WHERE pred = '1') AS y, count(*) FILTER (WHERE pred = '0') AS z,
                 coalesce(sum(weight) FILTER (WHERE pred = '1'), 0) AS wy, sum(weight) FILTER (WHERE pred IN ('0', '1')) AS wn
                FROM picked GROUP BY 1)
        SELECT row_id, CASE WHEN y > z THEN '1' WHEN z > y THEN '0' ELSE 'unknown' END AS majority,
               CASE WHEN coalesce(wn, 0) = 0 THEN 'unknown' WHEN wy / wn >= 0.5 THEN '1' ELSE '0' END AS weighted_majority FROM agg""",
)
def _(t: Tables):
    return G.long_votes(t.runs, best_configs(t), ["config"], ["row_id"])


@check(
    "g11_setting_majority",
    f"setting:s n_voters:i {METRIC_COLUMNS} n_unknown:i",
    f"""WITH v AS (SELECT row_id, form || '_' || shot AS setting, any_value(label) AS label, count(*) AS n_voters,
                   count(*) FILTER (WHERE pred = '1') AS y, count(*) FILTER (WHERE pred = '0') AS z FROM runs GROUP BY 1, 2),
        c AS (SELECT setting, max(n_voters) AS n_voters, {sql_confusion('y > z', 'label = 1')},
                     count(*) FILTER (WHERE y = z) AS n_unknown FROM v GROUP BY 1)
        SELECT setting, n_voters, tp, fp, fn, tn, n_unknown, {RATIOS_SQL} FROM c""",
)
def _(t: Tables):
    runs = t.runs.withColumn("setting", F.concat_ws("_", "form", F.col("shot").cast("string")))
    settings = [f"{form}_{shot}" for form in FORMS for shot in SHOTS]
    return G.setting_majority(runs, "setting", settings, "row_id", "label")


@check(
    "g12_hard_rows",
    "row_id:s n_runs:i",
    """SELECT row_id, count(*) AS n_runs FROM runs GROUP BY 1
       HAVING count(*) FILTER (WHERE pred = CAST(label AS VARCHAR)) = 0""",
)
def _(t: Tables):
    return G.hard_rows(t.runs, "row_id", "pred", "label")


def mistakes_sql(fn: str, test: str) -> str:
    return f"""SELECT row_id, CASE w WHEN a_score THEN 'a_score' WHEN b_score THEN 'b_score' ELSE 'c_score' END AS worst_config,
        w AS worst_score FROM (SELECT *, {fn}(a_score, b_score, c_score) AS w FROM candidates) x WHERE {test}"""


@check(
    "g13_confident_mistakes",
    "kind:s row_id:s worst_config:s worst_score:d",
    "SELECT 'fp' AS kind, * FROM (" + mistakes_sql("greatest", "label = 0 AND w >= 0.85")
    + ") UNION ALL SELECT 'fn', * FROM (" + mistakes_sql("least", "label = 1 AND w <= 0.15") + ")",
)
def _(t: Tables):
    scores = ["a_score", "b_score", "c_score"]
    fp = G.confident_mistakes(t.candidates, scores, "label", "row_id", "fp")
    fn = G.confident_mistakes(t.candidates, scores, "label", "row_id", "fn")
    return fp.withColumn("kind", F.lit("fp")).unionByName(fn.withColumn("kind", F.lit("fn")))


@check(
    "g13_worst_mistakes",
    "row_id:s worst_config:s worst_score:d",
    mistakes_sql("greatest", "label = 0 AND w >= 0.85") + " ORDER BY worst_score DESC, row_id LIMIT 15",
)
def _(t: Tables):
    return G.confident_mistakes(
        t.candidates, ["a_score", "b_score", "c_score"], "label", "row_id", "fp", n=15
    )
