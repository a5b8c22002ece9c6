"""Registered queries: folds, samples, sets, graph and link prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as GR
from ..operators import linkpred as L
from ..operators import sampling as K
from ..operators.ensemble import published_label
from ..operators.ranking import hash_key, ordered_rank
from ..session import cut_lineage, narrow_batches, stored
from .fixtures import Tables
from .join_checks import LABEL_SQL, PREDS, SCORES
from .registry import check

FOLDED = "folded AS (SELECT *, (row_number() OVER (PARTITION BY predicate ORDER BY md5('42|' || row_id), row_id) - 1) % 5 AS fold FROM candidates)"


@check("k01_predicate_folds", "row_id:s fold:i", f"WITH {FOLDED} SELECT row_id, fold FROM folded")
def _(t: Tables):
    return K.predicate_folds(t.candidates, "row_id", 5)


@check("k02_fold_sizes", "fold:i n:i", f"WITH {FOLDED} SELECT fold, count(*) AS n FROM folded GROUP BY 1")
def _(t: Tables):
    return K.fold_sizes(K.predicate_folds(t.candidates, "row_id", 5))


@check(
    "k03_first_wins",
    "row_id:s",
    "SELECT min(row_id) AS row_id FROM repeated GROUP BY docid, subject, predicate, object",
)
def _(t: Tables):
    return K.first_wins(t.repeated, ["docid", "subject", "predicate", "object"])


@check(
    "k04_best_evidence",
    "predicate:s object:s row_id:s a_score:d",
    """SELECT predicate, object, row_id, a_score FROM (SELECT *, row_number() OVER
       (PARTITION BY predicate, object ORDER BY a_score DESC, row_id) AS rn FROM candidates) x WHERE rn = 1""",
)
def _(t: Tables):
    return K.best_evidence(t.candidates, ["predicate", "object"], "a_score", ["row_id"])


@check(
    "k05_top_rows",
    "row_id:s a_score:d b_score:d",
    "SELECT row_id, a_score, b_score FROM candidates ORDER BY a_score DESC, b_score DESC, row_id LIMIT 50",
)
def _(t: Tables):
    return K.top_rows(t.candidates, [F.col("a_score").desc(), F.col("b_score").desc(), "row_id"], 50)


@check(
    "k06_cap_rows",
    "row_id:s row_number:i",
    """SELECT row_id, row_number() OVER (ORDER BY md5('0|' || row_id)) - 1 AS row_number FROM candidates
       QUALIFY row_number() OVER (ORDER BY md5('0|' || row_id)) <= 5000""",
)
def _(t: Tables):
    d = t.candidates.withColumn("h", hash_key(0, "row_id"))
    return K.cap_rows(ordered_rank(d, "h", ["row_id"], name="row_number"), 5000)


SAMPLE = "SELECT row_id FROM {src} ORDER BY md5('{seed}|' || row_id) LIMIT {n}"


@check("k07_exact_sample", "row_id:s", SAMPLE.format(src="candidates", seed=42, n=20000))
def _(t: Tables):
    return K.exact_sample(t.candidates, 20000, ["row_id"])


@check(
    "k08_size_matched_control",
    "row_id:s",
    f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('42|' || row_id)) AS rn FROM signals)
        WHERE rn <= (SELECT count(*) FROM (SELECT {LABEL_SQL} AS l FROM signals) x WHERE l = 1)""",
)
def _(t: Tables):
    accepted = t.signals.filter(published_label(PREDS) == 1)
    return K.size_matched_control(t.signals, accepted, ["row_id"])


LABELS_SQL = """(SELECT predicate FROM candidates GROUP BY 1 HAVING count(*) >= 20
    INTERSECT SELECT predicate FROM gold WHERE label = 1)"""


def label_names(t: Tables):
    return K.label_set(t.candidates, t.gold.filter("label = 1"), 20)


@check(
    "k09_capped_sample",
    "row_id:s",
    f"SELECT row_id FROM candidates WHERE predicate IN {LABELS_SQL} ORDER BY md5('42|' || row_id) LIMIT 5000",
)
def _(t: Tables):
    return K.capped_sample(t.candidates, label_names(t), 5000, ["row_id"])


@check(
    "k10_weighted_draws",
    "draw:i row_id:s",
    """WITH x AS (SELECT row_id, a_score / (SELECT max(a_score) FROM candidates) * 1073741824e0 AS x FROM candidates WHERE a_score > 0),
        w AS (SELECT row_id, greatest(CAST(floor(x) AS BIGINT) * 1073741824 + CAST(floor((x - floor(x)) * 1073741824e0) AS BIGINT), 1) AS w FROM x),
        c AS (SELECT row_id, sum(w) OVER (ORDER BY md5('42|' || row_id) ROWS UNBOUNDED PRECEDING) AS hi, w FROM w),
        d AS (SELECT range AS draw, (('0x' || substr(md5('42|' || range), 1, 13))::BIGINT::HUGEINT * 4503599627370496
                 + ('0x' || substr(md5('42|' || range), 14, 13))::BIGINT::HUGEINT) % (SELECT sum(w) FROM w) AS u
              FROM range((SELECT count(*) FROM candidates)))
        SELECT draw, row_id FROM d JOIN c ON u < hi AND u >= hi - w""",
)
def _(t: Tables):
    rows = stored(t.candidates.select("row_id", "a_score"), "weights")
    return K.weighted_draws(rows, "a_score", rows.count(), ["row_id"])


@check(
    "k11_fold_split",
    "side:s n:i n_pos:i",
    f"""WITH {FOLDED} SELECT CASE WHEN fold = 2 THEN 'train' ELSE 'other' END AS side, count(*) AS n, sum(label) AS n_pos
        FROM folded GROUP BY 1""",
)
def _(t: Tables):
    folded = K.predicate_folds(t.candidates, "row_id", 5)
    parts = {"train": K.train_split(folded, 2), "other": K.other_splits(folded, 2)}
    tagged = K.union_tagged(parts, "side")
    return tagged.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))


@check(
    "k12_union_tagged",
    "config:s row_id:s value:d",
    """SELECT 'a' AS config, row_id, a_score AS value FROM candidates UNION ALL SELECT 'b', row_id, b_score FROM candidates""",
)
def _(t: Tables):
    pick = lambda c: t.candidates.select("row_id", F.col(c).alias("value"))
    return K.union_tagged({"a": pick("a_score"), "missing": None, "b": pick("b_score")})


VOCAB_SQL = """WITH g AS (SELECT concat(predicate, CASE WHEN linenumber >= 6 THEN '+' ELSE '' END) AS predicate, row_id
                          FROM candidates WHERE quantity = 7),
    f AS (SELECT predicate, row_number() OVER (ORDER BY predicate) - 1 AS id FROM candidates GROUP BY 1 HAVING count(*) >= 20),
    x AS (SELECT predicate, min(row_id) AS first FROM g WHERE predicate NOT IN (SELECT predicate FROM f) GROUP BY 1)
    SELECT predicate, id, 0 AS gold_only FROM f UNION ALL
    SELECT predicate, (SELECT count(*) FROM f) + row_number() OVER (ORDER BY first, predicate) - 1, 1 FROM x"""


def vocabulary(t: Tables):
    mark = F.when(F.col("linenumber") >= 6, "+").otherwise("")
    gold = t.candidates.filter("quantity = 7").withColumn("predicate", F.concat("predicate", mark))
    return K.predicate_vocabulary(t.candidates, gold, "row_id", 20)


@check("k13_predicate_vocabulary", "predicate:s id:i gold_only:i", VOCAB_SQL)
def _(t: Tables):
    return vocabulary(t)


@check("k14_label_set", "predicate:s", f"SELECT predicate FROM {LABELS_SQL} x")
def _(t: Tables):
    return label_names(t)


TRIPLES = f"""tr AS (SELECT subject AS h, predicate AS r, object AS t, {LABEL_SQL} = 1 AS ok, alpha__score AS s FROM mentions),
    raw AS (SELECT DISTINCT h, r, t FROM tr), den AS (SELECT DISTINCT h, r, t FROM tr WHERE ok),
    picked AS (SELECT * FROM den ORDER BY md5('42|' || h || '|' || r || '|' || t) LIMIT 300),
    raw_train AS (SELECT * FROM raw EXCEPT SELECT * FROM picked), den_train AS (SELECT * FROM den EXCEPT SELECT * FROM picked),
    control AS (SELECT h, r, t FROM (SELECT *, row_number() OVER (ORDER BY md5('43|' || h || '|' || r || '|' || t)) AS rn FROM raw_train)
                WHERE rn <= (SELECT count(*) FROM den_train))"""


def triples(t: Tables):
    return t.mentions.select(
        F.col("subject").alias("h"),
        F.col("predicate").alias("r"),
        F.col("object").alias("t"),
        (published_label(PREDS) == 1).alias("ok"),
        F.col("alpha__score").alias("s"),
    )


@check("k15_drop_triples", "h:s r:s t:s", f"WITH {TRIPLES} SELECT * FROM raw_train")
def _(t: Tables):
    tr = triples(t)
    picked = K.exact_sample(GR.unique_triples(tr.filter("ok")), 300, ["h", "r", "t"])
    return K.drop_triples(GR.unique_triples(tr), picked)


def in_vocab(v: str) -> str:
    return (
        f"h IN (SELECT h FROM {v} UNION SELECT t FROM {v}) AND t IN (SELECT h FROM {v} UNION SELECT t FROM {v}) "
        f"AND r IN (SELECT r FROM {v})"
    )


TEST_SQL = "SELECT h, r, t FROM picked WHERE " + " AND ".join(map(in_vocab, ("raw_train", "den_train", "control")))


@check("k16_shared_vocabulary_test", "h:s r:s t:s", f"WITH {TRIPLES} {TEST_SQL}")
def _(t: Tables):
    return GR.training_variants(triples(t), "ok", 300, "s")["test"]


@check(
    "k17_inspection_sample",
    "doc_id:i words:i head:s tail:s",
    """WITH s AS (SELECT * FROM {documents} ORDER BY md5('7|' || doc_id) LIMIT 25)
       SELECT doc_id, len(regexp_extract_all(text, '[^ \\n]+')) AS words, replace(substr(text, 1, 300), chr(10), ' ') AS head,
              CASE WHEN length(text) > 460 THEN replace(right(text, 160), chr(10), ' ') ELSE '' END AS tail FROM s""",
)
def _(t: Tables):
    return K.inspection_sample(t.documents, 25, ["doc_id"])


# --- graph ----------------------------------------------------------------------------

EDGES_SQL = f"""edges AS (SELECT s.subject, s.predicate, s.object, s.docid,
      coalesce(alpha__pred, 0) + coalesce(beta__pred, 0) + coalesce(gamma__pred, 0) AS n_signals_pos,
      round((alpha__score + beta__score + gamma__score) / 3, 4) AS mean_score FROM signals s
    WHERE {LABEL_SQL} = 1 AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.docid = s.docid AND g.silver_subject = s.subject
          AND g.predicate = s.predicate AND g.object = s.object))"""


def edges(t: Tables):
    return GR.evidence_edges(t.signals, t.gold, PREDS, SCORES)


@check(
    "i01_evidence_edges",
    "subject:s predicate:s object:s docid:i n_signals_pos:i mean_score:d",
    f"WITH {EDGES_SQL} SELECT * FROM edges",
)
def _(t: Tables):
    return edges(t)


ENTS = f"WITH {EDGES_SQL}, n AS (SELECT subject AS name FROM edges UNION SELECT object FROM edges)"


@check(
    "i02_dense_ids",
    "name:s id:i",
    f"{ENTS} SELECT name, row_number() OVER (ORDER BY md5('0|' || name), name) - 1 AS id FROM n",
)
def _(t: Tables):
    return GR.dense_ids(GR.node_names(edges(t)))


@check(
    "i02_indexed_triples",
    "h:i r:i t:i docid:i",
    f"""{ENTS}, e AS (SELECT name, row_number() OVER (ORDER BY md5('0|' || name), name) - 1 AS id FROM n),
        p AS (SELECT predicate, row_number() OVER (ORDER BY md5('0|' || predicate)) - 1 AS id FROM edges GROUP BY 1)
        SELECT a.id AS h, p.id AS r, b.id AS t, docid FROM edges JOIN e a ON a.name = subject JOIN e b ON b.name = object
        JOIN p ON p.predicate = edges.predicate""",
)
def _(t: Tables):
    e = edges(t)
    rels = GR.dense_ids(e.select(F.col("predicate").alias("name")))
    return GR.index_triples(e, GR.dense_ids(GR.node_names(e)), rels)


@check(
    "i03_degrees",
    "node:s degree:i",
    """SELECT node, count(*) AS degree FROM (SELECT subject AS node FROM candidates UNION ALL SELECT object FROM candidates) x GROUP BY 1""",
)
def _(t: Tables):
    return GR.degrees(t.candidates)


@check(
    "i03_degree_summary",
    "n_nodes:i mean_degree:d median_degree:d max_degree:i",
    """WITH d AS (SELECT node, count(*) AS k FROM (SELECT subject AS node FROM candidates UNION ALL SELECT object FROM candidates) x GROUP BY 1)
       SELECT count(*) AS n_nodes, avg(k) AS mean_degree, quantile_cont(k, 0.5) AS median_degree, max(k) AS max_degree FROM d""",
)
def _(t: Tables):
    return GR.degree_summary(t.candidates)


def components_sql(source: str) -> str:
    return f"""WITH RECURSIVE both_ways AS (SELECT subject AS u, object AS v FROM {source} UNION SELECT object, subject FROM {source}),
    cc(node, component) USING KEY (node) AS (
        SELECT u AS node, u AS component FROM both_ways GROUP BY 1
        UNION SELECT b.v, min(cc.component) FROM cc JOIN both_ways b ON b.u = cc.node JOIN recurring.cc r ON r.node = b.v
        WHERE cc.component < r.component GROUP BY 1)"""


@check("i04_components", "node:s component:s", components_sql("order_graph") + " SELECT node, component FROM cc")
def _(t: Tables):
    return GR.connected_components(t.order_graph)


@check(
    "i04_component_summary",
    "n_components:i largest:i n_nodes:i largest_share:d",
    components_sql("candidates")
    + """, s AS (SELECT component, count(*) AS k FROM cc GROUP BY 1)
    SELECT count(*) AS n_components, max(k) AS largest, sum(k) AS n_nodes, max(k) / sum(k) AS largest_share FROM s""",
)
def _(t: Tables):
    return GR.component_summary(GR.connected_components(t.candidates))


@check(
    "i05_graph_summary",
    "n_edges:i unique_triples:i n_duplicates:i n_relations:i frequent_relations:i source_docs:i",
    """WITH p AS (SELECT predicate, count(*) AS n FROM repeated GROUP BY 1),
        u AS (SELECT DISTINCT subject, predicate, object FROM repeated)
       SELECT count(*) AS n_edges, (SELECT count(*) FROM u) AS unique_triples, count(*) - (SELECT count(*) FROM u) AS n_duplicates,
              (SELECT count(*) FROM p) AS n_relations, (SELECT count(*) FROM p WHERE n >= 100) AS frequent_relations,
              count(DISTINCT docid) AS source_docs FROM repeated""",
)
def _(t: Tables):
    return GR.graph_summary(t.repeated)


@check(
    "i05_top_relations",
    "predicate:s n:i",
    "SELECT predicate, count(*) AS n FROM repeated GROUP BY 1 ORDER BY n DESC, predicate LIMIT 5",
)
def _(t: Tables):
    return GR.top_relations(t.repeated)


HUB = "Supplier#000000001"


@check(
    "i06_ego_network",
    "predicate:s neighbor:s docid:i mean_score:d",
    f"""WITH e AS (SELECT *, CASE WHEN subject = '{HUB}' THEN object ELSE subject END AS neighbor FROM candidates
                   WHERE subject = '{HUB}' OR object = '{HUB}'),
        r AS (SELECT *, row_number() OVER (PARTITION BY predicate, neighbor ORDER BY a_score DESC, docid, subject, object) AS rn FROM e)
        SELECT predicate, neighbor, docid, a_score AS mean_score FROM r WHERE rn = 1 ORDER BY a_score DESC, predicate, neighbor LIMIT 10""",
)
def _(t: Tables):
    return GR.ego_network(t.candidates.withColumn("mean_score", F.col("a_score")), HUB)


@check("i07_unique_triples", "h:s r:s t:s", f"WITH {TRIPLES} SELECT * FROM raw")
def _(t: Tables):
    return GR.unique_triples(triples(t))


@check(
    "i08_triple_confidence",
    "h:s r:s t:s confidence:d",
    f"WITH {TRIPLES} SELECT h, r, t, greatest(max(s), 0.0001) AS confidence FROM tr GROUP BY ALL",
)
def _(t: Tables):
    return GR.triple_confidence(triples(t), "s")


@check(
    "i09_training_variants",
    "variant:s h:s r:s t:s confidence:d",
    f"""WITH {TRIPLES}, c AS (SELECT h, r, t, greatest(max(s), 0.0001) AS confidence FROM tr GROUP BY ALL), te AS ({TEST_SQL})
        SELECT 'raw' AS variant, h, r, t, NULL AS confidence FROM raw_train UNION ALL SELECT 'denoised', h, r, t, NULL FROM den_train
        UNION ALL SELECT 'control', h, r, t, NULL FROM control UNION ALL SELECT 'test', h, r, t, NULL FROM te
        UNION ALL SELECT 'weighted', a.h, a.r, a.t, confidence FROM raw_train a JOIN c ON a.h = c.h AND a.r = c.r AND a.t = c.t""",
)
def _(t: Tables):
    return K.union_tagged(GR.training_variants(triples(t), "ok", 300, "s"), "variant")


@check("i10_known_tails", "h:i r:i n_tails:i", "SELECT h, r, count(DISTINCT t) AS n_tails FROM vec_triples GROUP BY ALL")
def _(t: Tables):
    known = GR.known_tails(t.vec_triples)
    return known.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n_tails"))


# extra true tails, so that the filter has something to remove
KNOWN_SQL = """known AS (SELECT h, r, t FROM vec_triples UNION SELECT h, r, (t + 1) % (SELECT count(*) FROM {embeddings}) FROM vec_triples
                         UNION SELECT h, r, h FROM vec_triples)"""
VECTORS_SQL = """en AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM {embeddings}),
    dims AS (SELECT label AS id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings}),
    means AS (SELECT id, i, round(avg(x), 9) AS m FROM dims GROUP BY ALL),
    re AS (SELECT id, list(m ORDER BY i) AS vec FROM means GROUP BY id)"""


def l1_sql(a: str, r: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] + {r}[i] - {b}[i])))"


def known(t: Tables):
    v = t.vec_triples
    n = t.embeddings.count()
    more = v.select("h", "r", F.expr(f"(t + 1) % {n}").alias("t"))
    return v.select("h", "r", "t").union(more).union(v.select("h", "r", F.col("h").alias("t"))).distinct()


RANKS_SQL = f"""{KNOWN_SQL}, {VECTORS_SQL},
    qs AS (SELECT q, h, r, t, a.vec AS hv, b.vec AS rv, {l1_sql('a.vec', 'b.vec', 'c.vec')} AS gold
           FROM vec_triples JOIN en a ON a.id = h JOIN re b ON b.id = r JOIN en c ON c.id = t),
    closer AS (SELECT q, count(*) AS k FROM qs JOIN en e ON e.id <> qs.t AND {l1_sql('qs.hv', 'qs.rv', 'e.vec')} < qs.gold
               WHERE NOT EXISTS (SELECT 1 FROM known x WHERE x.h = qs.h AND x.r = qs.r AND x.t = e.id) GROUP BY q),
    ranks AS (SELECT v.q, h, r, t, coalesce(k, 0) + 1 AS rank FROM vec_triples v LEFT JOIN closer ON v.q = closer.q)"""


def ranks(t: Tables):
    return L.filtered_tail_ranks(t.vec_triples, t.vectors(), t.relation_vectors(), known(t))


@check("i11_filtered_tail_ranks", "q:i h:i r:i t:i rank:i", f"WITH {RANKS_SQL} SELECT * FROM ranks")
def _(t: Tables):
    return ranks(t)


@check(
    "i12_ranking_metrics",
    "mrr:d hits_at_1:d hits_at_10:d n_test:i",
    f"""WITH {RANKS_SQL} SELECT avg(1e0 / rank) AS mrr, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS hits_at_1,
        avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS hits_at_10, count(*) AS n_test FROM ranks""",
)
def _(t: Tables):
    return L.ranking_metrics(ranks(t))


NEGATIVES_SQL = f"""{KNOWN_SQL}, tries AS (SELECT q, h, r, k.range AS k,
        ('0x' || substr(md5('43|' || q || '|' || k.range), 1, 13))::BIGINT % (SELECT count(*) FROM {{embeddings}}) AS t
      FROM vec_triples, range(16) k),
    negatives AS (SELECT q, h, r, arg_min(t, k) AS t FROM tries a WHERE NOT EXISTS
        (SELECT 1 FROM known x WHERE x.h = a.h AND x.r = a.r AND x.t = a.t) GROUP BY ALL)"""


@check("i13_corrupt_tails", "q:i h:i r:i t:i", f"WITH {NEGATIVES_SQL} SELECT * FROM negatives")
def _(t: Tables):
    return L.corrupt_tails(t.vec_triples, known(t), t.embeddings.count())


CLASSIFY_SQL = f"""WITH {NEGATIVES_SQL}, {VECTORS_SQL},
    both_kinds AS (SELECT q, h, r, t, 1 AS y FROM vec_triples UNION ALL SELECT q, h, r, t, 0 FROM negatives),
    d AS (SELECT q, y, {l1_sql('a.vec', 'b.vec', 'c.vec')} AS d FROM both_kinds JOIN en a ON a.id = h JOIN re b ON b.id = r JOIN en c ON c.id = t),
    nv AS (SELECT count(*) // 5 AS n FROM vec_triples), val AS (SELECT * FROM d WHERE q < (SELECT n FROM nv)),
    cand AS (SELECT DISTINCT unnest((SELECT quantile_cont(d, {L.classification_probs()}) FROM val)) AS c),
    acc AS (SELECT c, sum(CASE WHEN (d < c) = (y = 1) THEN 1 ELSE 0 END) AS good FROM val, cand GROUP BY c),
    best AS (SELECT arg_max(c, (good, -c)) AS thr FROM acc),
    m AS (SELECT count(*) FILTER (WHERE d < thr AND y = 1) AS tp, count(*) FILTER (WHERE d < thr AND y = 0) AS fp,
                 count(*) FILTER (WHERE d >= thr AND y = 1) AS fn, count(*) FILTER (WHERE d >= thr AND y = 0) AS tn, any_value(thr) AS thr
          FROM d, best WHERE q >= (SELECT n FROM nv))
    SELECT (tp * 1e0 / (tp + fn) + tn * 1e0 / (fp + tn)) / 2 AS tc_accuracy, 2e0 * tp / (2 * tp + fp + fn) AS tc_f1,
           thr AS tc_threshold, tp + fn AS tc_n_eval FROM m"""


@check("i14_triple_classification", "tc_accuracy:d tc_f1:d tc_threshold:d tc_n_eval:i", CLASSIFY_SQL)
def _(t: Tables):
    e, r, v = t.vectors(), t.relation_vectors(), t.vec_triples
    n = t.embeddings.count()
    negatives = L.corrupt_tails(v, known(t), n)
    return L.classify_triples(L.triple_distance(v, e, r), L.triple_distance(negatives, e, r), n // 5)


@check("i15_translation_training", "epochs:i loss:d n:i")
def _(t: Tables):
    # customers and suppliers as entities: every distinct triple is trained on, on a grid of buckets
    tr = stored(t.candidates.select("subject", "predicate", "object").distinct(), "triples")
    ents = stored(GR.dense_ids(GR.node_names(tr)), "entities")
    rels = cut_lineage(GR.dense_ids(tr.select(F.col("predicate").alias("name"))))
    ids = stored(GR.index_triples(tr, ents, rels).select("h", "r", "t"), "ids")
    n = ents.count()
    out = None
    for epochs in (0, 1):
        trained = L.train_translation(ids, ents.select("id"), rels.select("id"), n, epochs=epochs, rate=0.01, buckets=2)
        e, r = (d.withColumn("vec", F.col("vec").cast("array<float>")) for d in trained)  # as they were trained
        with narrow_batches(t.spark):  # one row is kept, so that the shuffles of a loss can go before the next
            loss = cut_lineage(L.margin_loss(ids, e, r, n).withColumn("epochs", F.lit(epochs)))
        out = loss if out is None else out.unionByName(loss)
    return out
