"""Inputs of the registered queries, derived from the given tables.

One SQL text serves Spark and the checking engine. Every fixture reads whole tables; the
evaluation ("gold") rows are chosen by an attribute, as an evaluation set is.
"""

from __future__ import annotations

import re
from functools import cached_property
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.verbalize import config_grid
from ..session import spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# tables whose rows get CPU-heavy work; see session.spread
SPREAD = {
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"),
    "documents": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}

SQL = {
    "candidates": """
        SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING),
                         CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING),
                         CAST(CAST(l_quantity AS INT) AS STRING)) AS row_id,
               l_orderkey AS docid, c_name AS subject, p_brand AS predicate, s_name AS object,
               p_type AS kind, sn.n_name AS place, cn.n_name AS home,
               l_linenumber AS linenumber, l_quantity AS quantity, l_shipdate AS shipdate,
               round(l_quantity / CAST(50 AS DOUBLE), 6) AS a_score,
               round(l_discount * 10, 6) AS b_score,
               round(l_tax * CAST(12.5 AS DOUBLE), 6) AS c_score,
               CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 1 ELSE 0 END AS label,
               CASE l_returnflag WHEN 'A' THEN 'new_predicate' WHEN 'N' THEN 'depth_boost'
                    ELSE 'silver_sample' END AS subset
        FROM {lineitem}
        JOIN {orders} ON l_orderkey = o_orderkey
        JOIN {customer} ON o_custkey = c_custkey
        JOIN {part} ON l_partkey = p_partkey
        JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} sn ON s_nationkey = sn.n_nationkey
        JOIN {nation} cn ON c_nationkey = cn.n_nationkey""",
    # evaluation rows: one quantity value; some subjects keep link markup
    "gold": """
        SELECT row_id AS item_id, docid, predicate, object, label, subset, kind, place,
               CASE WHEN linenumber = 1 THEN concat('[[', subject, ']]') ELSE subject END AS subject,
               subject AS silver_subject
        FROM candidates WHERE quantity = 7""",
    # the corpus with exact repeats of every row of one discount step
    "repeated": """
        SELECT concat(row_id, '/0') AS row_id, docid, subject, predicate, object, a_score, label
        FROM candidates
        UNION ALL
        SELECT concat(row_id, '/1') AS row_id, docid, subject, predicate, object, a_score, label
        FROM candidates WHERE b_score = CAST(0.5 AS DOUBLE)""",
    # three signals; the third one is missing for tax-free rows
    "signals": """
        SELECT row_id, docid, subject, predicate, object, kind, place, home, linenumber, label, subset,
               a_score AS alpha__score, CASE WHEN a_score >= CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END AS alpha__pred,
               b_score AS beta__score, CASE WHEN b_score >= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS beta__pred,
               CASE WHEN c_score > 0 THEN c_score END AS gamma__score,
               CASE WHEN c_score > 0 THEN CASE WHEN c_score >= CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END END AS gamma__pred
        FROM candidates""",
    "passages": """
        SELECT d.doc_id, d.text, d.lang AS predicate, d.source, l.quality AS label, l.toxic,
               d.n_chars, least(CAST(1 AS DOUBLE), d.n_chars / CAST(4000 AS DOUBLE)) AS s_long,
               greatest(CAST(0 AS DOUBLE), 1 - d.n_chars / CAST(4000 AS DOUBLE)) AS s_short
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # wiki markup around whole texts, one of eight variants per document
    "marked": """
        SELECT doc_id, lang, source, text AS plain,
               CASE doc_id % 8
                 WHEN 1 THEN concat(text, chr(10), '== קישורים\u00a0חיצוניים ==', chr(10), 'tail [[x]]')
                 WHEN 2 THEN concat('שמאל|ממוזער|250px|short words', chr(10), 'a [[caption]] here',
                                    chr(10), chr(10), 'another caption', chr(10), text)
                 WHEN 3 THEN concat('ממוזער|271x271 px one two three four five six seven eight nine ten eleven twelve thirteen',
                                    chr(10), 'short line', chr(10), text)
                 WHEN 4 THEN concat('[[one|two]] and [[three]] [[a [[b|c]] d]] ', text, ' x | y]]')
                 WHEN 5 THEN concat('* first', chr(10), '** 30px second', chr(10), '#20px - third',
                                    chr(10), text, chr(10), 'right')
                 WHEN 6 THEN concat('Lead.', chr(10), '== Title ==', chr(10), '=== Sub  title ===',
                                    chr(10), text)
                 WHEN 7 THEN concat('a \u200bb</small>', chr(9), '  c ', text, chr(10),
                                    '  קטגוריה:x', chr(10), 'gone')
                 ELSE text END AS text
        FROM {documents}""",
    # entity values with link markup, pipes, tags and no-break spaces
    "entities": """
        SELECT row_id, predicate, object,
               CASE linenumber % 5
                 WHEN 0 THEN concat('[[', subject, '|', object, ']] x')
                 WHEN 1 THEN concat(subject, '\u00a0\u00a0|', object)
                 WHEN 2 THEN concat('  <b>', subject, '</b>[[', object)
                 WHEN 3 THEN concat('[[a [[', subject, ']] b|', object, ']]')
                 ELSE subject END AS subject
        FROM candidates""",
    # predicates with and without a template
    "named": """
        SELECT row_id, subject, object,
               CASE kind WHEN 'STANDARD' THEN 'אב' WHEN 'MEDIUM' THEN 'חלוקה משנית'
                         WHEN 'PROMO' THEN 'מדינה' WHEN 'LARGE' THEN 'עיסוק' ELSE kind END AS predicate
        FROM candidates""",
    # documents as (text, triple, statement) questions
    "questions": """
        SELECT doc_id, text, source AS subject, lang AS predicate, CAST(n_chars AS STRING) AS object,
               concat(source, ' is in ', lang) AS template_relation
        FROM {documents}""",
    "answers": """
        SELECT conv_id, turn,
               CASE (conv_id + turn) % 8
                 WHEN 0 THEN 'yes'
                 WHEN 1 THEN 'No.'
                 WHEN 2 THEN '<think>yes</think> no'
                 WHEN 3 THEN concat(text, chr(10), 'So the answer is', chr(10), 'Yes, it is.')
                 WHEN 4 THEN concat('maybe ', text)
                 WHEN 5 THEN ''
                 WHEN 6 THEN concat('התשובה: כן', chr(10), text, chr(10), 'x', chr(10), 'y', chr(10), 'z')
                 ELSE concat('לא. ', text) END AS raw,
               CASE (conv_id + turn) % 8
                 WHEN 0 THEN 'היסק'
                 WHEN 1 THEN ' סתירה.'
                 WHEN 2 THEN concat('<THINK>היסק</THINK> ניטרלי', chr(10), text)
                 WHEN 3 THEN concat('<think>', text, '</think>', 'היסק ואז סתירה')
                 WHEN 4 THEN concat('ניטרלי ואולי היסק ', text)
                 WHEN 5 THEN 'היס'
                 WHEN 6 THEN concat('כן ', text)
                 ELSE text END AS nli
        FROM {conversations}""",
    "probs": """
        SELECT row_id, predicate, label, 'alpha' AS model, a_score AS pe,
               round((1 - a_score) * b_score, 6) AS pc FROM candidates
        UNION ALL
        SELECT row_id, predicate, label, 'beta' AS model, b_score AS pe,
               round((1 - b_score) * c_score, 6) AS pc FROM candidates""",
    # frequent short triples: part type as relation, places as entities
    "mentions": """
        SELECT row_id, home AS subject, kind AS predicate, place AS object, docid,
               alpha__score, beta__score, gamma__score, alpha__pred, beta__pred, gamma__pred
        FROM signals""",
    # order graph: customers with their orders, a forest of stars
    "order_graph": """
        SELECT concat('o', CAST(o_orderkey AS STRING)) AS subject, 'placed by' AS predicate,
               concat('c', CAST(o_custkey AS STRING)) AS object, o_orderkey AS docid
        FROM {orders}""",
    "vec_triples": """
        SELECT e.vec_id AS q, e.vec_id AS h, CAST(e.label AS BIGINT) AS r,
               (e.vec_id * 7 + e.label) % n.n AS t
        FROM {embeddings} e JOIN (SELECT count(*) AS n FROM {embeddings}) n ON n.n > 0""",
}

MODELS = {"alpha": ("a_score", 0.3), "beta": ("b_score", 0.5), "gamma": ("c_score", 0.3)}
FORMS = {"triplet": 0.0, "template": 0.1}
SHOTS = (0, 2, 5)


def _configs() -> list[tuple]:
    return [
        (m, f, s, f"{m}_{f}_{s}s", round(base + 0.02 * s + extra, 2))
        for m, (_, base) in MODELS.items()
        for f, extra in FORMS.items()
        for s in SHOTS
    ]


CONFIG_NAMES = [c[3] for c in _configs()]

# long predictions, one row per (row, configuration); some answers are unparseable
SQL["runs"] = f"""
    SELECT row_id, predicate, label, linenumber, g.model, g.form, g.shot, g.config,
           CASE WHEN g.shot = 0 AND linenumber = 7 THEN 'unknown'
                WHEN CASE g.model WHEN 'alpha' THEN a_score WHEN 'beta' THEN b_score ELSE c_score END
                     >= g.cut THEN '1' ELSE '0' END AS pred
    FROM candidates CROSS JOIN (VALUES {', '.join(
        f"('{m}', '{f}', {s}, '{n}', CAST({c} AS DOUBLE))" for m, f, s, n, c in _configs())})
      g(model, form, shot, config, cut)"""


# the same rows as Spark reads them: customers are joined to orders, not to their many line items
SPARK_SQL = SQL | {
    "candidates": SQL["candidates"][: SQL["candidates"].index("FROM {lineitem}")]
    + """FROM {lineitem}
        JOIN (SELECT o_orderkey, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey
              JOIN {nation} ON c_nationkey = n_nationkey) cn ON l_orderkey = o_orderkey
        JOIN {part} ON l_partkey = p_partkey
        JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} sn ON s_nationkey = sn.n_nationkey"""
}


def _expand(body: str, sql: dict[str, str]) -> list[str]:
    """Fixtures a SQL text names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in sql:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(sql[name])
                if name not in order:
                    order.append(name)

    visit(body)
    return order


def with_fixtures(body: str, table, sql: dict[str, str] = SQL) -> str:
    """Prefix ``body`` with the fixtures it uses; ``table`` maps base table names."""
    order = _expand(body, sql)
    text = body
    if order:
        ctes = ",\n".join(f"{n} AS ({sql[n]})" for n in order)
        head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
        if head:
            rec = head.group(1) or ""
            text = f"WITH {rec}{ctes},\n{body[head.end():]}"
        else:
            text = f"WITH {ctes}\n{body}"
    for name in BASE_TABLES:
        if "{" + name + "}" in text:
            text = text.replace("{" + name + "}", table(name))
    return text


# opened base tables by session, folder and name (footers are read once)
_OPENED: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """Base tables and fixtures of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def base(self, name: str) -> DataFrame:
        key = (self.spark._jsparkSession.sessionUUID(), self.folder, name)
        if key not in _OPENED:
            _OPENED[key] = self.spark.read.parquet(self.path(name))
        return _OPENED[key]

    def view(self, name: str) -> str:
        """Temporary view of a base table; the large ones are spread over all cores."""
        view = f"{name}_{md5(self.folder.encode()).hexdigest()[:8]}"
        if not self.spark.catalog.tableExists(view):
            df = self.base(name)
            (spread(df, *SPREAD[name]) if name in SPREAD else df).createOrReplaceTempView(view)
        return view

    def fixture(self, name: str) -> DataFrame:
        return self.spark.sql(with_fixtures(f"SELECT * FROM {name}", self.view, SPARK_SQL))

    def __getattr__(self, name: str) -> DataFrame:
        if name in SQL:
            return self.fixture(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    @cached_property
    def runs(self) -> DataFrame:
        return self.runs_of(self.fixture("candidates"))

    def runs_of(self, candidates: DataFrame) -> DataFrame:
        """Runs of the given candidates: what is joined to a row before is not joined to each of its runs."""
        grid = config_grid(
            candidates,
            {"model": list(MODELS), "form": list(FORMS), "shot": list(SHOTS)},
        )
        base, score = F.lit(None).cast("double"), F.lit(None).cast("double")
        for m, (col, cut) in MODELS.items():
            base = F.when(F.col("model") == m, F.lit(cut)).otherwise(base)
            score = F.when(F.col("model") == m, F.col(col)).otherwise(score)
        extra = F.when(F.col("form") == "template", 0.1).otherwise(0.0)
        cut = F.round(base + F.col("shot") * 0.02 + extra, 2)
        pred = F.when((F.col("shot") == 0) & (F.col("linenumber") == 7), "unknown").when(
            score >= cut, "1"
        )
        config = F.concat("model", F.lit("_"), "form", F.lit("_"), F.col("shot").cast("string"), F.lit("s"))
        return grid.select(
            "row_id", "predicate", "label", "linenumber", "model", "form", "shot",
            config.alias("config"), pred.otherwise("0").alias("pred"),
        )

    @cached_property
    def probs(self) -> DataFrame:
        """The two models' probability pairs from one scan."""
        pair = lambda model, e, c: F.struct(
            F.lit(model).alias("model"),
            F.col(e).alias("pe"),
            F.round((1 - F.col(e)) * F.col(c), 6).alias("pc"),
        )
        cells = F.array(pair("alpha", "a_score", "b_score"), pair("beta", "b_score", "c_score"))
        return self.fixture("candidates").select("row_id", "predicate", "label", F.inline(cells))

    def vectors(self) -> DataFrame:
        """(id, vec) of the embedding table."""
        e = self.base("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))

    def relation_vectors(self) -> DataFrame:
        """(id, vec): mean vector per label."""
        e = self.base("embeddings").select(
            F.col("label").cast("long").alias("id"), F.posexplode(F.col("embedding").cast("array<double>"))
        )
        means = e.groupBy("id", "pos").agg(F.round(F.avg("col"), 9).alias("m"))
        return means.groupBy("id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vec")
        )
