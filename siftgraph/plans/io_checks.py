"""Registered queries: sources, sinks, releases and streaming, through a scratch folder."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from ..functions.text import DEFAULT, clean
from ..functions.verbalize import chat_messages
from ..operators import graph as GR
from ..operators.joins import NATURAL_KEY
from ..operators.learn import hypothesis_overlap
from ..session import checkpoint_root, scanned_bytes
from ..sources import tables as T
from ..sources.csv_split import read_csv_split
from ..streaming import incremental as N
from .fixtures import Tables
from .graph_checks import EDGES_SQL, VOCAB_SQL, edges, vocabulary
from .join_checks import KEPT_SQL, LABEL_SQL, PREDS, SCORES, plain_gold
from .registry import check
from .text_checks import CLEAN_V3


def scratch(t: Tables, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(t.spark)}/{name}-{uuid.uuid4().hex}"


DOC_COLUMNS = ["doc_id", "lang", "source", "text"]


@check(
    "a01_csv_scan",
    "doc_id:i lang:s source:s text:s",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE lang END AS lang, source, text || ' \"q\"' AS text FROM {documents}",
)
def _(t: Tables):
    path = scratch(t, "csv")
    d = t.documents.withColumns(
        {
            "text": F.concat("text", F.lit(' "q"')),
            "lang": F.when(F.col("lang") == "de", "").otherwise(F.col("lang")),
        }
    )
    T.write_csv(d, path, DOC_COLUMNS)
    return T.read_csv(t.spark, path, DOC_COLUMNS, nulls=True)


@check(
    "a01_csv_split_scan",
    "doc_id:i lang:s source:s text:s",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE lang END AS lang, source,
              replace(text, '. ', '.' || chr(10)) || ' "q"' AS text FROM {documents}""",
)
def _(t: Tables):
    # files of any size, cells that span lines, read in as many ranges as the session cuts
    path = scratch(t, "csv")
    lines = F.concat(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit(' "q"'))
    lang = F.when(F.col("lang") == "de", "").otherwise(F.col("lang"))
    T.write_csv(t.documents.withColumns({"text": lines, "lang": lang}), path, DOC_COLUMNS)
    return read_csv_split(t.spark, path, DOC_COLUMNS, nulls=True)


@check("a02_csv_to_parquet", "doc_id:i text:s rows:i", "SELECT doc_id, text, (SELECT count(*) FROM {documents}) AS rows FROM {documents}")
def _(t: Tables):
    source, target = scratch(t, "csv"), scratch(t, "parquet")
    T.write_csv(t.documents, source, DOC_COLUMNS)
    rows = T.convert_csv_to_parquet(t.spark, source, target, "zstd")
    return T.read_parquet(t.spark, target, ["doc_id", "text"]).withColumn("rows", F.lit(rows))


@check("a03_projected_scan", "l_orderkey:i l_quantity:d", "SELECT l_orderkey, l_quantity FROM {lineitem}")
def _(t: Tables):
    return T.read_parquet(t.spark, t.path("lineitem"), ["l_orderkey", "l_quantity"])


@check(
    "a04_column_family",
    "family:s total:d",
    "SELECT 'l_ship' AS family, CAST(count(l_shipdate) AS DOUBLE) AS total FROM {lineitem} UNION ALL "
    "SELECT '*key', sum(l_orderkey + l_partkey + l_suppkey) FROM {lineitem}",
)
def _(t: Tables):
    path = t.path("lineitem")
    ship = T.column_family(t.spark, path, "", "l_ship")
    keys = T.column_family(t.spark, path, "key")
    d = T.read_parquet(t.spark, path, [*ship, *keys])
    a = d.agg(sum((F.count(c) for c in ship), F.lit(0)).cast("double").alias("total"))
    b = d.agg(F.sum(sum((F.col(c) for c in keys), F.lit(0))).cast("double").alias("total"))
    return a.withColumn("family", F.lit("l_ship")).unionByName(b.withColumn("family", F.lit("*key")))


@check(
    "a05_score_file",
    "row_id:i score:d",
    "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, CAST(o_totalprice AS FLOAT) AS score FROM {orders}",
)
def _(t: Tables):
    path = scratch(t, "scores")
    ordered = t.orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    line = F.concat(F.col("o_totalprice").cast("string"), F.lit("\n"))
    ordered.select(line.alias("value")).write.text(path)
    return T.read_scores(t.spark, path)


@check(
    "a06_jsonl_scan",
    "id:s prediction:s",
    "SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS id, text AS prediction FROM {conversations}",
)
def _(t: Tables):
    path = scratch(t, "jsonl")
    ident = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    T.write_jsonl(t.conversations.select(F.struct(ident.alias("id")).alias("input"), F.col("text").alias("prediction")), path)
    d = T.read_jsonl(t.spark, path, "input struct<id: string>, prediction string")
    return d.select(F.col("input.id").alias("id"), "prediction")


@check(
    "a07_prompt_jsonl",
    "doc_id:i n_messages:i last_chars:i",
    """SELECT doc_id, 6 AS n_messages, length('Text:' || chr(10) || text || chr(10) || chr(10) || 'Statement to check: ' || template_relation
       || chr(10) || chr(10) || 'Look in the text for whether the above statement is expressed or can be inferred from it.' || chr(10)
       || 'Answer "yes" or "no" only.') AS last_chars FROM questions""",
)
def _(t: Tables):
    path = scratch(t, "prompts")
    T.write_jsonl(t.questions.select("doc_id", chat_messages("en", "template", 2).alias("messages")), path)
    d = T.read_jsonl(t.spark, path, "doc_id long, messages array<struct<role: string, content: string>>")
    last = F.element_at("messages", -1)["content"]
    return d.select("doc_id", F.size("messages").alias("n_messages"), F.length(last).alias("last_chars"))


@check(
    "a08_edge_sink",
    "subject:s predicate:s object:s docid:i n_signals_pos:i mean_score:d",
    f"WITH {EDGES_SQL} SELECT * FROM edges",
)
def _(t: Tables):
    path = scratch(t, "edges")
    T.write_edges(edges(t), path)
    return t.spark.read.option("sep", "\t").option("header", True).csv(path)


@check(
    "a09_prediction_table",
    "row_idx:s gold_label:i premise_preview:s hyp_subject:s conf_alpha:s pred_alpha:s conf_beta:s pred_beta:s",
    """SELECT row_id AS row_idx, label AS gold_label, substr(object, 1, 120) AS premise_preview, subject AS hyp_subject,
       printf('%.4f', alpha__score) AS conf_alpha, CASE WHEN alpha__score >= 0.7 THEN '1' ELSE '0' END AS pred_alpha,
       printf('%.4f', beta__score) AS conf_beta, CASE WHEN beta__score >= 0.7 THEN '1' ELSE '0' END AS pred_beta FROM signals""",
)
def _(t: Tables):
    path = scratch(t, "tsv")
    scores = {"alpha": "alpha__score", "beta": "beta__score"}
    T.write_tsv(T.prediction_table(t.signals, "row_id", "label", "object", ["subject"], scores, 0.7), path)
    return t.spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(path)


@check(
    "a10_verified_write",
    "event_id:i first_rows:i second_rows:i",
    "SELECT event_id, (SELECT count(*) FROM {events}) AS first_rows, (SELECT count(*) FROM {events}) AS second_rows FROM {events}",
)
def _(t: Tables):
    path = scratch(t, "verified")
    first = T.write_verified(t.events, path)
    # a second run finds the recorded count and leaves the table alone
    second = T.write_verified(t.events.filter("false"), path, expected=first)
    d = T.read_parquet(t.spark, path, ["event_id"])
    return d.withColumns({"first_rows": F.lit(first), "second_rows": F.lit(second)})


WITHHELD = "NOT EXISTS (SELECT 1 FROM gold g WHERE g.docid = s.docid AND g.silver_subject = s.subject AND g.predicate = s.predicate AND g.object = s.object)"


@check(
    "a11_release",
    "part:s docid:s subject:s label:i gamma__pred:i",
    f"""WITH r AS (SELECT CAST(docid AS VARCHAR) AS docid, subject, {LABEL_SQL} AS label, gamma__pred FROM signals s WHERE {WITHHELD})
        SELECT 'all' AS part, * FROM r UNION ALL SELECT 'published', * FROM r WHERE label >= 0""",
)
def _(t: Tables):
    out = scratch(t, "release")
    T.write_release(t.signals.drop("label"), t.gold, lambda kept: GR.accepted_edges(kept, PREDS, SCORES), PREDS, out)
    full = t.spark.read.parquet(f"{out}/silver/all_signals").withColumnRenamed("agree3_label", "label")
    pub = t.spark.read.parquet(f"{out}/silver/published")
    return full.withColumn("part", F.lit("all")).unionByName(pub.withColumn("part", F.lit("published")))


@check("a11_gold_release", "item_id:s docid:s label:i annotator2_label:i notes:s", "SELECT item_id, docid, label, label AS annotator2_label, '' AS notes FROM gold")
def _(t: Tables):
    g = t.gold.withColumns({"annotator1": F.col("label"), "annotator2": F.col("label")})
    return T.gold_release(g, "label", "annotator1", "annotator2")


@check("a12_vocabulary_json", "predicate:s id:i", f"SELECT predicate, id FROM ({VOCAB_SQL}) x")
def _(t: Tables):
    path = scratch(t, "vocabulary")
    T.write_vocabulary(vocabulary(t), path)
    return T.read_jsonl(t.spark, path, "predicate string, id long")


@check("a13_select_present", "c_custkey:i c_name:s n_columns:i", "SELECT c_custkey, c_name, 2 AS n_columns FROM {customer}")
def _(t: Tables):
    d = T.select_present(t.customer, ["c_custkey", "absent", "c_name"])
    return d.withColumn("n_columns", F.lit(len(d.columns)))


@check(
    "a14_required_columns",
    "c_custkey:i pair:s value:s",
    """SELECT c_custkey, 'c_name' AS pair, c_name AS value FROM {customer}
       UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM {customer}""",
)
def _(t: Tables):
    # pairs with an absent side are dropped; the others become rows
    d = T.require_columns(t.customer, ["c_custkey", "c_name"])
    pairs = T.present_pairs(d, [("c_custkey", "c_name"), ("c_custkey", "absent"), ("c_custkey", "c_nationkey")])
    rows = [F.struct(F.col(k).alias("c_custkey"), F.lit(v).alias("pair"), F.col(v).cast("string").alias("value")) for k, v in pairs]
    return d.select(F.inline(F.array(*rows)))


@check(
    "a15_csv_sink",
    "doc_id:i text:s n_columns:i",
    "SELECT doc_id, text, 2 AS n_columns FROM {documents}",
)
def _(t: Tables):
    path = scratch(t, "csv")
    T.write_csv(t.documents, path, ["text", "absent", "doc_id"])
    d = T.read_csv(t.spark, path)
    return d.withColumn("n_columns", F.lit(len(d.columns)))


# --- streaming ------------------------------------------------------------------------


ARRIVING_BYTES = 8 << 20  # of the scanned files, for one arriving file
DEALT_BYTES = 32 << 20  # scanned files beyond this are not dealt out anew, their tasks write a file each


def arriving(t: Tables, df, name: str, parts: int = 4) -> tuple[str, int]:
    """Folder with rows as they arrive, and files a trigger takes so that there are two triggers.

    The number of files grows with the scanned tables, so that no task writes a share of all rows.
    """
    path, size = scratch(t, name), scanned_bytes(df)
    if size <= DEALT_BYTES:
        parts = max(parts, -(-size // ARRIVING_BYTES))
        df = df.repartition(parts)
    df.write.option("compression", "zstd").parquet(path)
    if size > DEALT_BYTES:
        parts = len(t.spark.read.schema(df.schema).parquet(path).inputFiles())
    return path, max(1, -(-parts // 2))


OVERLAP_SQL = f"""{CLEAN_V3}, h AS (SELECT c.doc_id, v3, list_distinct(regexp_extract_all(lower(m.source || ' is in ' || m.lang), '\\S+')) AS hw,
        list_distinct(regexp_extract_all(lower(v3), {"'" + DEFAULT.patterns()['word'] + "'"})) AS tw FROM cleaned c JOIN marked m ON m.doc_id = c.doc_id)
    SELECT doc_id, v3 AS text, len(list_intersect(hw, tw)) * 1e0 / len(hw) AS score,
           CASE WHEN len(list_intersect(hw, tw)) * 1e0 / len(hw) >= 0.5 THEN 1 ELSE 0 END AS pred FROM h"""


@check("n01_streaming_clean_and_score", "doc_id:i text:s score:d pred:i", OVERLAP_SQL)
def _(t: Tables):
    marked = t.marked.select(
        "doc_id", "text", F.concat("source", F.lit(" is in "), "lang").alias("hypothesis")
    )
    (source, files), sink, state = arriving(t, marked, "in"), scratch(t, "out"), scratch(t, "state")
    stream = N.read_arriving(t.spark, source, marked.schema, files_per_trigger=files)
    scored = N.clean_and_score(stream, hypothesis_overlap("hypothesis", "text"), 0.5)
    N.write_available(scored, sink, state).awaitTermination()
    # more of the same source: nothing new has arrived, so nothing is written twice
    N.write_available(scored, sink, state).awaitTermination()
    return t.spark.read.parquet(sink)


@check(
    "n02_streaming_dedupe",
    "docid:i subject:s predicate:s object:s",
    f"SELECT docid, subject, predicate, object FROM ({KEPT_SQL}) x",
)
def _(t: Tables):
    rows = t.repeated.select(*NATURAL_KEY)
    (source, files), sink, state = arriving(t, rows, "in"), scratch(t, "out"), scratch(t, "state")
    stream = N.read_arriving(t.spark, source, rows.schema, files_per_trigger=files)
    fresh = N.withhold_and_dedupe_stream(stream, plain_gold(t))
    N.write_available(fresh, sink, state).awaitTermination()
    return t.spark.read.parquet(sink)


@check("n02_streaming_first_wins", "row_id:s docid:i subject:s predicate:s object:s a_score:d", KEPT_SQL)
def _(t: Tables):
    # the arrival time has nothing to do with the order that decides
    when = F.timestamp_seconds(F.pmod(F.xxhash64("row_id"), F.lit(3600)))
    rows = t.repeated.select("row_id", *NATURAL_KEY, "a_score").withColumn("seen", when)
    (source, files), sink, state = arriving(t, rows, "in"), scratch(t, "out"), scratch(t, "state")
    # a last row moves the watermark past all others; files are taken in order of their time, which stores keep in seconds
    some = t.spark.read.schema(rows.schema).parquet(source).limit(1)
    end = some.withColumns({"docid": F.lit(-1).cast("bigint"), "seen": F.lit("2100-01-01").cast("timestamp")})
    time.sleep(1)
    end.select(*rows.columns).write.mode("append").parquet(source)
    stream = N.read_arriving(t.spark, source, rows.schema, files_per_trigger=files).withWatermark("seen", "2 hours")
    fresh = N.first_wins_stream(stream, plain_gold(t), ["row_id"], "seen", "2 hours", watermarked=True)
    N.write_available(fresh, sink, state).awaitTermination()
    return t.spark.read.parquet(sink).filter("docid <> -1")


@check(
    "n03_streaming_progress",
    "rows:i kept:i dropped:i",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE alpha__pred = 1) AS kept,
              count(*) FILTER (WHERE alpha__pred <> 1) AS dropped FROM signals""",
)
def _(t: Tables):
    rows = t.signals.select("row_id", "alpha__pred")
    (source, files), sink, state = arriving(t, rows, "in"), scratch(t, "out"), scratch(t, "state")
    stream = N.read_arriving(t.spark, source, rows.schema, files_per_trigger=files)
    N.write_available(N.progress_counts(stream, F.col("alpha__pred") != 1), sink, state).awaitTermination()
    d = t.spark.read.parquet(sink)
    return d.agg(*[F.sum(c).alias(c) for c in d.columns])


@check("p01_pluggable_scorer", "doc_id:i score:d", "SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS score FROM {documents}")
def _(t: Tables):
    from ..operators.learn import score_pairs

    def load():
        return lambda pdf: pdf["text"].str.count(" ")

    return score_pairs(t.documents, load, "doc_id", ["text"], "long")


@check("b03_clean_v3_counts", "n:i chars:i", f"{CLEAN_V3} SELECT count(*) AS n, sum(length(v3)) AS chars FROM cleaned")
def _(t: Tables):
    cleaned = t.marked.select(clean("text").alias("text"))
    return cleaned.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


