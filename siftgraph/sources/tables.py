"""Scans and sinks: CSV, JSON lines, parquet, score files, verified writes, releases."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ensemble import PRED_SUFFIX, published_label, published_rows
from ..operators.joins import withhold_evaluation

CANDIDATE_COLUMNS = ("docid", "title", "text", "subject", "predicate", "object")
PREPARED_COLUMNS = (
    "docid", "title", "text", "subject", "predicate", "object", "relation_present",
    "basic_relation", "template_relation", "llm_relation",
)
RELEASE_FRONT = ("docid", "title", "text", "subject", "predicate", "object")
CODECS = ("snappy", "gzip", "zstd", "none")
BOM = "\ufeff"
NULL_MARK = "\x00null\x00"  # what Spark's reader takes a cell of nothing for; no cell says it


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, nulls: bool = False) -> DataFrame:
    """All-string CSV: header, doubled quotes, multi-line cells; empty cells are "".

    With ``nulls`` a cell of nothing is null, as :func:`write_csv` writes it, and only ``""`` is
    empty. A byte order mark in front of the first header name is removed. A malformed record
    fails the read. Cells may span lines, so a file is one task: keep large tables in many
    files.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("quote", '"')
        .option("escape", '"')
        .option("charToEscapeQuoteEscaping", '"')  # else a NUL in a quoted cell is lost
        .option("encoding", "UTF-8")
        .option("nullValue", NULL_MARK)
        .option("emptyValue", "")
        .option("enforceSchema", columns is None)
    )
    df = reader.csv(path)
    df = df.toDF(*[c.removeprefix(BOM) for c in df.columns])
    df = df if nulls else df.fillna("")
    return df if columns is None else select_present(df, columns)


def read_candidates(spark: SparkSession, path: str, docid_type: str = "string") -> DataFrame:
    """Candidate rows with ``docid`` cast to one type at the scan."""
    df = read_csv(spark, path, CANDIDATE_COLUMNS)
    return df.withColumn("docid", F.col("docid").cast(docid_type))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def column_family(spark: SparkSession, path: str, suffix: str = PRED_SUFFIX, prefix: str = "") -> list[str]:
    """Columns of a parquet table by suffix and prefix; only the footer is read."""
    names = spark.read.parquet(path).columns
    return [c for c in names if c.endswith(suffix) and c.startswith(prefix)]


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Positional score file to (row_id, score): one number per line, blank lines skipped.

    Lines are numbered per file part in file order: a count per part gives the offsets,
    a window inside the part the position, so no global sort runs.
    """
    lines = spark.read.text(path).select(
        F.col("value"),
        F.col("_metadata.file_path").alias("f"),
        F.spark_partition_id().alias("p"),
        F.monotonically_increasing_id().alias("m"),
        F.col("_metadata.file_block_start").alias("b"),
    )
    kept = lines.filter(F.trim("value") != "")
    sizes = kept.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("f", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("f", "b").orderBy("m")
    return kept.join(offsets, ["f", "b"]).select(
        (F.col("off") + F.row_number().over(inside) - 1).alias("row_id"),
        F.trim("value").cast("float").alias("score"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Gzipped tab-separated edges with header."""
    edges.write.mode("overwrite").option("sep", "\t").option("header", True).option(
        "compression", "gzip"
    ).csv(path)


def prediction_table(
    df: DataFrame, row_id: str, gold: str, text: str, hypotheses: Sequence[str],
    scores: dict[str, str], threshold: float,
) -> DataFrame:
    """Wide per-row table: id, gold, preview, hypotheses, then confidence and prediction pairs."""
    pairs = [
        c
        for name, col in scores.items()
        for c in (
            F.format_string("%.4f", F.col(col)).alias(f"conf_{name}"),
            F.when(F.col(col) >= threshold, "1").otherwise("0").alias(f"pred_{name}"),
        )
    ]
    return df.select(
        F.col(row_id).alias("row_idx"),
        F.col(gold).alias("gold_label"),
        F.substring(text, 1, 120).alias("premise_preview"),
        *[F.col(h).alias(f"hyp_{h}") for h in hypotheses],
        *pairs,
    )


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with the listed columns in that order; other columns are ignored.

    Cells keep the white space at their ends; a null is a cell of nothing, an empty string is ``""``.
    """
    select_present(df, columns).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def convert_csv_to_parquet(spark: SparkSession, source: str, target: str, codec: str = "snappy") -> int:
    """CSV to parquet; fails unless the row count survives the round trip."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    read = Observation("csv rows")
    df = read_csv(spark, source).observe(read, F.count(F.lit(1)).alias("rows"))
    df.write.mode("overwrite").option("compression", codec).parquet(target)
    n_in, n_out = read.get["rows"], spark.read.parquet(target).count()
    if n_in != n_out:
        raise RuntimeError(f"row counts differ: {n_in} read, {n_out} written")
    return n_out


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark can reach."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def recorded_rows(spark: SparkSession, path: str) -> int | None:
    """Row count of the manifest next to a finished table, None if it is not finished."""
    fs, manifest = hadoop_path(spark, path + ".done")
    _, table = hadoop_path(spark, path)
    if not (fs.exists(manifest) and fs.exists(table)):
        return None
    try:
        return json.loads(spark.read.text(path + ".done").first()[0])["rows"]
    except (TypeError, KeyError, ValueError):
        return None


def write_verified(df: DataFrame, path: str, expected: int | None = None, force: bool = False) -> int:
    """Write to ``path`` through a partial folder, rename, record the row count.

    Skipped when the manifest of an earlier run already states the expected count.
    """
    spark = df.sparkSession
    done = recorded_rows(spark, path)
    if not force and done is not None and (expected is None or done == expected):
        return done
    partial = path + ".partial"
    df.write.mode("overwrite").parquet(partial)
    rows = spark.read.parquet(partial).count()
    if expected is not None and rows != expected:
        raise RuntimeError(f"{rows} rows written, {expected} expected")
    fs, target = hadoop_path(spark, path)
    _, source = hadoop_path(spark, partial)
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(source, target):
        raise RuntimeError(f"cannot rename {partial}")
    spark.createDataFrame([(json.dumps({"rows": rows}),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path + ".done")
    return rows


def write_bucketed(df: DataFrame, table: str, buckets: int, row_id: str = "row_id") -> None:
    """Catalog table bucketed and sorted by row id.

    Signal tables written with the base table's bucket count join it by row id without a
    shuffle, however many of them are merged.
    """
    df.write.mode("overwrite").bucketBy(buckets, row_id).sortBy(row_id).saveAsTable(table)


def select_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed columns that exist, in list order."""
    return df.select(*[c for c in columns if c in df.columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def present_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Input pairs whose two columns both exist."""
    return [p for p in pairs if p[0] in df.columns and p[1] in df.columns]


def release_tables(signals: DataFrame, gold: DataFrame, consensus: Sequence[str]) -> dict[str, DataFrame]:
    """all_signals and published tables with front-loaded columns, evaluation rows withheld."""
    kept = withhold_evaluation(signals, gold)
    preds = [c for c in kept.columns if c.endswith(PRED_SUFFIX)]
    kept = kept.withColumns({c: F.col(c).try_cast("tinyint") for c in preds})
    kept = kept.withColumn("agree3_label", published_label(consensus)).withColumn(
        "docid", F.col("docid").cast("string")
    )
    front = [c for c in RELEASE_FRONT if c in kept.columns] + ["agree3_label"]
    kept = kept.select(*front, *[c for c in kept.columns if c not in front])
    return {
        "all_signals": kept,
        "published": published_rows(kept, "agree3_label").withColumnRenamed("agree3_label", "label"),
    }


def gold_release(gold: DataFrame, label: str, annotator: str, second: str) -> DataFrame:
    """Gold rows for release; fails if the label differs from the adjudicated annotation."""
    same = F.col(label).cast("int").eqNullSafe(F.col(annotator).cast("int"))
    guarded = F.when(same, F.col(annotator).cast("int")).otherwise(
        F.raise_error(F.lit("label differs from the adjudicated annotation"))
    )
    fields = ("item_id", "docid", "title", "text", "subject", "predicate", "object")
    out = gold.withColumns({"label": guarded, "annotator2_label": F.col(second).cast("int")})
    notes = F.coalesce("notes", F.lit("")) if "notes" in gold.columns else F.lit("")
    out = out.withColumn("notes", notes).withColumn("docid", F.col("docid").cast("string"))
    return select_present(
        out, (*fields, "label", "annotator2_label", "notes", "word_count", "selection_reason")
    )


def write_release(
    signals: DataFrame, gold: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], consensus, out: str
) -> None:
    """Write the all-signals, published and edge tables below ``out``.

    The signals are joined and withheld once: published rows, and edges given as a function of the
    kept rows, are read from the written all-signals table.
    """
    kept = release_tables(signals, gold, consensus)["all_signals"]
    path = f"{out}/silver/all_signals"
    kept.write.mode("overwrite").parquet(path)
    written = signals.sparkSession.read.schema(kept.schema).parquet(path)
    published = published_rows(written, "agree3_label").withColumnRenamed("agree3_label", "label")
    published.write.mode("overwrite").parquet(f"{out}/silver/published")
    write_edges(edges(written) if callable(edges) else edges, f"{out}/kg/edges")


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("predicate", "id").coalesce(1).write.mode("overwrite").json(path)
