"""Appending, resumable sink of scores.

Rows are dealt to chunks by a hash of their id and staged once, partitioned by chunk, so a
chunk reads its own files only. A chunk is scored by one Spark job into its own folder; then a
commit file with its row count is renamed into place. A run that is killed at any point leaves
committed chunks and at most one folder without a commit: the next run removes that folder and
goes on with the first chunk that is not committed. Readers see committed chunks alone.

Below ``path``: ``rows/chunk=K`` (staged input), ``scores/chunk=K``, ``commits/K.json`` and
``plan.json`` (chunks and id column, fixed by the first run).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.learn import Scorer, score_pairs
from .tables import hadoop_path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all."""
    fs, target = hadoop_path(spark, path)
    _, partial = hadoop_path(spark, path + ".partial")
    out = fs.create(partial, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(partial, target):
        raise RuntimeError(f"{path} exists already")


def _read_text(spark: SparkSession, path: str) -> dict | None:
    fs, p = hadoop_path(spark, path)
    return json.loads("".join(r[0] for r in spark.read.text(path).collect())) if fs.exists(p) else None


@dataclass(frozen=True)
class ScoreSink:
    """Scores of the rows staged below ``path``."""

    spark: SparkSession
    path: str
    row_id: str
    chunks: int
    schema: T.StructType

    @staticmethod
    def open(df: DataFrame, path: str, row_id: str, columns: Sequence[str], chunks: int) -> ScoreSink:
        """The sink at ``path``; a first call stages the rows, a later one only reads the plan.

        Fails if the sink was made for another id column or number of chunks. Staging that
        was cut off is repeated from the start.
        """
        spark, path = df.sparkSession, path.rstrip("/")
        plan = _read_text(spark, f"{path}/plan.json")
        if plan is None:
            chunk = F.pmod(F.xxhash64(F.col(row_id)), F.lit(chunks)).cast("int")
            rows = df.select(row_id, *columns, chunk.alias("chunk"))
            rows.repartition("chunk", F.pmod(F.xxhash64(F.col(row_id), F.lit(1)), F.lit(64))).write.mode(
                "overwrite"
            ).partitionBy("chunk").parquet(f"{path}/rows")
            plan = {"row_id": row_id, "chunks": chunks, "schema": rows.schema.jsonValue()}
            _write_text(spark, f"{path}/plan.json", json.dumps(plan))
        if (plan["row_id"], plan["chunks"]) != (row_id, chunks):
            raise ValueError(f"the sink was made with {plan}")
        return ScoreSink(spark, path, row_id, chunks, T.StructType.fromJson(plan["schema"]))

    def committed(self) -> dict[int, int]:
        """{chunk: rows} of the chunks whose scores are complete."""
        fs, folder = hadoop_path(self.spark, f"{self.path}/commits")
        if not fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        if not done:
            return {}
        found = self.spark.read.schema("chunk int, rows long").json([f"{self.path}/commits/{k}.json" for k in done])
        return {r.chunk: r.rows for r in found.collect()}

    def run(self, load: Callable[[], Scorer], columns: Sequence[str], most: int | None = None) -> int:
        """Score what is not committed yet, at most ``most`` chunks; returns the rows added."""
        done, added = self.committed(), 0
        todo = [k for k in range(self.chunks) if k not in done]
        source = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        kind = self.schema[self.row_id].dataType.simpleString()
        for k in todo[:most]:
            out = f"{self.path}/scores/chunk={k}"
            fs, target = hadoop_path(self.spark, out)
            fs.delete(target, True)  # of a run that was cut off before its commit
            rows = source.filter(F.col("chunk") == k)
            score_pairs(rows, load, self.row_id, columns, kind).write.parquet(out)
            n = self.spark.read.parquet(out).count()
            if n != rows.count():
                raise RuntimeError(f"chunk {k}: the scorer returned {n} scores")
            _write_text(self.spark, f"{self.path}/commits/{k}.json", json.dumps({"chunk": k, "rows": n}))
            added += n
        return added

    def scores(self) -> DataFrame:
        """(row_id, score) of the committed chunks."""
        done = self.committed()
        if not done:
            kind = self.schema[self.row_id].dataType.simpleString()
            return self.spark.createDataFrame([], f"`{self.row_id}` {kind}, score double")
        return self.spark.read.parquet(*[f"{self.path}/scores/chunk={k}" for k in sorted(done)])
