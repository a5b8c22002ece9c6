"""Training-data pipeline: language, near-duplicates, benchmark, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before kept. All
but the last return the columns of ``documents``; the last returns each document's place in
the token files. ``run`` writes every stage to the shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siftgraph.llm import decontaminate, language_mixture, near_dedup, raking, token_output
from siftgraph.llm.queries import default_tokenizer, table
from siftgraph.llm.tables import stored
from siftgraph.session import ship_package

ORACLE_SQL = None  # tokenizer and learned languages are outside SQL


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shipped(stage: Stage) -> Stage:
    """The stage with this package sent to the executors first."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language that holds at least half of the words."""
    return language_mixture.keep_identified(docs, docs.filter(language_mixture.remainder("doc_id", 3) != 1))


@shipped
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate group."""
    return near_dedup.keep_first(docs)


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


@shipped
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked source, language and topic weights."""
    return raking.sample(docs)


@shipped
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents left, from the token files."""
    return token_output.encode_and_index(docs, default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the whole result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
