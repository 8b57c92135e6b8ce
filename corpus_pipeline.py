"""The corpus pipeline: five stages over documents, each one operator of ``lapidary.llm``.

Stages take (spark, docs, sf_dir) and give a table that is written as Parquet and read again for the next stage. All
but the last keep the columns of documents, extra ones included. What an operator does with nulls, empty and very
long texts, ties, repeated rows, empty tables and extra columns is stated in its module and holds here too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm import decontaminate, importance, mixing, popcount_dedup, token_store
from lapidary.llm.common import new_path, written

#: Each document can be taken once; the budget is this share of the tokens that reach the mixing.
EPOCHS, SHARE = 1, 0.8
#: Pieces of text that a worker of the last stage remembers: other stages run in the same workers.
REMEMBERED = 300_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.resample(docs, labels).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id."""
    return popcount_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their source's share of the token budget."""
    paths = [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]
    return mixing.mixed(docs, paths, share=SHARE, epochs=EPOCHS).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents as read back from the token store."""
    path = new_path(spark, "tokens")
    token_store.write(docs, path, remembered=REMEMBERED)
    return token_store.read_summary(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("tokens", tokens),
]

#: The first two stages use hashes that DuckDB does not have; tests/llm compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
