"""Schemas and readers of the bronze and seed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BRONZE_QUOTES = """thinker_qid string, thinker_name string, text string, category string, work string,
    source_url string, source_name string, source_license string, source_revision bigint, fetched_at timestamp"""
BRONZE_SUPPLEMENTAL = """thinker_qid string, thinker_name string, text string, original_text string,
    original_language string, category string, work string, source_url string, source_name string,
    source_license string, source_revision bigint, translator_name string, translation_license string,
    translation_url string, reviewed_at timestamp"""
BRONZE_THINKERS = """qid string, name string, wikiquote_title string, source_url string, source_revision bigint,
    fetched_at timestamp"""
SELECTION_SEED = "thinker_qid string, quote_id string"
QUEUE_SEED = "thinker_qid string, quote_id string, review_status string, review_reason string"
BRONZE = {
    "quotes": BRONZE_QUOTES,
    "supplemental_quotes": BRONZE_SUPPLEMENTAL,
    "thinkers": BRONZE_THINKERS,
}


def read_bronze(spark: SparkSession, run_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BRONZE[name]).parquet(f"{run_dir}/{name}")


def write_bronze(df: DataFrame, run_dir: str, name: str) -> None:
    """Zstd Parquet in the run's own folder, which must be new; tables without rows are fine."""
    schema = df.sparkSession.createDataFrame([], BRONZE[name]).schema
    columns = [df[field.name].cast(field.dataType).alias(field.name) for field in schema]
    df.select(*columns).write.mode("errorifexists").option("compression", "zstd").parquet(f"{run_dir}/{name}")


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
