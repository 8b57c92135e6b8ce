"""Bronze to silver: one row per quote occurrence with stable identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.functions import ids, text
from lapidary.operators.latest import latest_per_key
from lapidary.sources import merge

SILVER_COLUMNS = [
    "occurrence_id",
    "quote_id",
    "thinker_qid",
    "thinker_name",
    "quote_text",
    "original_text",
    "original_language",
    "category",
    "work",
    "source_url",
    "source_name",
    "source_license",
    "source_revision",
    "translator_name",
    "translation_license",
    "translation_url",
    "fetched_at",
    "source_kind",
    "character_count",
]
#: Columns that settle equal fetch times.
TIES = [name for name in SILVER_COLUMNS if name not in ("occurrence_id", "fetched_at")]
_ONLY_SUPPLEMENTAL = [
    "original_text",
    "original_language",
    "translator_name",
    "translation_license",
    "translation_url",
]


def union_sources(quotes: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Both bronze tables under one schema, marked by ``source_kind``."""
    scraped = quotes.withColumns({name: F.lit(None).cast("string") for name in _ONLY_SUPPLEMENTAL})
    reviewed = supplemental.withColumnRenamed("reviewed_at", "fetched_at")
    return scraped.withColumn("source_kind", F.lit("wikiquote")).unionByName(
        reviewed.withColumn("source_kind", F.lit("supplemental"))
    )


def identify(rows: DataFrame) -> DataFrame:
    """Clean the text and add the content identity and the occurrence identity."""
    return (
        rows.withColumn("quote_text", text.clean_text(F.col("text")))
        .withColumn("character_count", F.length("quote_text").cast("long"))
        .withColumn("quote_id", ids.quote_id(F.col("thinker_qid"), F.col("quote_text")))
        .withColumn(
            "occurrence_id",
            ids.occurrence_id(
                F.col("quote_id"), F.col("category"), F.col("work"), F.col("source_revision"), F.col("source_url")
            ),
        )
        .select(*SILVER_COLUMNS)
    )


def normalise_quotes(quotes: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Silver table: identified occurrences, each at its latest snapshot."""
    return latest_quotes(identify(union_sources(quotes, supplemental)))


def latest_quotes(identified: DataFrame) -> DataFrame:
    """Each identified occurrence at its latest snapshot."""
    return latest_per_key(identified, ["occurrence_id"], "fetched_at", TIES)


def merge_quotes(quotes: DataFrame, supplemental: DataFrame, target: str) -> list[str]:
    """Merge the rows of a new snapshot into the silver table in ``target``; only the buckets they touch are read."""
    return merge.merge_latest(identify(union_sources(quotes, supplemental)), target, "occurrence_id", "fetched_at", TIES)


def dim_thinkers(thinkers: DataFrame) -> DataFrame:
    """One row per thinker, at its latest snapshot."""
    renamed = thinkers.withColumnsRenamed({"qid": "thinker_qid", "name": "thinker_name"}).select(
        "thinker_qid", "thinker_name", "wikiquote_title", "source_url", "source_revision", "fetched_at"
    )
    ties = ["source_revision", "thinker_name", "wikiquote_title", "source_url"]
    return latest_per_key(renamed, ["thinker_qid"], "fetched_at", ties)
