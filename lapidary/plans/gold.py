"""Silver to gold: quality reasons, editorial status and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions import text
from lapidary.operators.latest import first_per_key


def assess(silver: DataFrame) -> DataFrame:
    """Rule flags and the ordered list of reasons they give."""
    flagged = silver.withColumns(
        {
            "citation_only": text.is_citation_only(F.col("quote_text")),
            "attributed": F.col("category") == "atribuida",
            "leading_fragment": text.is_leading_fragment(F.col("quote_text")),
            "attribution_section": F.lower(F.coalesce("work", F.lit(""))).contains("atribu"),
            "very_short": F.col("character_count") < fixed.SHORT_TEXT_BELOW,
            "very_long": F.col("character_count") > fixed.LONG_TEXT_ABOVE,
        }
    )
    # Reason names in priority order.
    reasons = [
        ("citation_only", "citation_only"),
        ("very_short", "short_text"),
        ("very_long", "long_text"),
        ("attributed", "attributed_quote"),
        ("leading_fragment", "leading_fragment"),
        ("attribution_section", "attribution_section"),
    ]
    given = F.array(*[F.when(F.col(flag), F.lit(reason)) for flag, reason in reasons])
    return flagged.withColumn("quality_reasons", F.array_compact(given))


def approve(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Mark rows whose quote and thinker are both on the allowlist.

    The side is not hinted: a small allowlist is broadcast by its size, a large
    one is joined by shuffle with the runtime skew split.
    """
    allowed = selection.select("quote_id", "thinker_qid", F.lit(True).alias("_approved"))
    return (
        rows.join(allowed, ["quote_id", "thinker_qid"], "left")
        .withColumn("editorial_approved", F.col("_approved").isNotNull())
        .drop("_approved")
    )


def decide(rows: DataFrame) -> DataFrame:
    """Status, primary reason and eligibility from the flags."""
    review = (
        F.col("very_short")
        | F.col("very_long")
        | F.col("attributed")
        | F.col("leading_fragment")
        | F.col("attribution_section")
    )
    status = F.when(F.col("citation_only"), "rejected").when(review, "review").otherwise("accepted")
    reason = F.when(F.size("quality_reasons") == 0, "passed_automatic_rules").otherwise(
        F.try_element_at("quality_reasons", F.lit(1))
    )
    passes = ~F.col("citation_only") & ~review
    return rows.withColumns(
        {
            "curation_status": status,
            "quality_reason": reason,
            "passes_automatic_rules": passes,
            "is_daily_eligible": passes & F.col("editorial_approved"),
        }
    )


def curate(silver: DataFrame, selection: DataFrame) -> DataFrame:
    """Gold table: every silver row with its assessment and editorial decision."""
    return decide(approve(assess(silver), selection))


def review_queue(queue: DataFrame, gold: DataFrame) -> DataFrame:
    """Queue entries with their newest occurrence, one row per quote."""
    details = gold.select(
        "thinker_qid",
        "quote_id",
        "thinker_name",
        "quote_text",
        "category",
        "work",
        "character_count",
        "curation_status",
        "quality_reasons",
        "source_name",
        "source_license",
        "source_url",
        "source_revision",
        "occurrence_id",
    )
    matched = details.join(queue, ["thinker_qid", "quote_id"])
    newest = first_per_key(
        matched,
        ["quote_id"],
        [F.desc_nulls_last("source_revision"), F.asc_nulls_last("occurrence_id")],
    )
    return newest.select(
        "thinker_qid",
        "thinker_name",
        "quote_id",
        "review_status",
        "review_reason",
        "quote_text",
        "category",
        "work",
        "character_count",
        "curation_status",
        "quality_reasons",
        "source_name",
        "source_license",
        "source_url",
        "source_revision",
    ).orderBy("thinker_name", "quote_id")
