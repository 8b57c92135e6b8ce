"""Data tests of the curated tables and the gates in front of publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions import text
from lapidary.operators import violations as v

# Required, unique and listed columns of each relation.
REQUIRED = {
    "stg_quotes": ["occurrence_id", "quote_id", "thinker_qid", "source_name", "source_license", "source_kind"],
    "dim_thinkers": ["thinker_qid"],
    "fct_quotes": [
        "occurrence_id",
        "quote_id",
        "source_name",
        "source_license",
        "quality_reasons",
        "editorial_approved",
        "is_daily_eligible",
    ],
    "editorial_review_queue": ["quote_id", "thinker_qid"],
    "daily_quote_selection": ["quote_id", "thinker_qid"],
    "quote_review_queue": ["quote_id", "thinker_qid", "review_status", "review_reason"],
}
UNIQUE = {
    "stg_quotes": "occurrence_id",
    "dim_thinkers": "thinker_qid",
    "fct_quotes": "occurrence_id",
    "editorial_review_queue": "quote_id",
    "daily_quote_selection": "quote_id",
    "quote_review_queue": "quote_id",
}
ACCEPTED = {
    ("stg_quotes", "source_kind"): fixed.SOURCE_KINDS,
    ("stg_quotes", "category"): fixed.CATEGORIES,
    ("fct_quotes", "curation_status"): fixed.CURATION_STATUSES,
    ("quote_review_queue", "review_status"): fixed.REVIEW_STATUSES,
    ("quote_review_queue", "review_reason"): fixed.REVIEW_REASONS,
}
REFERENCES = {"fct_quotes": "thinker_qid", "editorial_review_queue": "thinker_qid"}


def _labelled(df: DataFrame, **labels: str) -> DataFrame:
    return df.select(*[F.lit(value).alias(name) for name, value in labels.items()], "*")


def _stack(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """Null counts of every required column, one scan per relation."""
    return _stack(
        [_labelled(v.null_counts(tables[name], columns), relation=name) for name, columns in REQUIRED.items()]
    )


def unique(tables: dict[str, DataFrame]) -> DataFrame:
    frames = []
    for name, column in UNIQUE.items():
        repeats = v.repeated_keys(tables[name], [column]).withColumnRenamed(column, "key")
        frames.append(_labelled(repeats, relation=name))
    return _stack(frames)


def accepted_values(tables: dict[str, DataFrame]) -> DataFrame:
    frames = []
    for (name, column), accepted in ACCEPTED.items():
        outside = v.unaccepted_values(tables[name], column, accepted)
        frames.append(_labelled(outside, relation=name, column_name=column))
    return _stack(frames)


def relationships(tables: dict[str, DataFrame]) -> DataFrame:
    frames = []
    for name, column in REFERENCES.items():
        lost = v.orphans(tables[name], column, tables["dim_thinkers"], "thinker_qid")
        frames.append(_labelled(lost, relation=name))
    return _stack(frames)


def breaks_translation_provenance() -> Column:
    """A supplemental row with an original must credit the translation in full, and only then."""
    details = [F.col(c) for c in ("original_language", "translator_name", "translation_license", "translation_url")]
    some_null, some_filled = F.lit(False), F.lit(False)
    for detail in details:
        some_null = some_null | detail.isNull()
        some_filled = some_filled | detail.isNotNull()
    original = F.col("original_text").isNotNull()
    return (F.col("source_kind") == "supplemental") & ((original & some_null) | (~original & some_filled))


def translation_provenance(silver: DataFrame) -> DataFrame:
    return silver.filter(breaks_translation_provenance())


def source_artifacts(silver: DataFrame) -> DataFrame:
    return silver.filter(text.has_source_artifacts(F.col("quote_text"))).select("quote_id")


def citation_only_daily(gold: DataFrame) -> DataFrame:
    return gold.filter(F.col("citation_only") & F.col("is_daily_eligible")).select("quote_id")


def attribution_section_daily(gold: DataFrame) -> DataFrame:
    return gold.filter(F.col("attribution_section") & F.col("is_daily_eligible")).select("quote_id")


def row_level_summary(gold: DataFrame) -> DataFrame:
    """Violations of the row-level rules in one scan of the gold table, silver columns included."""
    return v.violation_counts(
        gold,
        {
            "no_citation_only_daily": F.col("citation_only") & F.col("is_daily_eligible"),
            "no_attribution_section_daily": F.col("attribution_section") & F.col("is_daily_eligible"),
            "no_source_artifacts": text.has_source_artifacts(F.col("quote_text")),
            "supplemental_translation_provenance": breaks_translation_provenance(),
        },
    )


def supplemental_repeats(silver: DataFrame) -> DataFrame:
    """Quotes that both source kinds hold.

    One row per quote with the rows on either side; their product is the number
    of matching pairs, which are never formed.
    """
    per_quote = (
        silver.filter(F.col("quote_id").isNotNull())
        .groupBy("quote_id")
        .agg(
            F.count_if(F.col("source_kind") == "supplemental").alias("supplemental_rows"),
            F.count_if(F.col("source_kind") == "wikiquote").alias("wikiquote_rows"),
        )
    )
    both = per_quote.filter("supplemental_rows > 0 and wikiquote_rows > 0")
    return both.withColumn("pairs", F.col("supplemental_rows") * F.col("wikiquote_rows"))


def daily_counts(gold: DataFrame, thinkers: DataFrame, expected: int = fixed.DAILY_QUOTES_PER_THINKER) -> DataFrame:
    """Thinkers whose number of eligible occurrences is not the expected one, zero included."""
    eligible = _eligible_per_thinker(gold)
    return (
        thinkers.groupBy("thinker_qid")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .join(eligible, "thinker_qid", "left")
        .select("thinker_qid", (F.coalesce("quotes", F.lit(0)) * F.col("_copies")).alias("daily_quote_count"))
        .filter(F.col("daily_quote_count") != expected)
    )


def _eligible_per_thinker(gold: DataFrame) -> DataFrame:
    return gold.filter("is_daily_eligible").groupBy("thinker_qid").agg(F.count("quote_id").alias("quotes"))


def _matched_queue(queue: DataFrame, gold: DataFrame, condition: Column) -> DataFrame:
    """Queue entries with a matching quote that meets the condition, counted per matching occurrence."""
    hits = (
        gold.filter(condition)
        .groupBy("thinker_qid", "quote_id")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    return queue.select("thinker_qid", "quote_id").join(hits, ["thinker_qid", "quote_id"])


def queue_missing(queue: DataFrame, gold: DataFrame, enabled: bool = True) -> DataFrame:
    entries = queue.select("thinker_qid", "quote_id").filter(F.lit(enabled))
    return entries.join(gold.select("thinker_qid", "quote_id"), ["thinker_qid", "quote_id"], "left_anti")


def queue_already_approved(queue: DataFrame, gold: DataFrame, enabled: bool = True) -> DataFrame:
    return _matched_queue(queue.filter(F.lit(enabled)), gold, F.col("editorial_approved"))


def queue_hard_failures(queue: DataFrame, gold: DataFrame, enabled: bool = True) -> DataFrame:
    """Queue entries no editor may promote; a short text is allowed in the queue."""
    hard = (
        F.col("citation_only")
        | F.col("attributed")
        | F.col("leading_fragment")
        | F.col("attribution_section")
        | F.col("very_long")
    )
    return _matched_queue(queue.filter(F.lit(enabled)), gold, hard)


def queue_balance(
    queue: DataFrame,
    thinkers: DataFrame,
    expected: int = 2,
    exempt: tuple[str, ...] = fixed.QUEUE_EXEMPT,
    enabled: bool = True,
) -> DataFrame:
    """Thinkers without the expected number of queue entries; exempt thinkers must have none."""
    counts = queue.groupBy("thinker_qid").agg(F.count("quote_id").alias("_entries"))
    wanted = F.when(F.col("thinker_qid").isin(*exempt), 0).otherwise(expected) if exempt else F.lit(expected)
    return (
        thinkers.select("thinker_qid")
        .filter(F.lit(enabled))
        .join(counts, "thinker_qid", "left")
        .select("thinker_qid", F.coalesce("_entries", F.lit(0)).alias("candidate_count"))
        .filter(F.col("candidate_count") != wanted)
    )


def missing_thinkers(expected: DataFrame, thinkers: DataFrame) -> DataFrame:
    """Gate: expected names (``thinker_name``) that the dimension does not hold."""
    return v.missing(expected, thinkers, "thinker_name")


def _eligible_by_name(gold: DataFrame, thinkers: DataFrame) -> DataFrame:
    per_qid = gold.filter("is_daily_eligible").groupBy("thinker_qid").agg(F.count(F.lit(1)).alias("_quotes"))
    named = per_qid.join(thinkers.select("thinker_qid", "thinker_name"), "thinker_qid")
    return named.groupBy("thinker_name").agg(F.sum("_quotes").alias("quote_count"))


def thinkers_without_eligible(expected: DataFrame, gold: DataFrame, thinkers: DataFrame) -> DataFrame:
    """Gate: expected names without an eligible quote."""
    return v.missing(expected, _eligible_by_name(gold, thinkers), "thinker_name")


def wrong_daily_counts(
    gold: DataFrame, thinkers: DataFrame, expected: int = fixed.DAILY_QUOTES_PER_THINKER
) -> DataFrame:
    """Gate: names whose eligible quotes are not of the expected number; names with none are not seen here."""
    return _eligible_by_name(gold, thinkers).filter(F.col("quote_count") != expected)
