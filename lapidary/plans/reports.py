"""Audit metrics and collection coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions import text
from lapidary.operators.picks import SLICE_DIGITS, slice_bounds
from lapidary.session import reused


def audit_metrics(gold: DataFrame) -> DataFrame:
    status = F.col("curation_status")
    return gold.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("thinker_qid").alias("thinkers"),
        F.count_if(status == "accepted").alias("accepted"),
        F.count_if(status == "review").alias("review"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if("is_daily_eligible").alias("daily"),
    )


def reason_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy("quality_reason").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "quality_reason")


def top_suspects(gold: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` longest texts that were not accepted."""
    return (
        gold.filter(F.col("curation_status") != "accepted")
        .select("thinker_name", "quote_text", "quality_reason", "character_count", "occurrence_id")
        .orderBy(F.desc("character_count"), "occurrence_id")
        .limit(n)
    )


def filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def eligible_by_name(gold: DataFrame, thinkers: DataFrame) -> DataFrame:
    """Figures of the daily cut per thinker name.

    Quotes are summed per thinker before the dimension is joined, so a thinker
    with most of the quotes reaches the join as one row.
    """

    per_qid = (
        gold.filter("is_daily_eligible")
        .groupBy("thinker_qid")
        .agg(
            F.count(F.lit(1)).alias("quotes"),
            F.count_if(filled("source_name") & filled("source_license") & filled("source_url")).alias("with_source"),
            F.count_if(filled("work")).alias("with_work"),
            F.min("character_count").alias("shortest"),
            F.sum("character_count").alias("length_total"),
            F.max("character_count").alias("longest"),
        )
    )
    return (
        per_qid.join(thinkers.select("thinker_qid", "thinker_name"), "thinker_qid")
        .groupBy("thinker_name")
        .agg(
            *[F.sum(c).alias(c) for c in ("quotes", "with_source", "with_work", "length_total")],
            F.min("shortest").alias("shortest"),
            F.max("longest").alias("longest"),
        )
    )


def collection_coverage(gold: DataFrame, thinkers: DataFrame, members: DataFrame) -> DataFrame:
    """Coverage of each collection; ``members`` holds (slug, title, thinker_name) without repeats.

    The list of uncovered names is a part of the collection's own member list.
    """
    joined = members.join(eligible_by_name(gold, thinkers), "thinker_name", "left")
    uncovered = F.when(F.col("quotes").isNull(), F.col("thinker_name"))
    quotes = F.coalesce(F.sum("quotes"), F.lit(0))
    mean = F.bround(F.sum("length_total") / F.sum("quotes"), 1)
    return joined.groupBy("slug", "title").agg(
        F.count(F.lit(1)).alias("members"),
        F.count("quotes").alias("covered_members"),
        quotes.alias("eligible_quotes"),
        F.coalesce(F.sum("with_source"), F.lit(0)).alias("complete_sources"),
        F.coalesce(F.sum("with_work"), F.lit(0)).alias("identified_works"),
        F.coalesce(F.min("shortest"), F.lit(0)).alias("shortest"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("longest"),
        F.array_sort(F.collect_list(uncovered)).alias("uncovered"),
    )


def text_key() -> Column:
    return F.sha2(text.comparison_key(F.col("quote_text")), 256)


def audit_rows(gold: DataFrame) -> DataFrame:
    """What ``collection_audit`` reads of gold, so that no text need be kept between its passes."""
    sources = ["source_name", "source_license", "source_url", "work"]
    given = [F.when(filled(c), "x").alias(c) for c in sources]
    key = F.when(F.col("is_daily_eligible"), text_key()).alias("text_key")
    return gold.select("thinker_qid", "is_daily_eligible", "character_count", *given, key)


def duplicate_texts(eligible: DataFrame) -> DataFrame:
    """Rows beyond the first of each case-folded, blank-normalised text."""
    # Digests keep the shuffled keys short; equal texts meet map-side first.
    key = F.col("text_key") if "text_key" in eligible.columns else text_key()
    per_text = eligible.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    return per_text.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_texts"))


def collection_audit(
    gold: DataFrame,
    thinkers: DataFrame,
    members: DataFrame,
    quotes_per_thinker: int = fixed.DAILY_QUOTES_PER_THINKER,
) -> DataFrame:
    """One row for the whole daily cut, with the verdict on full coverage."""
    named = thinkers.select("thinker_qid")
    eligible = gold.filter("is_daily_eligible").join(named, "thinker_qid", "left_semi")
    totals = gold.agg(F.count(F.lit(1)).alias("total_records"))
    known = thinkers.agg(F.count(F.lit(1)).alias("thinkers"))
    by_name = eligible_by_name(gold, thinkers).agg(
        F.coalesce(F.sum("quotes"), F.lit(0)).alias("eligible_quotes"),
        F.coalesce(F.min("quotes"), F.lit(0)).alias("fewest_per_thinker"),
        F.coalesce(F.max("quotes"), F.lit(0)).alias("most_per_thinker"),
    )
    gaps = collection_coverage(gold, thinkers, members).agg(
        F.coalesce(F.bool_and(F.size("uncovered") == 0), F.lit(True)).alias("no_gaps")
    )
    # Every side is one row with columns of its own: stack them and keep the value of each column.
    rows = totals
    for side in (known, by_name, duplicate_texts(eligible), gaps):
        rows = rows.unionByName(side, allowMissingColumns=True)
    row = rows.agg(*[F.max(name).alias(name) for name in rows.columns])
    n = F.lit(quotes_per_thinker)
    return row.withColumn(
        "fully_covered",
        F.col("no_gaps") & (F.col("fewest_per_thinker") == n) & (F.col("most_per_thinker") == n),
    ).drop("no_gaps")


def numbered_texts(texts: DataFrame, digits: int = SLICE_DIGITS) -> DataFrame:
    """(owner, number) beside ``texts`` (thinker_name, text_key, without repeats): a dense number of each text.

    A text belongs to the first of its thinkers by name, and the texts of an owner are numbered from 0, so the numbers
    of a thinker's texts lie close together. Numbers are counted per slice of the key and over the slices of an
    owner: no task numbers more than one slice.
    """
    owners = texts.groupBy("text_key").agg(F.min("thinker_name").alias("owner"))
    sliced = reused(owners.withColumn("slice", F.substring("text_key", 1, digits)))
    counts = sliced.groupBy("owner", "slice").agg(F.count(F.lit(1)).alias("rows"))
    before = slice_bounds(counts, ["owner"]).select("owner", "slice", "before")
    in_slice = Window.partitionBy("owner", "slice").orderBy("text_key")
    numbers = sliced.withColumn("place", F.row_number().over(in_slice)).join(before, ["owner", "slice"])
    number = (F.col("before") + F.col("place") - 1).alias("number")
    return texts.join(numbers.select("text_key", "owner", number), "text_key")


def collection_texts(gold: DataFrame, thinkers: DataFrame, members: DataFrame) -> DataFrame:
    """Eligible quotes and distinct texts of each collection; a text that two members share counts once.

    Each thinker's texts become bitmaps of their numbers, one for each owner and 32,768 numbers, and a collection's are
    the union of its members': quotes are never joined with members, however many collections share a thinker.
    """
    named = gold.filter("is_daily_eligible").join(thinkers.select("thinker_qid", F.col("thinker_name").alias("_name")), "thinker_qid")
    eligible = reused(named.select(F.col("_name").alias("thinker_name"), text_key().alias("text_key")))
    quotes = eligible.groupBy("thinker_name").agg(F.count(F.lit(1)).alias("quotes"))
    numbered = numbered_texts(eligible.filter("thinker_name is not null").distinct())
    # Bit positions of the number itself, which starts at 0; the functions count from 1.
    number = F.col("number") + 1
    chunk, bit = F.bitmap_bucket_number(number).alias("chunk"), F.bitmap_bit_position(number).alias("bit")
    bits = numbered.select("thinker_name", "owner", chunk, bit)
    bitmaps = bits.groupBy("thinker_name", "owner", "chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    unions = (
        members.select("slug", "thinker_name")
        .join(bitmaps, "thinker_name")
        .groupBy("slug", "owner", "chunk")
        .agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("texts"))
        .groupBy("slug")
        .agg(F.sum("texts").alias("texts"))
    )
    sums = members.join(quotes, "thinker_name", "left").groupBy("slug").agg(F.coalesce(F.sum("quotes"), F.lit(0)).alias("eligible_quotes"))
    return sums.join(unions, "slug", "left").select("slug", "eligible_quotes", F.coalesce("texts", F.lit(0)).alias("distinct_texts"))
