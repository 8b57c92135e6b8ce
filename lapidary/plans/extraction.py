"""Sections and items to bronze quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions import text
from lapidary.sources import pages as page_source


def carry_sections(blocks: DataFrame, page: list[str], position: str) -> DataFrame:
    """Add ``section`` to table-shaped blocks (``is_heading``, ``text``): the last heading of the page so far.

    The window covers the blocks of one page, which arrived as one record.
    """
    so_far = Window.partitionBy(*page).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(F.col("is_heading"), F.col("text"))
    return blocks.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(so_far), F.lit(fixed.TOP_SECTION)))


def section_category(base: Column) -> Column:
    return (
        F.when(base.isin(*fixed.VERIFIED_SECTIONS), "verificada")
        .when(base.isin(*fixed.ATTRIBUTED_SECTIONS), "atribuida")
        .otherwise("obra")
    )


def classify_items(items: DataFrame, denied: list[str] | None = None) -> DataFrame:
    """Items (``section``, ``item``) to quotes (``text``, ``category``, ``work``); denied sections and noise go."""
    sectioned = items.withColumn("_section", text.collapse_whitespace(F.col("section"))).withColumn(
        "_base", text.section_base(F.col("_section"))
    )
    kept = sectioned.filter(~F.col("_base").isin(*(fixed.DENIED_SECTIONS if denied is None else denied)))
    return (
        kept.withColumn("text", text.strip_outer_quotes(F.col("item")))
        .filter(F.length("text") >= fixed.MIN_QUOTE_LENGTH)
        .withColumn("category", section_category(F.col("_base")))
        .withColumn("work", F.when(F.col("category") == "obra", F.col("_section")))
        .drop("_section", "_base", "section", "item")
    )


def extract_quotes(pages: DataFrame, rules: page_source.PageRules = page_source.PageRules()) -> DataFrame:
    """Pages (qid, name, title, revision, fetched_at, html) to bronze quotes with their place on the page."""
    keys = ["qid", "name", "title", "revision", "fetched_at"]
    quotes = classify_items(page_source.read_items(pages, keys, "html", rules))
    return quotes.select(
        F.col("qid").alias("thinker_qid"),
        F.col("name").alias("thinker_name"),
        "text",
        "category",
        "work",
        text.page_url(F.col("title"), fixed.PAGE_URL_PREFIX).alias("source_url"),
        F.lit(fixed.PAGE_SOURCE_NAME).alias("source_name"),
        F.lit(fixed.PAGE_LICENSE).alias("source_license"),
        F.col("revision").alias("source_revision"),
        "fetched_at",
        "item_no",
    )


def thinker_rows(pages: DataFrame) -> DataFrame:
    """Pages to bronze thinkers, one row per page."""
    return pages.select(
        "qid",
        "name",
        F.col("title").alias("wikiquote_title"),
        text.page_url(F.col("title"), fixed.PAGE_URL_PREFIX).alias("source_url"),
        F.col("revision").alias("source_revision"),
        "fetched_at",
    )
