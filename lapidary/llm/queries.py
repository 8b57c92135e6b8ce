"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm import (
    collocations, decontaminate, divergence, importance, licences, line_crf, mixing, popcount_dedup, revisits, token_store, toxicity, url_filter, wrapper,
)
from lapidary.llm.common import new_path

#: Names in a host that put its pages on the list of op6.
LISTED_HOSTS = "casino|bets|pills|ads-track"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("content_share", 6).alias("content_share"),
    )


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path)
    return token_store.read_summary(spark, path)


def op3_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    text = F.array_join("blocks", "\n")
    return found.select("row.page_id", "row.url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs)).drop("text")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.regexp_like(url_filter.host(F.col("url")), F.lit(LISTED_HOSTS))).select("url")
    return url_filter.judge(pages, listed).select("row.page_id", "host", "path", "rule", "verdict", "listed")


def captures(pages: DataFrame) -> DataFrame:
    """Three captures of each page: a full response, a revisit an hour later, and a visit to the host's first page.

    The digest of the page decides what the last two look like, so that entity tags match, match weakly or differ.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    site = F.regexp_extract("url", "^[^/]*://[^/?#]*", 0)
    page = pages.select("page_id", "url", digest.alias("d"), site.alias("site"), (F.lit(1767225600) + F.col("page_id") * 60).alias("t"))
    tag = F.concat(F.lit('"'), F.substring("d", 1, 8), F.lit('"'))
    visit = F.substring("d", 2, 1)

    def headers(tag, seconds, age):
        pairs = {"etag": tag, "date": seconds.cast("string"), "cache-control": F.concat(F.lit("max-age="), age), "content-length": F.substring("d", 1, 2), "content-type": F.lit("text/html")}
        return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())

    first = F.substring("d", 1, 1)
    again = F.when(first < "4", F.lit('"old"')).when(first < "8", F.concat(F.lit("W/"), tag)).when(first < "c", tag)
    home = F.concat(F.lit('"'), visit, F.lit('"'))
    kinds = [
        (F.col("page_id") * 3, F.col("url"), F.col("t"), F.lit("response"), headers(tag, F.col("t"), F.lit("60"))),
        (F.col("page_id") * 3 + 1, F.col("url"), F.col("t") + 3600, F.lit("revisit"), headers(again, F.col("t") + 3600, F.lit("90"))),
        (F.col("page_id") * 3 + 2, F.concat("site", F.lit("/")), F.col("t") + 30,
         F.when(first < "4", "response").otherwise("revisit"), headers(home, F.col("t") + 30, visit)),
    ]
    rows = F.array(*[F.struct(i.alias("capture_id"), u.alias("url"), t.alias("seconds"), k.alias("kind"), F.col("d").alias("digest"), h.alias("headers")) for i, u, t, k, h in kinds])
    return page.select(F.explode(rows).alias("c")).select("c.*")


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisits.header_text(F.col("headers")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]
    taken = mixing.mixed(table(spark, sf_dir, "documents"), paths)
    return taken.select("row.doc_id", F.col("p0").alias("domain"), "row.lang", "row.source", "n_tokens", "epoch")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("row.doc_id", F.round("log_ratio", 4).alias("log_ratio"), "kept")


def op10_popcount_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = popcount_dedup.near_duplicates(texts)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
