"""Raw JSON snapshots: records, checks, manifest and the all-or-nothing load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions import ids


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored JSON documents, one per file: (file, document)."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))


def misnamed_documents(documents: DataFrame) -> DataFrame:
    """Documents whose file name does not carry the digest of their content."""
    named = F.regexp_extract("file", r"([0-9a-f]{64})\.json\z", 1)
    actual = F.sha2("document", 256)
    return documents.select("file", named.alias("named"), actual.alias("actual")).filter("named <> actual")


def canonical_json(raw: Column) -> Column:
    """JSON with sorted keys and no blanks; null when the text is not JSON."""
    return F.to_json(F.try_parse_json(raw))


def _revision(parsed: Column) -> Column:
    """``parse.revid`` when the document holds it as an integer."""
    path = "$.parse.revid"
    is_integer = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "BIGINT"
    return F.when(is_integer, F.try_variant_get(parsed, path, "bigint"))


def source_records(fetched: DataFrame) -> DataFrame:
    """One record per requested source.

    ``fetched``: requested_name, fetched_at, ``resolution``, ``wikiquote`` and
    ``wikidata`` as raw JSON, and ``fetch_error`` (null unless the fetch failed).
    Canonical documents stay in the record, named by their own digest.
    """
    parsed = fetched.select(
        "requested_name",
        "fetched_at",
        "fetch_error",
        F.get_json_object("resolution", "$.query.pages[0].title").alias("title"),
        F.get_json_object("resolution", "$.query.pages[0].pageprops.wikibase_item").alias("qid"),
        F.try_parse_json("wikiquote").alias("_page"),
        canonical_json(F.col("wikiquote")).alias("wikiquote_json"),
        canonical_json(F.col("wikidata")).alias("wikidata_json"),
    ).withColumn("revision", _revision(F.col("_page")))
    error = (
        F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(F.coalesce("qid", F.lit("")) == "", "page_without_entity")
        .when(F.col("revision").isNull(), "page_without_revision")
        .when(F.col("wikidata_json").isNull(), "entity_not_json")
    )
    hashed = parsed.withColumns(
        {
            "error": error,
            "wikiquote_sha256": F.sha2("wikiquote_json", 256),
            "wikidata_sha256": F.sha2("wikidata_json", 256),
        }
    )
    success = F.col("error").isNull()
    page_file = F.concat(
        F.lit("wikiquote/"), "qid", F.lit("-"), F.col("revision").cast("string"), F.lit("-"), "wikiquote_sha256", F.lit(".json")
    )
    entity_file = F.concat(F.lit("wikidata/"), "qid", F.lit("-"), "wikidata_sha256", F.lit(".json"))
    shown = {
        "wikiquote_title": F.col("title"),
        "qid": F.col("qid"),
        "wikiquote_revision": F.col("revision"),
        "wikiquote_file": page_file,
        "wikiquote_sha256": F.col("wikiquote_sha256"),
        "wikidata_file": entity_file,
        "wikidata_sha256": F.col("wikidata_sha256"),
        "fetched_at": F.col("fetched_at"),
        "wikiquote_json": F.col("wikiquote_json"),
        "wikidata_json": F.col("wikidata_json"),
    }
    return hashed.select(
        "requested_name",
        F.when(success, "success").otherwise("failed").alias("status"),
        "error",
        *[F.when(success, value).alias(name) for name, value in shown.items()],
    )


def manifest(records: DataFrame, run_id: str) -> DataFrame:
    """Manifest rows: the records without their documents, under the run's id."""
    return records.drop("wikiquote_json", "wikidata_json").select(F.lit(run_id).alias("run_id"), "*")


def manifest_summary(rows: DataFrame) -> DataFrame:
    """Per run: status, counts, the first failed source's error and an order-free digest of all manifest fields."""
    # Times count as microseconds: their text would depend on the session's time zone.
    fields = [F.unix_micros(c) if kind == "timestamp" else F.col(c) for c, kind in rows.dtypes]
    label = f"parser:{fixed.PARSER_VERSION}"
    sums = (
        rows.withColumn("_digest", ids.row_digest(label, fields))
        .groupBy("run_id")
        .agg(
            F.count_if(F.col("status") != "success").alias("failed_sources"),
            F.min(F.when(F.col("status") != "success", F.struct("requested_name", "error"))).alias("_failure"),
            *ids.digest_sums(F.col("_digest")),
        )
    )
    return sums.select(
        "run_id",
        F.when(F.col("failed_sources") == 0, "complete").otherwise("failed").alias("status"),
        F.col("row_total").alias("sources"),
        "failed_sources",
        F.col("_failure.error").alias("error"),
        ids.digest_of_sums(label).alias("manifest_sha256"),
    )


def pages_of(records: DataFrame) -> DataFrame:
    """Pages of successful records, ready for extraction."""
    return records.filter("status = 'success'").select(
        "qid",
        F.col("requested_name").alias("name"),
        F.col("wikiquote_title").alias("title"),
        F.col("wikiquote_revision").alias("revision"),
        "fetched_at",
        F.coalesce(F.get_json_object("wikiquote_json", "$.parse.text"), F.lit("")).alias("html"),
    )


def store_documents(records: DataFrame, store: str, digits: int = 2) -> int:
    """Add the documents of successful records to the store, a table named by content; returns how many were new.

    The store holds sha256, kind, qid and document in folders by the digest's first digits. Digests that it holds are
    left out by an exact anti join on digests alone, so a second run over the same pages writes nothing.
    """
    spark = records.sparkSession
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(f"{k}_sha256").alias("sha256"), F.col(f"{k}_json").alias("document")) for k in ("wikiquote", "wikidata")]
    documents = records.filter("status = 'success'").select("qid", F.explode(F.array(*kinds)).alias("d")).select("qid", "d.*")
    once = documents.groupBy("sha256").agg(*[F.min(F.struct("kind", "qid", "document")).alias("d")]).select("sha256", "d.*")
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        once = once.join(read_store(spark, store).select("sha256"), "sha256", "left_anti")
    seen = Observation()
    (
        once.withColumn("prefix", F.substring("sha256", 1, digits))
        .repartitionByRange("prefix", "sha256")
        .sortWithinPartitions("prefix", "qid")
        .observe(seen, F.count(F.lit(1)).alias("documents"))
        .write.partitionBy("prefix")
        .mode("append")
        .option("compression", "zstd")
        .parquet(store)
    )
    return seen.get["documents"]


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Stored documents; filters on sha256, prefix and qid reach the scan."""
    return spark.read.schema("sha256 string, kind string, qid string, document string, prefix string").parquet(store)
