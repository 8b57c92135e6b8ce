"""Serving tables, dataset fingerprint, publication and its gates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions import ids
from lapidary.functions.text import strip_whitespace
from lapidary.operators import violations as v
from lapidary.plans import checks, search
from lapidary.session import reused
from lapidary.sources import access, commits

SERVING_THINKERS, SERVING_QUOTES, METADATA_TEXTS = fixed.SERVING_THINKERS, fixed.SERVING_QUOTES, fixed.METADATA_TEXTS
#: Most rows of a published file, which bounds its filter.
FILE_ROWS = 1_000_000
_HEX_16 = r"^[0-9a-f]{16}\z"
_HEX_64 = r"^[0-9a-f]{64}\z"


class PublicationBlocked(RuntimeError):
    """A gate found violations; the published dataset is as it was."""


class DatasetUnavailable(RuntimeError):
    """No valid published dataset."""


def _time_text(column: str):
    """A time as text in UTC, whatever the session's time zone."""
    micros = F.unix_micros(column)
    days = F.floor(micros / 86_400_000_000)
    rest = micros - days * 86_400_000_000
    parts = [(rest / 3_600_000_000, 2, ":"), (rest / 60_000_000 % 60, 2, ":"), (rest / 1_000_000 % 60, 2, "."), (rest % 1_000_000, 6, "Z")]
    clock = [x for value, width, after in parts for x in (F.lpad(F.floor(value).cast("string"), width, "0"), F.lit(after))]
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string"), F.lit(" "), *clock)


def serving_thinkers(thinkers: DataFrame) -> DataFrame:
    return thinkers.withColumn("fetched_at", _time_text("fetched_at")).select(*SERVING_THINKERS)


def serving_quotes(gold: DataFrame) -> DataFrame:
    return gold.withColumns(
        {
            "quality_reasons": F.to_json("quality_reasons"),
            "is_daily_eligible": F.col("is_daily_eligible").cast("int"),
        }
    ).select(*SERVING_QUOTES)


def dataset_version(thinkers: DataFrame, quotes: DataFrame) -> DataFrame:
    """Digest of all serving fields but the fetch time, as one row; row order does not matter."""
    named = [F.col(c) for c in SERVING_THINKERS if c != "fetched_at"]
    served = [F.col(c) for c in SERVING_QUOTES]
    digests = thinkers.select(ids.row_digest("thinker", named).alias("digest")).unionByName(
        quotes.select(ids.row_digest("quote", served).alias("digest"))
    )
    sums = digests.agg(*ids.digest_sums(F.col("digest")))
    return sums.select(
        F.left(ids.digest_of_sums(f"schema:{fixed.SERVING_SCHEMA_VERSION}"), F.lit(16)).alias("dataset_version")
    )


REQUIRED = [c for c in SERVING_QUOTES if c not in fixed.SERVING_NULLABLE]


def row_metrics(columns: list[str], flag: bool = False) -> list[Column]:
    """Figures that one pass over the rows gives: rows, nulls of each column, daily flags that are neither 0 nor 1."""
    counted = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"not null: {c}") for c in columns]]
    return [*counted, F.count_if(~F.col("is_daily_eligible").isin(0, 1)).alias("daily flag")] if flag else counted


def key_constraints(thinkers: DataFrame, quotes: DataFrame) -> DataFrame:
    """Violations of keys and references; only key columns are read."""

    def counted(label: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(label).alias("constraint"), "violations")

    return (
        counted("thinkers primary key", v.repeated_keys(thinkers, ["thinker_qid"]))
        .unionByName(counted("quotes primary key", v.repeated_keys(quotes, ["occurrence_id"])))
        .unionByName(counted("quotes reference thinkers", v.orphans(quotes, "thinker_qid", thinkers, "thinker_qid")))
    )


def serving_constraints(thinkers: DataFrame, quotes: DataFrame) -> DataFrame:
    """Violations of the serving tables' keys, references, required columns and value checks.

    The quotes are read once: what the checks need of a row, its keys, flag and whether the other columns are null, is
    kept for all of them.
    """
    keys = ["occurrence_id", "thinker_qid", "is_daily_eligible"]
    filled = [F.when(F.col(c).isNotNull(), True).alias(c) for c in REQUIRED if c not in keys]
    quotes = reused(quotes.select(*keys, *filled))

    def counted(label: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(label).alias("constraint"), "violations")

    frames = [
        v.null_counts(thinkers, SERVING_THINKERS).select(
            F.concat(F.lit("thinkers not null: "), "column_name").alias("constraint"), "violations"
        ),
        v.null_counts(quotes, REQUIRED).select(
            F.concat(F.lit("quotes not null: "), "column_name").alias("constraint"), "violations"
        ),
        key_constraints(thinkers, quotes),
        counted("quotes daily flag", quotes.filter(~F.col("is_daily_eligible").isin(0, 1))),
    ]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def metadata_problems(metadata: DataFrame, key: str) -> DataFrame:
    """First problem of each dataset's build metadata; valid datasets are absent."""
    columns = ["schema_version", *METADATA_TEXTS]
    per_dataset = metadata.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.any_value(c).alias(c) for c in columns]
    )
    blank = F.lit(False)
    for name in METADATA_TEXTS:
        blank = blank | (F.coalesce(strip_whitespace(F.col(name)), F.lit("")) == "")
    problem = (
        F.when(F.col("_rows") != 1, "row_count")
        .when(~F.col("schema_version").eqNullSafe(F.lit(fixed.SERVING_SCHEMA_VERSION)), "schema_version")
        .when(blank, "incomplete_provenance")
        .when(~F.col("dataset_version").rlike(_HEX_16), "dataset_version")
        .when(~F.col("manifest_sha256").rlike(_HEX_64), "manifest_sha256")
    )
    return per_dataset.select(key, problem.alias("problem")).filter("problem is not null")


def gate_violations(
    gold: DataFrame,
    thinkers: DataFrame,
    expected: DataFrame,
    provenance: DataFrame,
    daily: int = fixed.DAILY_QUOTES_PER_THINKER,
) -> DataFrame:
    """All gates in one table: (gate, detail), empty when publication may go on."""
    none_eligible = gold.agg(F.count_if("is_daily_eligible").alias("n")).filter("n < 1")
    no_provenance = provenance.agg(F.count(F.lit(1)).alias("n")).filter("n < 1")
    wrong = checks.wrong_daily_counts(gold, thinkers, daily)

    def gate(df: DataFrame, label: str, detail) -> DataFrame:
        return df.select(F.lit(label).alias("gate"), detail.alias("detail"))

    return (
        gate(checks.missing_thinkers(expected, thinkers), "missing_thinker", F.col("thinker_name"))
        .unionByName(gate(none_eligible, "no_eligible_quote", F.lit("")))
        .unionByName(
            gate(
                checks.thinkers_without_eligible(expected, gold, thinkers),
                "thinker_without_eligible",
                F.col("thinker_name"),
            )
        )
        .unionByName(
            gate(
                wrong,
                "daily_count",
                F.concat(F.coalesce("thinker_name", F.lit("")), F.lit(" ("), F.col("quote_count"), F.lit(")")),
            )
        )
        .unionByName(gate(no_provenance, "no_provenance", F.lit("")))
    )


def count_comparison(name: str, source: DataFrame, served: DataFrame) -> DataFrame:
    """Rows of a table and of its serving form, as (relation, source_rows, served_rows)."""
    rows = source.select(F.lit(0).alias("served")).unionByName(served.select(F.lit(1).alias("served")))
    return rows.agg(
        F.lit(name).alias("relation"),
        F.count_if(F.col("served") == 0).alias("source_rows"),
        F.count_if(F.col("served") == 1).alias("served_rows"),
    )


def provenance_rows(summary: DataFrame, source_commit: str = "local") -> DataFrame:
    """Provenance of the complete runs of a manifest summary whose digest is a lower-case hexadecimal SHA-256."""
    good = summary.filter((F.col("status") == "complete") & F.col("manifest_sha256").rlike(_HEX_64))
    return good.select(
        "run_id",
        "manifest_sha256",
        F.lit(fixed.PIPELINE_VERSION).alias("pipeline_version"),
        F.lit(fixed.PARSER_VERSION).alias("parser_version"),
        F.lit(source_commit.strip() or "local").alias("source_commit"),
    )


def provenance_row(spark: SparkSession, run_id: str, manifest_sha256: str, source_commit: str = "local") -> DataFrame:
    if len(manifest_sha256) != 64 or set(manifest_sha256) - set("0123456789abcdef"):
        raise ValueError("manifest_sha256 must be a lower-case hexadecimal SHA-256")
    commit = source_commit.strip() or "local"
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(manifest_sha256).alias("manifest_sha256"),
        F.lit(fixed.PIPELINE_VERSION).alias("pipeline_version"),
        F.lit(fixed.PARSER_VERSION).alias("parser_version"),
        F.lit(commit).alias("source_commit"),
    )


def publish(
    gold: DataFrame,
    thinkers: DataFrame,
    provenance: DataFrame,
    expected: DataFrame,
    target: str,
    daily: int = fixed.DAILY_QUOTES_PER_THINKER,
    after: int | None = None,
) -> str:
    """Write a validated version under ``target`` and point readers to it; returns the version.

    The version goes to a folder of its own. Readers follow the newest commit of the log, which is made after all
    gates have passed, so a failure at any earlier step leaves the published data as it was. The commit follows number
    ``after``, the newest one when the call began; if another publisher has made the next one meanwhile, this call
    raises ``CommitConflict``. Rows, nulls and flags are observed while the tables are written; only the keys of what
    was written are read again.
    """
    spark = gold.sparkSession
    after = commits.newest(spark, f"{target}/commits") if after is None else after
    gates = gate_violations(gold, thinkers, expected, provenance, daily)
    shown = gates.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.min("detail").alias("example")).collect()
    if shown:
        found = "; ".join(f"{row.gate}: {row.n} (such as {row.example!r})" for row in sorted(shown))
        raise PublicationBlocked(f"publication blocked: {found}")

    served_thinkers, served_quotes = serving_thinkers(thinkers), serving_quotes(gold)
    version = dataset_version(served_thinkers, served_quotes).first().dataset_version
    built = provenance.first()
    folder = f"{target}/versions/{version}/{built.run_id}-{uuid.uuid4().hex}"

    of_thinkers, of_quotes = Observation(), Observation()
    (
        served_thinkers.orderBy("thinker_name")
        .observe(of_thinkers, *row_metrics(SERVING_THINKERS))
        .write.option("compression", "zstd")
        .parquet(f"{folder}/thinkers")
    )
    # A range over both columns splits the rows of a thinker who has most of them.
    (
        served_quotes.repartitionByRange("thinker_qid", "occurrence_id")
        .sortWithinPartitions("is_daily_eligible", "thinker_qid", "occurrence_id")
        .observe(of_quotes, *row_metrics(REQUIRED, flag=True))
        .write.partitionBy("is_daily_eligible")
        .option("maxRecordsPerFile", FILE_ROWS)
        .option("compression", "zstd")
        .parquet(f"{folder}/quotes")
    )
    (
        served_quotes.select("quote_id", "occurrence_id", "thinker_qid")
        .repartitionByRange("quote_id", "occurrence_id")
        .sortWithinPartitions("quote_id", "occurrence_id")
        .write.option("compression", "zstd")
        .parquet(f"{folder}/quote_index")
    )
    search.write_index(search.posting_blocks(served_quotes, "occurrence_id", "quote_text"), f"{folder}/tokens")

    written_thinkers = spark.read.parquet(f"{folder}/thinkers")
    written_quotes = spark.read.parquet(f"{folder}/quotes")
    # The count of the parts comes from file footers.
    if not written_quotes.count() == of_quotes.get["rows"] == gold.count():
        raise PublicationBlocked("publication blocked: row counts differ")
    seen = {f"thinkers {k}": n for k, n in of_thinkers.get.items()} | {f"quotes {k}": n for k, n in of_quotes.get.items()}
    broken = [(name, n) for name, n in seen.items() if n and not name.endswith(" rows")]
    broken += [(row.constraint, row.violations) for row in key_constraints(written_thinkers, written_quotes).filter("violations > 0").collect()]
    if broken:
        raise PublicationBlocked(f"publication blocked: {broken}")
    statistics = access.file_statistics(written_quotes, "quote_id")
    statistics.withColumn("file", F.regexp_extract("file", "/(is_daily_eligible=[^/]*/[^/]*)$", 1)).write.parquet(f"{folder}/quote_files")

    newest = thinkers.agg(F.max("fetched_at").alias("fetched_at"))
    metadata = newest.select(
        F.lit(fixed.SERVING_SCHEMA_VERSION).alias("schema_version"),
        F.lit(version).alias("dataset_version"),
        _time_text("fetched_at").alias("source_fetched_at"),
        *[
            F.lit(built[c]).alias(c)
            for c in ("pipeline_version", "parser_version", "run_id", "manifest_sha256", "source_commit")
        ],
    )
    metadata.write.parquet(f"{folder}/build_metadata")
    commits.commit(spark, f"{target}/commits", after + 1, {"dataset_version": version, "folder": folder})
    return version


def current_folder(spark: SparkSession, target: str) -> str:
    newest = commits.newest(spark, f"{target}/commits")
    if not newest:
        raise DatasetUnavailable("no published dataset")
    return commits.read(spark, f"{target}/commits", newest)["folder"]


def quotes_of(spark: SparkSession, target: str, quote_id: str) -> DataFrame:
    """Published rows of one quote; only files that may hold it are opened."""
    folder = current_folder(spark, target)
    quotes = spark.read.parquet(f"{folder}/quotes")
    statistics = spark.read.parquet(f"{folder}/quote_files")
    whole = statistics.withColumn("file", F.concat(F.lit(f"{folder}/quotes/"), "file"))
    return access.look_up(quotes, whole, "quote_id", quote_id, f"{folder}/quotes")


def read_current(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """Tables of the current version, refused when its metadata is not valid."""
    folder = current_folder(spark, target)
    names = ("build_metadata", "thinkers", "quotes", "quote_index", "tokens")
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    metadata = tables["build_metadata"]
    problem = metadata_problems(metadata.withColumn("folder", F.lit(folder)), "folder").first()
    if problem is not None:
        raise DatasetUnavailable(f"published metadata is not valid: {problem.problem}")
    if metadata.first() is None:
        raise DatasetUnavailable("published metadata is not valid: row_count")
    return tables
