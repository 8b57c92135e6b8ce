"""The stages of a build, each callable alone over tables on shared storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.plans import checks, extraction, gold, publication, reports, silver
from lapidary.sources import pages as page_source
from lapidary.sources import snapshots, tables


class SourceFailed(RuntimeError):
    """At least one source failed; nothing was loaded."""


class ChecksFailed(RuntimeError):
    """Data tests found violations."""


@dataclass(frozen=True)
class Catalogue:
    """Collection members: (slug, title, description, thinker_name)."""

    members: DataFrame

    @classmethod
    def default(cls, spark: SparkSession) -> Catalogue:
        rows = [(slug, title, text, name) for slug, title, text, names in fixed.COLLECTIONS for name in names]
        return cls(spark.createDataFrame(rows, "slug string, title string, description string, thinker_name string"))

    def names(self) -> DataFrame:
        return self.members.select("thinker_name").distinct()


def default_names() -> list[str]:
    """Names of the default catalogue, each at its first mention."""
    return list(dict.fromkeys(name for *_, names in fixed.COLLECTIONS for name in names))


def ingest(
    fetched: DataFrame,
    run_dir: str,
    run_id: str,
    reviewed: DataFrame,
    rules: page_source.PageRules = page_source.PageRules(),
    source_commit: str = "local",
) -> str:
    """Store the snapshots of a run, then its bronze tables; returns the manifest digest.

    The run folder must be new. The manifest is written in either case, bronze
    only when every source succeeded. Provenance belongs to the run, so none is
    left over from an earlier load.
    """
    spark = fetched.sparkSession
    snapshots.source_records(fetched).write.mode("errorifexists").option("compression", "zstd").parquet(
        f"{run_dir}/raw"
    )
    records = spark.read.parquet(f"{run_dir}/raw")
    manifest = snapshots.manifest(records, run_id)
    manifest.write.mode("errorifexists").parquet(f"{run_dir}/manifest")
    summary = snapshots.manifest_summary(spark.read.parquet(f"{run_dir}/manifest"))
    summary.write.mode("errorifexists").parquet(f"{run_dir}/manifest_summary")
    result = spark.read.parquet(f"{run_dir}/manifest_summary").first()
    if result is None or result.status != "complete":
        raise SourceFailed(f"sources failed ({result.error if result else 'none given'}); bronze was not loaded")
    pages = snapshots.pages_of(records)
    tables.write_bronze(extraction.extract_quotes(pages, rules), run_dir, "quotes")
    tables.write_bronze(reviewed, run_dir, "supplemental_quotes")
    tables.write_bronze(extraction.thinker_rows(pages), run_dir, "thinkers")
    publication.provenance_row(spark, run_id, result.manifest_sha256, source_commit).write.parquet(
        f"{run_dir}/provenance"
    )
    return result.manifest_sha256


def transform(
    spark: SparkSession,
    run_dir: str,
    warehouse: str,
    selection: DataFrame,
    queue: DataFrame,
    daily: int = fixed.DAILY_QUOTES_PER_THINKER,
    validate_queue: bool = True,
    queue_expected: int = 2,
    queue_exempt: tuple[str, ...] = fixed.QUEUE_EXEMPT,
) -> dict[str, DataFrame]:
    """Silver and gold tables from bronze, then the data tests on what was written.

    Silver is written before gold reads it, so the text work runs once and a
    lost executor repeats no more than one stage.
    """

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{warehouse}/{name}")
        return spark.read.parquet(f"{warehouse}/{name}")

    quotes = tables.read_bronze(spark, run_dir, "quotes")
    reviewed = tables.read_bronze(spark, run_dir, "supplemental_quotes")
    thinkers = tables.read_bronze(spark, run_dir, "thinkers")
    out = {
        "stg_quotes": stored(silver.normalise_quotes(quotes, reviewed), "stg_quotes"),
        "dim_thinkers": stored(silver.dim_thinkers(thinkers), "dim_thinkers"),
    }
    out["fct_quotes"] = stored(gold.curate(out["stg_quotes"], selection), "fct_quotes")
    out["editorial_review_queue"] = stored(gold.review_queue(queue, out["fct_quotes"]), "editorial_review_queue")
    failures = failed_checks(
        {**out, "daily_quote_selection": selection, "quote_review_queue": queue},
        daily,
        validate_queue,
        queue_expected,
        queue_exempt,
    ).collect()
    if failures:
        raise ChecksFailed("; ".join(f"{row.check}: {row.violations}" for row in failures))
    return out


def failed_checks(
    relations: dict[str, DataFrame],
    daily: int = fixed.DAILY_QUOTES_PER_THINKER,
    validate_queue: bool = True,
    queue_expected: int = 2,
    queue_exempt: tuple[str, ...] = fixed.QUEUE_EXEMPT,
) -> DataFrame:
    """All data tests as (check, violations); only failing ones are listed."""
    stg, fct = relations["stg_quotes"], relations["fct_quotes"]
    dim, queue = relations["dim_thinkers"], relations["quote_review_queue"]

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")

    nulls = checks.not_null(relations)
    results = [
        nulls.select(F.concat_ws(" ", F.lit("not_null"), "relation", "column_name").alias("check"), "violations"),
        checks.row_level_summary(fct),
        counted("unique", checks.unique(relations)),
        counted("accepted_values", checks.accepted_values(relations)),
        counted("relationships", checks.relationships(relations)),
        counted("supplemental_does_not_repeat", checks.supplemental_repeats(stg)),
        counted("daily_quote_count_per_thinker", checks.daily_counts(fct, dim, daily)),
        counted("review_queue_candidates_exist", checks.queue_missing(queue, fct, validate_queue)),
        counted("review_queue_excludes_daily_quotes", checks.queue_already_approved(queue, fct, validate_queue)),
        counted("review_queue_excludes_hard_failures", checks.queue_hard_failures(queue, fct, validate_queue)),
        counted(
            "review_queue_has_expected_balance",
            checks.queue_balance(queue, dim, queue_expected, queue_exempt, validate_queue),
        ),
    ]
    stacked = results[0]
    for result in results[1:]:
        stacked = stacked.unionByName(result)
    return stacked.filter("violations > 0")


def publish(
    spark: SparkSession,
    run_dir: str,
    warehouse: str,
    target: str,
    expected: DataFrame,
    daily: int = fixed.DAILY_QUOTES_PER_THINKER,
) -> str:
    fct, dim = (spark.read.parquet(f"{warehouse}/{name}") for name in ("fct_quotes", "dim_thinkers"))
    provenance = spark.read.parquet(f"{run_dir}/provenance")
    return publication.publish(fct, dim, provenance, expected, target, daily)


def audit(spark: SparkSession, warehouse: str) -> dict[str, DataFrame]:
    fct = spark.read.parquet(f"{warehouse}/fct_quotes")
    return {
        "metrics": reports.audit_metrics(fct),
        "reasons": reports.reason_counts(fct),
        "suspects": reports.top_suspects(fct),
    }


def run(
    fetched: DataFrame,
    reviewed: DataFrame,
    selection: DataFrame,
    queue: DataFrame,
    catalogue: Catalogue,
    root: str,
    run_id: str,
    **options,
) -> dict[str, DataFrame]:
    """All stages of a build under one root folder; returns the audit."""
    spark = fetched.sparkSession
    run_dir, warehouse = f"{root}/bronze/{run_id}", f"{root}/warehouse/{run_id}"
    ingest(fetched, run_dir, run_id, reviewed)
    transform(spark, run_dir, warehouse, selection, queue, **options)
    daily = options.get("daily", fixed.DAILY_QUOTES_PER_THINKER)
    publish(spark, run_dir, warehouse, f"{root}/published", catalogue.names(), daily)
    return audit(spark, warehouse)

