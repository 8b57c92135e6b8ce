"""Registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import adapters as given
from lapidary import fixed
from lapidary.functions import ids, text
from lapidary.functions.dates import partial_date
from lapidary.operators import picks
from lapidary.operators import violations as v
from lapidary.operators.latest import first_mentions
from lapidary.plans import build, checks, extraction, profiles, publication, reports, search, selection, silver, versions
from lapidary.plans import gold as gold_plan
from lapidary.sources import entities, merge, snapshots, supplemental
from lapidary.sources import pages as page_source
from lapidary.session import new_folder, reused

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.normalise_quotes(given.bronze_quotes(spark, sf_dir), given.bronze_supplemental(spark, sf_dir))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_plan.curate(_silver(spark, sf_dir), given.allowlist(spark, sf_dir))


def _dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.dim_thinkers(given.bronze_thinkers(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    """Times as epoch seconds and reason lists as text, so that both engines print them alike."""
    if "fetched_at" in df.columns:
        df = df.withColumn("fetched_at", F.unix_seconds("fetched_at"))
    if "quality_reasons" in df.columns:
        df = df.withColumn("quality_reasons", F.array_join("quality_reasons", ","))
    return df


@query
def union_sources(spark, sf_dir):
    rows = silver.union_sources(given.bronze_quotes(spark, sf_dir), given.bronze_supplemental(spark, sf_dir))
    return rows.groupBy("source_kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("text_length")
    )


@query
def silver_quotes(spark, sf_dir):
    return _flat(_silver(spark, sf_dir))


@query
def dim_thinkers(spark, sf_dir):
    return _flat(_dim(spark, sf_dir))


@query
def gold_quotes(spark, sf_dir):
    return _flat(_gold(spark, sf_dir))


@query
def review_queue(spark, sf_dir):
    return _flat(gold_plan.review_queue(given.queue(spark, sf_dir), _gold(spark, sf_dir)))


@query
def audit_metrics(spark, sf_dir):
    return reports.audit_metrics(_gold(spark, sf_dir))


@query
def reason_counts(spark, sf_dir):
    return reports.reason_counts(_gold(spark, sf_dir))


@query
def top_suspects(spark, sf_dir):
    return reports.top_suspects(_gold(spark, sf_dir))


@query
def collection_coverage(spark, sf_dir):
    rows = reports.collection_coverage(_gold(spark, sf_dir), _dim(spark, sf_dir), given.members(spark, sf_dir))
    return rows.withColumn("uncovered", F.array_join("uncovered", ","))


@query
def collection_texts(spark, sf_dir):
    gold = _gold(spark, sf_dir).select("thinker_qid", "is_daily_eligible", "quote_text")
    return reports.collection_texts(gold, _dim(spark, sf_dir), given.members(spark, sf_dir))


@query
def collection_audit(spark, sf_dir):
    gold = reused(reports.audit_rows(_gold(spark, sf_dir)))
    return reports.collection_audit(gold, _dim(spark, sf_dir), given.members(spark, sf_dir))


#: Columns of gold that no column test reads.
TEXT_COLUMNS = ("quote_text", "original_text", "work", "source_url", "translator_name", "translation_url", "fetched_at")
#: Columns of gold that no uniqueness test and no choice of the newest occurrence of a queued quote reads.
NO_KEYS = (
    *TEXT_COLUMNS, "thinker_name", "original_language", "category", "source_name", "source_license", "translation_license",
    "source_kind", "character_count", "curation_status", "quality_reason", "quality_reasons", "citation_only", "attributed",
    "leading_fragment", "attribution_section", "very_short", "very_long", "passes_automatic_rules", "is_daily_eligible",
)


def _relations(
    spark: SparkSession, sf_dir: str, unread: Sequence[str] = TEXT_COLUMNS, quotes: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All relations. Gold holds a row for each silver row, so silver is read from it; columns that no test reads are null."""
    # Each relation is read by several tests.
    allowed, queue, dim = reused(given.allowlist(spark, sf_dir)), reused(given.queue(spark, sf_dir)), reused(_dim(spark, sf_dir))
    gold = gold_plan.curate(_silver(spark, sf_dir) if quotes is None else quotes, allowed)
    gold = reused(gold.withColumns({c: F.lit(None).cast(gold.schema[c].dataType) for c in unread}))
    return {
        "stg_quotes": gold,
        "dim_thinkers": dim,
        "fct_quotes": gold,
        "editorial_review_queue": reused(gold_plan.review_queue(queue, gold)),
        "daily_quote_selection": allowed,
        "quote_review_queue": queue,
    }


@query
def not_null_violations(spark, sf_dir):
    return checks.not_null(_relations(spark, sf_dir))


@query
def unique_violations(spark, sf_dir):
    """Uniqueness before and after deduplication: bronze occurrences repeat, silver ones do not."""
    # The rows are cleaned and identified once, for both.
    identified = reused(silver.identify(silver.union_sources(given.bronze_quotes(spark, sf_dir), given.bronze_supplemental(spark, sf_dir))))
    bronze = v.repeated_keys(identified, ["occurrence_id"]).withColumnRenamed("occurrence_id", "key")
    tables = _relations(spark, sf_dir, NO_KEYS, silver.latest_quotes(identified))
    return checks.unique(tables).unionByName(
        bronze.select(F.lit("bronze").alias("relation"), "key", "occurrences")
    )


@query
def accepted_values_violations(spark, sf_dir):
    return checks.accepted_values(_relations(spark, sf_dir))


@query
def relationship_violations(spark, sf_dir):
    gold, queue = _gold(spark, sf_dir).select("thinker_qid", "quote_id"), given.queue(spark, sf_dir)
    # One row of the review queue for each queued quote that gold holds.
    entries = queue.select("thinker_qid", "quote_id").join(gold.distinct(), ["thinker_qid", "quote_id"]).dropDuplicates(["quote_id"])
    tables = {"fct_quotes": gold, "editorial_review_queue": entries, "dim_thinkers": _dim(spark, sf_dir)}
    return checks.relationships(tables)


@query
def row_rule_violations(spark, sf_dir):
    return checks.row_level_summary(_gold(spark, sf_dir))


@query
def translation_provenance_violations(spark, sf_dir):
    return _flat(checks.translation_provenance(_silver(spark, sf_dir)))


@query
def source_artifact_violations(spark, sf_dir):
    return checks.source_artifacts(_silver(spark, sf_dir))


def _wrongly_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold with approved rows made eligible against the rules, so that the checks have something to find."""
    return _gold(spark, sf_dir).withColumn("is_daily_eligible", F.col("editorial_approved"))


@query
def citation_only_daily_violations(spark, sf_dir):
    return checks.citation_only_daily(_wrongly_eligible(spark, sf_dir))


@query
def attribution_section_daily_violations(spark, sf_dir):
    return checks.attribution_section_daily(_wrongly_eligible(spark, sf_dir))


@query
def gates_without_eligible(spark, sf_dir):
    """The publication gates on gold without an eligible row and without provenance."""
    none = reused(_gold(spark, sf_dir).select("thinker_qid", F.lit(False).alias("is_daily_eligible")))
    provenance = spark.createDataFrame([], "run_id string")
    return publication.gate_violations(none, _dim(spark, sf_dir), _expected(spark, sf_dir), provenance)


@query
def publication_counts(spark, sf_dir):
    """Row counts of gold and serving tables, equal in a complete publication."""
    gold, dim = _gold(spark, sf_dir), _dim(spark, sf_dir)
    pairs = {"quotes": (gold, publication.serving_quotes(gold)), "thinkers": (dim, publication.serving_thinkers(dim))}
    frames = [publication.count_comparison(name, *pair) for name, pair in pairs.items()]
    return frames[0].unionByName(frames[1])


@query
def provenance_rows(spark, sf_dir):
    """Provenance of a run that holds the fetched pages without a failure."""
    records = snapshots.source_records(given.fetched_pages(spark, sf_dir)).filter("status = 'success'")
    return publication.provenance_rows(snapshots.manifest_summary(snapshots.manifest(records, "run")), "local")


@query
def queue_checks_switched(spark, sf_dir):
    """Entries that each queue check finds, switched on and off."""
    gold, dim, queue = reused(_gold(spark, sf_dir).drop(*TEXT_COLUMNS)), _dim(spark, sf_dir), given.queue(spark, sf_dir)
    frames = []
    for enabled in (True, False):
        found = {
            "missing": checks.queue_missing(queue, gold, enabled),
            "approved": checks.queue_already_approved(queue, gold, enabled),
            "hard": checks.queue_hard_failures(queue, gold, enabled),
            "balance": checks.queue_balance(queue, dim, 14, ("src7",), enabled),
        }
        frames += [
            rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), F.lit(enabled).alias("enabled"), "violations")
            for name, rows in found.items()
        ]
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


@query
def supplemental_repeats(spark, sf_dir):
    return checks.supplemental_repeats(_silver(spark, sf_dir))


@query
def daily_count_violations(spark, sf_dir):
    return checks.daily_counts(_gold(spark, sf_dir), _dim(spark, sf_dir))


@query
def queue_missing(spark, sf_dir):
    return checks.queue_missing(given.queue(spark, sf_dir), _gold(spark, sf_dir))


@query
def queue_already_approved(spark, sf_dir):
    return checks.queue_already_approved(given.queue(spark, sf_dir), _gold(spark, sf_dir))


@query
def queue_hard_failures(spark, sf_dir):
    return checks.queue_hard_failures(given.queue(spark, sf_dir), _gold(spark, sf_dir))


@query
def queue_balance(spark, sf_dir):
    return checks.queue_balance(given.queue(spark, sf_dir), _dim(spark, sf_dir), expected=14, exempt=("src7",))


@query
def failed_checks(spark, sf_dir):
    return build.failed_checks(_relations(spark, sf_dir, unread=("work", "source_url", "fetched_at")), queue_expected=14, queue_exempt=("src7",))


@query
def catalogue_names(spark, sf_dir):
    return first_mentions(given.member_list(spark, sf_dir), "thinker_name", "position")


@query
def request_seeds(spark, sf_dir):
    key = ids.selection_key(F.col("on_date"), F.col("thinker"), F.col("collection"))
    place = ids.seeded_index(ids.seed(key), F.col("request_id") + 1)
    return given.requests(spark, sf_dir).select("request_id", place.alias("place"))


@query
def entity_labels(spark, sf_dir):
    return profiles.chosen_texts(given.labels(spark, sf_dir))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.members(spark, sf_dir).select("thinker_name").distinct()


@query
def missing_thinkers(spark, sf_dir):
    return checks.missing_thinkers(_expected(spark, sf_dir), _dim(spark, sf_dir))


@query
def thinkers_without_eligible(spark, sf_dir):
    return checks.thinkers_without_eligible(_expected(spark, sf_dir), _gold(spark, sf_dir), _dim(spark, sf_dir))


@query
def wrong_daily_counts(spark, sf_dir):
    return checks.wrong_daily_counts(_gold(spark, sf_dir), _dim(spark, sf_dir))


@query
def publication_gates(spark, sf_dir):
    gold = reused(_gold(spark, sf_dir).select("thinker_qid", "is_daily_eligible"))
    dim = _dim(spark, sf_dir)
    provenance = snapshots.manifest_summary(
        snapshots.manifest(snapshots.source_records(given.fetched_pages(spark, sf_dir)), "run")
    ).filter("status = 'complete'")
    return publication.gate_violations(gold, dim, _expected(spark, sf_dir), provenance)


@query
def serving_quotes(spark, sf_dir):
    return publication.serving_quotes(_gold(spark, sf_dir))


@query
def serving_thinkers(spark, sf_dir):
    return publication.serving_thinkers(_dim(spark, sf_dir))


@query
def serving_constraints(spark, sf_dir):
    return publication.serving_constraints(
        publication.serving_thinkers(_dim(spark, sf_dir)), publication.serving_quotes(_gold(spark, sf_dir))
    )


@query
def dataset_version(spark, sf_dir):
    return publication.dataset_version(
        publication.serving_thinkers(_dim(spark, sf_dir)), publication.serving_quotes(_gold(spark, sf_dir))
    )


@query
def version_difference(spark, sf_dir):
    """Silver against a later version in which some rows are gone, some have another category and some are new."""
    fields = ["occurrence_id", "quote_id", "category", "character_count"]
    old = reused(_silver(spark, sf_dir).select(fields).filter("occurrence_id is not null"))
    mark = F.substring("occurrence_id", 1, 2)
    category = F.when(mark == "b2", F.upper("category")).otherwise(F.col("category"))
    kept = old.filter(mark != "a1").withColumn("category", category)
    new = kept.unionByName(old.filter(mark == "c3").withColumn("occurrence_id", F.sha2("occurrence_id", 256)))
    return versions.version_difference(old, reused(new), "occurrence_id", fields)


@query
def merged_silver(spark, sf_dir):
    """Silver merged from two snapshots: the scraped rows, then the reviewed ones; equal to a build of both."""
    target = new_folder(spark, "merged")
    quotes, reviewed = given.bronze_quotes(spark, sf_dir), given.bronze_supplemental(spark, sf_dir)
    for sources in ((quotes, reviewed.limit(0)), (quotes.limit(0), reviewed)):
        silver.merge_quotes(*sources, target)
    return _flat(merge.read_merged(spark, target))


@query
def metadata_problems(spark, sf_dir):
    return publication.metadata_problems(given.metadata_candidates(spark, sf_dir), "dataset")


@query
def quote_pages(spark, sf_dir):
    rows = reused(_gold(spark, sf_dir).select("thinker_qid", "occurrence_id", "quote_text", "category"))
    return picks.page_of(rows, ["thinker_qid"], "occurrence_id", offset=25, limit=10)


@query
def quote_page_figures(spark, sf_dir):
    """A row for each thinker, empty pages included."""
    counts = _gold(spark, sf_dir).groupBy("thinker_qid").agg(F.count(F.lit(1)).alias("n"))
    thinkers = _dim(spark, sf_dir).select("thinker_qid").join(counts, "thinker_qid", "left")
    return picks.page_figures(thinkers.select("thinker_qid", F.coalesce("n", F.lit(0)).alias("total")), offset=25, limit=10)


def _section_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    carried = extraction.carry_sections(given.section_blocks(spark, sf_dir), ["doc_id"], "line_no")
    items = carried.filter(~F.col("is_heading")).withColumnRenamed("text", "item").drop("is_heading")
    return extraction.classify_items(items)


@query
def source_order_pages(spark, sf_dir):
    quotes = _section_quotes(spark, sf_dir).drop("work")
    return picks.page_in_order(quotes, ["doc_id"], "line_no", offset=2, limit=3)


@query
def quote_samples(spark, sf_dir):
    rows = _silver(spark, sf_dir).select("thinker_qid", "source_revision", "occurrence_id", "quote_text")
    return profiles.quote_samples(rows, "thinker_qid", ["source_revision", "occurrence_id"], n=10)


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reused(_gold(spark, sf_dir).filter("is_daily_eligible").select(selection.READ_COLUMNS))


@query
def daily_selection(spark, sf_dir):
    return selection.daily_selection(
        given.requests(spark, sf_dir),
        _eligible(spark, sf_dir),
        _dim(spark, sf_dir),
        reused(given.members(spark, sf_dir)),
        given.DATASET_VERSION,
    )


@query
def collection_samples(spark, sf_dir):
    members = reused(given.members(spark, sf_dir))
    slugs = members.select("slug").distinct()
    return selection.collection_samples(
        slugs,
        "2026-07-13",
        _eligible(spark, sf_dir),
        _dim(spark, sf_dir),
        members,
        given.DATASET_VERSION,
    ).drop("max_length")


@query
def two_stage_selection(spark, sf_dir):
    shown = [c for c in fixed.SELECTION_FIELDS if c not in ("quote_text", "original_text")]
    quotes = reused(_silver(spark, sf_dir).select("character_count", *shown))
    return selection.two_stage_selection(
        given.requests(spark, sf_dir), quotes, reused(given.members(spark, sf_dir)), shown=shown
    )


@query
def supplemental_errors(spark, sf_dir):
    rows = supplemental.validate(given.raw_supplemental(spark, sf_dir), _expected(spark, sf_dir))
    bad = rows.filter(F.size("errors") > 0)
    return bad.select("source_file", "line_number", F.array_join("errors", ",").alias("errors"))


@query
def supplemental_first_error(spark, sf_dir):
    return supplemental.first_error(
        supplemental.validate(given.raw_supplemental(spark, sf_dir), _expected(spark, sf_dir))
    )


@query
def supplemental_rows(spark, sf_dir):
    rows = supplemental.typed(
        supplemental.validate(given.raw_supplemental(spark, sf_dir), _expected(spark, sf_dir))
    )
    return rows.withColumn("reviewed_at", F.unix_seconds("reviewed_at"))


@query
def source_records(spark, sf_dir):
    records = snapshots.source_records(given.fetched_pages(spark, sf_dir))
    return snapshots.manifest(records, "run").withColumn("fetched_at", F.unix_seconds("fetched_at"))


@query
def manifest_summary(spark, sf_dir):
    records = snapshots.source_records(given.fetched_pages(spark, sf_dir))
    return snapshots.manifest_summary(snapshots.manifest(records, "run"))


@query
def snapshot_pages(spark, sf_dir):
    pages = snapshots.pages_of(snapshots.source_records(given.fetched_pages(spark, sf_dir)))
    return pages.withColumn("fetched_at", F.unix_seconds("fetched_at"))


@query
def section_quotes(spark, sf_dir):
    return _section_quotes(spark, sf_dir)


ARTICLE_PAGES = page_source.PageRules(
    root_tag="article", root_class=None, headings=("h1", "h2", "h3", "h4"), list_tag=None, item_tag="p"
)


@query
def html_quotes(spark, sf_dir):
    pages = given.dealt(spark, sf_dir, "pages", "page_id").select(
        F.concat(F.lit("Q"), "page_id").alias("qid"),
        F.concat(F.lit("page "), "page_id").alias("name"),
        F.col("url").alias("title"),
        F.col("page_id").alias("revision"),
        F.col("page_id").alias("fetched_at"),
        "html",
    )
    return extraction.extract_quotes(pages, ARTICLE_PAGES)


@query
def page_urls(spark, sf_dir):
    lines = given.section_blocks(spark, sf_dir).select("doc_id", "line_no", "text")
    return lines.select("doc_id", "line_no", text.page_url(F.col("text"), "").alias("url"))


@query
def comparison_keys(spark, sf_dir):
    lines = given.section_blocks(spark, sf_dir).select("doc_id", "line_no", "text")
    return lines.select("doc_id", "line_no", text.comparison_key(F.col("text")).alias("key"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir).select("occurrence_id", "quote_text").filter("occurrence_id is not null")


@query
def token_frequencies(spark, sf_dir):
    return search.token_frequencies(search.token_index(_texts(spark, sf_dir), "occurrence_id", "quote_text"))


@query
def quote_search(spark, sf_dir):
    wanted = given.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )
    terms = search.query_terms(wanted)
    blocks = search.posting_blocks(_texts(spark, sf_dir), "occurrence_id", "quote_text", only=terms, queries=terms)
    return search.search_index(wanted, blocks, "occurrence_id")


@query
def name_search(spark, sf_dir):
    names = given.names(spark, sf_dir).drop("entity_qid")
    return search.search_names(given.name_queries(spark, sf_dir), names, limit=5)


@query
def name_search_figures(spark, sf_dir):
    names = given.names(spark, sf_dir).drop("entity_qid")
    return search.search_figures(given.name_queries(spark, sf_dir), names, limit=5)


@query
def name_search_partial(spark, sf_dir):
    names = given.names(spark, sf_dir).drop("entity_qid")
    return search.search_names_partial(given.partial_queries(spark, sf_dir), names, limit=5)


@query
def name_resolution(spark, sf_dir):
    names = given.names(spark, sf_dir)
    return search.resolve_names(given.name_queries(spark, sf_dir), names.drop("entity_qid"), names)


@query
def entity_claims(spark, sf_dir):
    return entities.read_claims(given.entity_documents(spark, sf_dir))


@query
def best_claims(spark, sf_dir):
    return profiles.best_claims(given.claims(spark, sf_dir))


@query
def partial_dates(spark, sf_dir):
    dated = given.entity_events(spark, sf_dir).filter("time is not null")
    date = partial_date(F.col("time"), F.col("precision"))
    return dated.select("event_id", date.alias("date")).select("event_id", "date.*")


@query
def referenced_ids(spark, sf_dir):
    return profiles.referenced_ids(given.claims(spark, sf_dir))


@query
def labelled_references(spark, sf_dir):
    return profiles.labelled_references(given.claims(spark, sf_dir), given.labels(spark, sf_dir))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.entity_profiles(
        given.entities(spark, sf_dir),
        given.claims(spark, sf_dir),
        given.labels(spark, sf_dir),
        given.descriptions(spark, sf_dir),
    )


def _joined(column: str, *fields: str):
    """Lists as text, so that both engines print them alike."""
    if not fields:
        return F.array_join(column, ";").alias(column)
    shown = F.transform(column, lambda x: F.concat_ws("=", *[F.coalesce(x[f], F.lit("")) for f in fields]))
    return F.array_join(shown, ";").alias(column)


@query
def entity_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir).select(
        "qid",
        "nome",
        "descricao",
        F.col("nascimento.exibicao").alias("nascimento"),
        F.col("morte.valor").alias("morte"),
        "local_nascimento",
        *[_joined(c) for c in ("nacionalidade", "ocupacoes", "correntes", "formacao")],
        _joined("obras", "titulo", "qid"),
        _joined("fontes", "fonte", "licenca", "url"),
    )


@query
def thinker_profiles(spark, sf_dir):
    documents = given.documents(spark, sf_dir)
    qid = F.concat(F.lit("Q"), "doc_id").alias("qid")
    quotes = given.document_quotes(documents).withColumn("qid", qid)
    # Not a cut of the input: entities of German documents stand for those whose page could not be fetched.
    pages = documents.filter("lang <> 'de'").select(qid)
    rows = profiles.thinker_profiles(_profiles(spark, sf_dir), pages, quotes, ["fetched_at", "text"], sample=3)
    return rows.select(
        "qid", _joined("frases", "texto", "categoria", "obra"), _joined("fontes", "fonte", "url"), "aviso"
    )


@query
def influence_graph(spark, sf_dir):
    edges = profiles.influence_edges(given.claims(spark, sf_dir), given.labels(spark, sf_dir))
    graph = profiles.influence_graph(given.entities(spark, sf_dir), edges)
    return graph.select("qid", "name", _joined("influenciado_por", "qid", "nome"))


@query
def influence_edges(spark, sf_dir):
    return profiles.influence_edges(given.claims(spark, sf_dir), given.labels(spark, sf_dir))
