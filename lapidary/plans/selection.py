"""Seeded quote selection for whole tables of requests."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions import ids
from lapidary.operators.picks import pick_by_seed
from lapidary.session import reused

#: Stands for every category; no category is empty.
_ANY = ""
_SHOWN = fixed.SELECTION_FIELDS
#: Columns of gold that a selection reads.
READ_COLUMNS = [*(c for c in _SHOWN if c != "thinker_name"), "thinker_qid", "character_count", "is_daily_eligible"]


def _by_thinker(name: Column) -> Column:
    return F.concat(F.lit("t:"), name)


def _scope(thinker: Column, collection: Column) -> Column:
    return (
        F.when(thinker.isNotNull(), _by_thinker(thinker))
        .when(collection.isNotNull(), F.concat(F.lit("c:"), collection))
        .otherwise(F.lit("all"))
    )


def _scopes(members: DataFrame) -> DataFrame:
    """Candidate names of every request scope: one thinker, one collection, or the whole catalogue."""
    names = members.select("thinker_name").distinct()
    return (
        names.select(_by_thinker(F.col("thinker_name")).alias("scope"), "thinker_name")
        .unionByName(members.select(F.concat(F.lit("c:"), "slug").alias("scope"), "thinker_name").distinct())
        .unionByName(names.select(F.lit("all").alias("scope"), "thinker_name"))
    )


def _blank_to_null(requests: DataFrame) -> DataFrame:
    return requests.withColumns({c: F.nullif(c, F.lit("")) for c in ("thinker", "collection")})


def _checked(requests: DataFrame, members: DataFrame, check_thinker: bool) -> DataFrame:
    """Add ``problem``: the first of unknown collection, unknown thinker, thinker outside the collection."""
    collection, thinker = F.col("collection"), F.col("thinker")
    slugs = members.select(F.col("slug").alias("collection")).distinct().withColumn("_slug", F.lit(True))
    pairs = members.select(F.col("slug").alias("collection"), F.col("thinker_name").alias("thinker")).distinct()
    joined = requests.join(slugs, "collection", "left").join(
        pairs.withColumn("_member", F.lit(True)), ["collection", "thinker"], "left"
    )
    problem = F.when(collection.isNotNull() & F.col("_slug").isNull(), "unknown_collection")
    if check_thinker:
        names = members.select(F.col("thinker_name").alias("thinker")).distinct().withColumn("_name", F.lit(True))
        joined = joined.join(names, "thinker", "left")
        problem = problem.when(thinker.isNotNull() & F.col("_name").isNull(), "unknown_thinker")
    problem = problem.when(collection.isNotNull() & thinker.isNotNull() & F.col("_member").isNull(), "not_in_collection")
    return joined.withColumn("problem", problem).drop("_slug", "_member", "_name")


def _length_key(max_length: Column) -> Column:
    """A zero limit filters like any other but leaves no trace in the key."""
    return F.nullif(max_length.cast("long"), F.lit(0).cast("long")).cast("string")


def _pick(quotes: DataFrame, requests: DataFrame, members: DataFrame, shown: Sequence[str] = _SHOWN) -> DataFrame:
    return pick_by_seed(quotes.select("character_count", *shown), requests, members).drop("character_count")


def _answer(requests: DataFrame, picks: DataFrame) -> DataFrame:
    answered = requests.join(picks.withColumnRenamed("category", "quote_category"), "request_id", "left")
    status = F.coalesce("problem", F.when(F.col("occurrence_id").isNull(), "no_match").otherwise("ok"))
    return answered.withColumn("status", status).drop("problem", "seed", "scope")


def daily_selection(
    requests: DataFrame, gold: DataFrame, thinkers: DataFrame, members: DataFrame, dataset_version: str
) -> DataFrame:
    """One eligible quote per request, uniform over the eligible occurrences that match.

    ``requests``: request_id, on_date (ISO text), thinker, collection, category,
    max_length, the last four nullable; ``members``: slug, title, thinker_name.
    """
    eligible = (
        gold.select(READ_COLUMNS)
        .filter("is_daily_eligible")
        .join(thinkers.select("thinker_qid", "thinker_name"), "thinker_qid")
    )
    checked = _checked(_blank_to_null(requests), members, check_thinker=True)
    key = ids.selection_key(
        F.lit(dataset_version),
        F.col("on_date"),
        F.col("thinker"),
        F.col("collection"),
        F.col("category"),
        _length_key(F.col("max_length")),
    )
    seeded = checked.withColumn("seed", ids.seed(key)).withColumn(
        "scope", _scope(F.col("thinker"), F.col("collection"))
    )
    seeded = reused(seeded, plain=True)
    answers = _answer(seeded, _pick(eligible, seeded.filter("problem is null"), _scopes(members)))
    titles = members.groupBy(F.col("slug").alias("collection")).agg(F.min("title").alias("collection_title"))
    return answers.join(titles, "collection", "left").withColumns({
        "mode": F.lit("daily"),
        "dataset_version": F.lit(dataset_version),
        "dataset_schema": F.lit(fixed.SERVING_SCHEMA_VERSION),
    })


def collection_samples(
    slugs: DataFrame, on_date: str, gold: DataFrame, thinkers: DataFrame, members: DataFrame, dataset_version: str
) -> DataFrame:
    """The daily quote of every collection on one date."""
    none = F.lit(None).cast("string")
    requests = slugs.select(
        F.col("slug").alias("request_id"),
        F.lit(on_date).alias("on_date"),
        none.alias("thinker"),
        F.col("slug").alias("collection"),
        none.alias("category"),
        F.lit(None).cast("long").alias("max_length"),
    )
    return daily_selection(requests, gold, thinkers, members, dataset_version)


def two_stage_selection(
    requests: DataFrame,
    quotes: DataFrame,
    members: DataFrame,
    mode: str = "daily",
    random_seed: int | None = None,
    shown: Sequence[str] = _SHOWN,
) -> DataFrame:
    """Choose a thinker first, then one of its matching quotes, so thinkers weigh alike.

    The first candidate with a match in a seeded random order is a uniform pick
    among the candidates that match: the thinker at ``seed mod n`` of the ``n`` that
    match the request's filter, by digest of the name. No request meets the names. ``quotes`` need not be eligible, and a thinker
    outside the catalogue is served if it has quotes. Random mode seeds each
    request from one number drawn per call; give ``random_seed`` to repeat a draw.
    ``shown`` are the columns of the picked quote: occurrence_id, thinker_name, category and any others.
    """
    checked = _checked(_blank_to_null(requests), members, check_thinker=False)
    if mode == "daily":
        key = ids.selection_key(
            F.col("on_date"),
            F.col("thinker"),
            F.col("collection"),
            F.col("category"),
            _length_key(F.col("max_length")),
        )
    else:
        draw = secrets.randbits(63) if random_seed is None else random_seed
        key = ids.selection_key(F.lit(str(draw)), F.col("request_id").cast("string"))
    checked = reused(checked.withColumn("_key", key), plain=True)
    candidates = _scopes(members).unionByName(
        checked.filter("thinker is not null")
        .select(_by_thinker(F.col("thinker")).alias("scope"), F.col("thinker").alias("thinker_name"))
        .distinct()
    )
    open_requests = checked.filter("problem is null").withColumn("scope", _scope(F.col("thinker"), F.col("collection")))
    # A thinker matches a filter if its shortest quote of the category, or of any, fits the limit. These rows stand
    # in for the thinkers, in the order of a digest of the name, so the same pick serves both stages.
    categories = F.explode(F.array(F.col("category"), F.lit(_ANY)))
    shortest = (
        quotes.filter("thinker_name is not null")
        .select("thinker_name", categories.alias("category"), "character_count")
        .groupBy("thinker_name", "category")
        .agg(F.min("character_count").alias("character_count"))
        .withColumn("occurrence_id", F.sha2("thinker_name", 256))
    )
    for_names = open_requests.select(
        "request_id",
        "scope",
        F.coalesce("category", F.lit(_ANY)).alias("category"),
        "max_length",
        ids.seed(F.col("_key")).alias("seed"),
    )
    picked = pick_by_seed(reused(shortest), for_names, candidates.distinct())
    first = reused(picked.select("request_id", F.col("thinker_name").alias("_first")), plain=True)
    second = (
        open_requests.join(first, "request_id")
        .withColumn("scope", _by_thinker(F.col("_first")))
        .withColumn("seed", ids.seed(F.concat_ws("|", "_key", F.lit("quote"))))
        .select("request_id", "scope", "category", "max_length", "seed")
    )
    names = quotes.select(_by_thinker(F.col("thinker_name")).alias("scope"), "thinker_name").distinct()
    return _answer(checked.drop("_key"), _pick(quotes, second, names, shown))
