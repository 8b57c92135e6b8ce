"""WARC revisit resolution: a not-modified capture gets its content from the latest earlier full response of its URL.

This is an as-of join by canonical URL and time without a sort per URL: captures are cut into time slices. The latest
response of each (URL, slice) is one aggregated row; a running maximum over a URL's slices carries it forward; inside
a slice a running maximum over the captures gives the rest. A URL with a third of all captures is thus as many tasks'
work as it has slices, and a URL's list of slices is bounded by the time span.

A revisit's validators are checked against that response: the entity tag by weak comparison where the revisit has
one, else the modification date. Only then are headers merged: the response's, with the permitted ones of the revisit
over them. Payloads are never moved; the digest names them.

Captures have ``capture_id, url, seconds`` (long), ``kind`` (response or revisit), ``digest`` and ``headers``, a map
with lower-case names.

Defined results: "earlier" is strictly earlier; of responses of one second the greatest capture_id counts. Captures
without a time or with a url that has no canonical form are matched with nothing; revisits among them are
``no_response``. Repeated rows are resolved one by one. Revisits without validators are ``unchecked`` and merged.
Null headers are empty. Very long urls are compared whole. An empty table gives an empty result. Only the named columns
of captures are read and returned, so names of other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.url_filter import canonical

SLICE_SECONDS = 6 * 3600
#: Headers that a 304 answer may update (fixed values of RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def _tag(column: Column) -> Column:
    """Entity tag for weak comparison."""
    return F.regexp_replace(column, "^[Ww]/", "")


def resolve(captures: DataFrame, slice_seconds: int = SLICE_SECONDS, permitted: Sequence[str] = PERMITTED) -> DataFrame:
    """A row for each revisit: ``capture_id, url, status, response_id, digest, headers``.

    ``status``: resolved, unchecked, mismatch or no_response; digest and headers are null for the last two.
    """
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    entries = F.array_sort(F.map_entries(headers))
    response = F.struct(F.col("seconds"), F.col("capture_id"), F.col("digest"), entries.alias("entries"))
    rows = captures.select(
        canonical(F.col("url")).alias("key"),
        F.floor(F.col("seconds") / slice_seconds).alias("slice"),
        "seconds",
        "kind",
        F.when(F.col("kind") == "response", response).alias("response"),
        F.struct(F.col("capture_id"), F.col("url"), headers.alias("headers")).alias("own"),
    )
    placed = F.col("key").isNotNull() & F.col("seconds").isNotNull()
    # Rows without key or time are nobody's neighbours: they must not meet in one group.
    lost = rows.filter(~F.coalesce(placed, F.lit(False)) & (F.col("kind") == "revisit")).withColumn("found", F.lit(None).cast(rows.schema["response"].dataType))
    there = rows.filter(placed)
    latest = there.groupBy("key", "slice").agg(F.max("response").alias("latest"))
    slices_before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.withColumn("carried", F.max("latest").over(slices_before)).select("key", "slice", "carried")
    earlier = Window.partitionBy("key", "slice").orderBy("seconds").rangeBetween(Window.unboundedPreceding, -1)
    inside = there.withColumn("inside", F.max("response").over(earlier)).filter("kind = 'revisit'")
    found = inside.join(carried, ["key", "slice"]).withColumn("found", F.coalesce("inside", "carried"))
    both = found.select("own", "found").unionByName(lost.select("own", "found"))

    old = F.map_from_entries("found.entries")
    new = F.col("own.headers")
    checked = both.select("own", "found", old.alias("old")).withColumn(
        "status",
        F.when(F.col("found").isNull(), "no_response")
        .when(new["etag"].isNotNull(), F.when(F.coalesce(_tag(new["etag"]) == _tag(F.col("old")["etag"]), F.lit(False)), "resolved").otherwise("mismatch"))
        .when(new["last-modified"].isNotNull(), F.when(F.coalesce(new["last-modified"] == F.col("old")["last-modified"], F.lit(False)), "resolved").otherwise("mismatch"))
        .otherwise("unchecked"),
    )
    update = F.map_filter(F.col("own.headers"), lambda name, _: name.isin(list(permitted)))
    kept = F.map_filter(F.col("old"), lambda name, _: ~F.array_contains(F.map_keys(update), name))
    good = F.col("status").isin("resolved", "unchecked")
    return checked.select(
        "own.capture_id",
        "own.url",
        "status",
        F.col("found.capture_id").alias("response_id"),
        F.when(good, F.col("found.digest")).alias("digest"),
        F.when(good, F.map_concat(kept, update)).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """Headers as lines in the order of their names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
