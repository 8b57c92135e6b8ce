from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cases import EXTRA, documents
from lapidary.llm import revisits

SCHEMA = "capture_id long, url string, seconds long, kind string, digest string, headers map<string,string>, key string, slice long, found string"


def brute(rows):
    found = []
    for i, url, t, kind, _, headers, *_ in rows:
        if kind != "revisit":
            continue
        key = None if url is None or "://" not in url else url.split("://")[1].split("#")[0].rstrip("/")
        before = [r for r in rows if r[3] == "response" and key is not None and t is not None and r[2] is not None and r[2] < t and r[1].split("://")[-1].split("#")[0].rstrip("/") == key]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        own = headers or {}
        if best is None:
            status = "no_response"
        else:
            old = best[5] or {}
            clean = lambda x: x and x.removeprefix("W/")
            check = ("etag", clean) if "etag" in own else ("last-modified", str) if "last-modified" in own else None
            status = "unchecked" if not check else "resolved" if check[0] in old and check[1](own[check[0]]) == check[1](old[check[0]]) else "mismatch"
        good = status in ("resolved", "unchecked")
        merged = {**(best[5] or {}), **{k: v for k, v in own.items() if k in revisits.PERMITTED}} if good else None
        found.append((i, status, best and best[0], best[4] if good else None, merged))
    return sorted(found, key=str)


@pytest.mark.parametrize("slice_seconds", [1, 50, 10**6])
def test_equals_brute_force(spark, slice_seconds):
    rng = random.Random(7)
    urls = ["http://a.net/x", "https://a.net/x/", "http://a.net/x#f", "http://b.net/", "http://b.net", "http://c.net/only"]
    rows = []
    for i in range(600):
        kind = rng.choice(["response", "revisit", "revisit"])
        headers = {k: v for k, v in {"etag": rng.choice(['"1"', 'W/"1"', '"2"', None]), "last-modified": rng.choice(["Mon", "Tue", None]),
                   "content-length": str(i), "date": f"d{i}", "x-own": rng.choice(["1", None])}.items() if v}
        rows.append((i, rng.choice(urls), rng.randrange(300), kind, f"p{i}", headers if i % 17 else None, "k", 1, "f"))
    rows += [(1000, None, 5, "revisit", "p", {}, "", 0, ""), (1001, "nothing", 5, "revisit", "p", {}, "", 0, ""), (1002, urls[0], None, "revisit", "p", {}, "", 0, "")]
    rows += [rows[1], rows[1]]
    found = revisits.resolve(spark.createDataFrame(rows, SCHEMA), slice_seconds)
    got = sorted(((r.capture_id, r.status, r.response_id, r.digest, r.headers) for r in found.collect()), key=lambda x: str(x[:4]))
    wanted = sorted(brute(rows), key=lambda x: str(x[:4]))
    assert got == wanted
    assert {x[1] for x in got} == {"resolved", "unchecked", "mismatch", "no_response"}


def test_empty_table(spark):
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_header_text(spark):
    row = spark.range(1).select(revisits.header_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1: x"))).alias("t")).first()
    assert row.t == "a: 1: x\nb: 2"


def test_rows_of_all_cases(spark):
    """Extra columns named like the operator's own, very long urls, empty and null fields, repeated rows."""
    rows = documents(spark).select(
        F.monotonically_increasing_id().alias("capture_id"),
        F.when(F.col("doc_id") == 6, F.concat(F.lit("http://x.net/"), F.repeat(F.lit("a"), 100_000))).otherwise(F.col("text")).alias("url"),
        F.col("doc_id").alias("seconds"),
        F.lit("revisit").alias("kind"),
        F.lit("d").alias("digest"),
        F.create_map().cast("map<string,string>").alias("headers"),
        *[name for name in EXTRA if name != "digest"],
    )
    first = rows.filter("seconds = 6").withColumns({"capture_id": F.lit(-1).cast("long"), "seconds": F.lit(1).cast("long"), "kind": F.lit("response")})
    found = revisits.resolve(rows.unionByName(first)).collect()
    assert len(found) == rows.count()
    assert [(r.status, r.response_id) for r in found if r.status != "no_response"] == [("unchecked", -1)]
