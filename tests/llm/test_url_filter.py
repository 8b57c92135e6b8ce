from __future__ import annotations

import re

import pytest

from cases import documents, empty
from pyspark.sql import functions as F

from lapidary.llm import url_filter

URLS = [
    "http://example.org/en/1", "https://WWW.Example.org/en/1/", "http://a.example.org/es/x?utm_source=b", "http://xexample.org/es/",
    "http://x.com/fr/", "http://x.com/de/7#a", "http://x.com/de", "http://com/de/", "http://x.net/q?b=1&a=2&utm_x=3", "ftp://x.net/q?a=2&b=1",
    "x.net/q?a=2&b=1", "", None, "http://", "http://x.net", "http://x.net?p=1", "http://x.net#p", "http://x.org", "http://user@x.org:80/es/",
    "http://ÄB.net/é", "http://x.net/" + "y" * 50_000, "http://x.net/a://b/c",
]


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def canonical(url):
    if not url or "://" not in url:
        return None
    host, path = host_path(url)
    query = re.match(r"[^?#]*(?:\?([^#]*))?", url.split("://", 1)[1])[1] or ""
    kept = sorted(p for p in query.split("&") if p and not p.startswith("utm_"))
    return re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def judged(url, listed):
    host, path = host_path(url)
    fitting = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fitting, key=lambda x: len(x[0]), default=(None, None))
    on_list = canonical(url) in listed
    return host, path, rule, verdict or ("block" if on_list else "allow"), on_list


@pytest.mark.parametrize("blocks", [1, 1 << 18])
def test_equals_brute_force(spark, blocks):
    pages = spark.createDataFrame([(i, u, "a", "b", "c") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string, key string, verdict string")
    names = ["http://x.net/q?a=2&b=1", "https://example.org/en/1", "http://x.org/", None, "no scheme", "http://x.org/"]
    names += [f"http://other{i}.net/{i}" for i in range(400)]
    listed = {canonical(u) for u in names} - {None}
    found = url_filter.judge(pages, spark.createDataFrame([(u,) for u in names], "url string"), keys_per_block=4, max_blocks=blocks)
    got = sorted((r.row.page_id, r.host, r.path, r.rule, r.verdict, r.listed) for r in found.collect())
    assert [(x[0], *(y or "" for y in x[1:3]), *x[3:]) for x in got] == sorted(((i, *judged(u, listed)) for i, u in enumerate(URLS * 3)), key=lambda x: x[0])
    assert found.first().row.host == "a"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert url_filter.judge(none, some).count() == 0
    assert [r.verdict for r in url_filter.judge(some, none).collect()] == ["allow"]


def test_rows_of_all_cases(spark):
    """Null, empty and very long urls, repeated rows, and extra columns named like the operator's own."""
    rows = documents(spark).withColumn("url", F.when(F.col("doc_id") == 6, F.concat(F.lit("http://x.net/"), F.repeat(F.lit("a"), 100_000))).otherwise(F.col("text")))
    found = url_filter.judge(rows, rows.filter("doc_id = 6")).collect()
    assert len(found) == rows.count() and set(found[0].row.asDict()) == set(rows.columns)
    assert {r.row.doc_id: r.verdict for r in found if r.listed} == {6: "block"}
    assert all((r.host, r.path, r.rule) == ("", "", None) for r in found if "://" not in (r.row.url or ""))
    assert url_filter.judge(empty(spark).withColumn("url", F.col("text")), rows).count() == 0
