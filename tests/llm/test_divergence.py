from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.llm import divergence, queries
import cases

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, min_documents=30, top=50):
    docs, groups, found = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_documents]
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(mine.values(), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in mine.items()}, shares(whole)
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            tops = [(q[t] - p[s][t], t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(tops, key=lambda x: (x[0], x[1].encode()))[:top])):
                found |= {(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(items, 1)}
    return found


def rows_of(df):
    return {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()}


def test_whole_audit_by_brute_force(spark):
    draw = random.Random(4)
    words = [*"abcdefghij", "Été", "ÄÖ", "x1y", "don't"]
    rows = [
        (" ".join(draw.choices(words, range(1, 15), k=draw.randrange(30))), draw.choice(["en", "de", "", None]), draw.choice(["a", "b", "c", "é", None, ""]))
        for _ in range(300)
    ]
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("rare words", "xx", "c")] + rows[:20]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.audit(docs, min_documents=5)) == brute(rows, 5)


@pytest.mark.parametrize("cells", [1, 40])
def test_blocks_do_not_change_the_sums(spark, cells):
    rows = [(f"w{i % 7} v u{i % 3}".replace(str(i % 7), "abcdefg"[i % 7]), "en", f"s{i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    terms, groups = divergence.columns_of(docs, 3)
    whole = {tuple(r) for r in divergence.pair_values(terms, groups).collect()}
    assert {tuple(r) for r in divergence.pair_values(terms, groups, cells).collect()} == whole and len(whole) == 12


def test_distance_of_runs_equals_the_plain_sum():
    draw = np.random.default_rng(2)
    for _ in range(50):
        size = int(draw.integers(1, 60))
        a, b = np.sort(draw.integers(0, 4, size)), draw.integers(0, 3, size)
        assert divergence.distance(divergence.runs(a), divergence.runs(b), size) == int(np.abs(a - b).sum())


def test_share_beyond_64_bits():
    big = np.array([0, 5 * 10**12, 10**10])
    expected = [1 + (int(c) + 5) * 10**9 // (10**13 + 35) for c in big]
    assert divergence.share(big, 10**13, 7).tolist() == expected


def test_partial_counts_flush(spark, monkeypatch):
    rows = [("a b c d e f g h " * 3, "en", f"s{i % 3}") for i in range(50)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    expected = rows_of(divergence.audit(docs))
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    assert rows_of(divergence.audit(docs)) == expected


def test_defined_cases(spark):
    docs = cases.documents(spark)
    got = rows_of(divergence.audit(docs, min_documents=2))
    assert got == brute([(r.text, r.lang, r.source) for r in docs.collect()], 2)
    assert divergence.audit(cases.empty(spark)).count() == 0
    one = divergence.audit(docs.withColumn("source", F.col("doc_id").cast("string")).withColumn("lang", F.lit(None).cast("string")))
    assert {(r.part, r.value) for r in one.collect()} == {("pair", 0)}


def test_query_by_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("text", "lang", "source").collect()
    assert rows_of(queries.op11_source_divergence(spark, "/root/testdata/sf0.001")) == brute([tuple(r) for r in docs])
