from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lapidary.llm import popcount_dedup as p
from lapidary.llm.components import components
from cases import TEXTS, documents, empty


def slow_simhash(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def groups(nodes, linked):
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash():
    for _, text in TEXTS + [(0, "İstanbul A\x0bB\x0cC\x1cD ÀÉ"), (0, "x"), (0, "x y z")]:
        assert p.simhash(text) == slow_simhash(text)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    values = {0, -1, 1, (1 << 63) - 1, -(1 << 63)}
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(8):
            flipped = base
            for bit in rng.sample(range(64), rng.randrange(0, 6)):
                flipped ^= 1 << bit
            values.add(flipped - (1 << 64) if flipped >> 63 else flipped)
    values = sorted(values)
    got = {(r.a, r.b) for r in p.links(spark.createDataFrame([(v,) for v in values], "fingerprint long")).collect()}
    bits = np.bitwise_count(np.array(values)[:, None].view(np.uint64) ^ np.array(values)[None, :].view(np.uint64))
    wanted = {(values[i], values[j]) for i, j in zip(*np.where(bits <= 3)) if i < j}
    assert got == wanted and len(wanted) > 200


def test_components_of_paths_stars_and_clusters(spark):
    rng = random.Random(4)
    linked = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 80)] + [(301, 300), (300, 301), (5, 5)]
    linked += [tuple(rng.sample(range(400, 500), 2)) for _ in range(60)]
    rng.shuffle(linked)
    made = components(spark.createDataFrame(linked, "a long, b long"))
    got = {r.node: r["least"] for r in made.collect()}
    wanted = groups({n for x in linked for n in x}, linked)
    assert got == {n: g for n, g in wanted.items() if n != g}


def near_texts():
    rng = random.Random(9)
    words = [f"term{rng.randrange(9000)}" for _ in range(400)]
    rows = list(TEXTS)
    for i in range(25):
        changed = list(words)
        changed[rng.randrange(400)] = f"edit{i}"
        rows.append((100 + i, " ".join(changed)))
    return rows + [(90, " ".join(words)), (91, " ".join(words))] + [(500 + i, f"other text {i} with some words {i * i} here") for i in range(30)]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_texts()
    docs = documents(spark, rows).selectExpr("doc_id as id", "text")
    prints = [(i, slow_simhash(t)) for i, t in rows]
    values = sorted({f for _, f in prints})
    linked = [(a, b) for a in values for b in values if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3]
    of_print = groups(values, linked)
    first = {}
    for i, f in prints:
        if i is not None:
            first[of_print[f]] = min(first.get(of_print[f], i), i)
    wanted = sorted((str(i), f, str(first.get(of_print[f]))) for i, f in prints)
    got = sorted((str(r.id), r.fingerprint, str(r.component_id)) for r in p.near_duplicates(docs).collect())
    assert got == wanted
    assert len({g for _, f, g in wanted if f not in (0,)}) < len(values)


def test_one_of_each(spark):
    docs = documents(spark, near_texts())
    kept = p.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and 90 in named and 91 not in named and 1 in named and 2 not in named
    assert named.count(7) == 1 and ids.count(None) == 1
    assert 3 in named and 4 not in named  # texts without words are one group
    assert p.one_of_each(empty(spark)).count() == 0
    assert p.near_duplicates(empty(spark).selectExpr("doc_id as id", "text")).count() == 0


def test_one_of_each_keeps_different_texts_under_one_id(spark):
    alone, shared, other = "a text that stands alone here and has no copy", "a text of which another document holds a copy", "yet another text of many different words under the id"
    rows = [(7, alone), (7, shared), (3, shared), (7, alone), (7, other), (8, other)]
    assert len({slow_simhash(t) for t in (alone, shared, other)}) == 3
    got = sorted((r.doc_id, r.text) for r in p.one_of_each(documents(spark, rows)).collect())
    assert got == sorted([(3, shared), (7, alone), (7, other)])


def test_bound_on_counts_removes_pairs_and_never_a_link(spark):
    draw = random.Random(6)
    pairs = []
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randrange(8)):
            b ^= 1 << bit
        pairs.append((a - (a >> 63 << 64), b - (b >> 63 << 64)))
    df = spark.createDataFrame(pairs, "a long, b long").distinct()

    def counts(x):
        return [(x >> 2 * i & 3).bit_count() for i in range(32)]

    got = {(r.a, r.b): r.d for r in df.withColumn("d", p.manhattan(F.col("a"), F.col("b"))).collect()}
    assert all(d == sum(abs(x - y) for x, y in zip(counts(a), counts(b))) <= ((a ^ b) % 2**64).bit_count() for (a, b), d in got.items())
    left = {(r.a, r.b) for r in p.within(df).collect()}
    linked = {p for p in got if ((p[0] ^ p[1]) % 2**64).bit_count() <= 3}
    assert linked < left < set(got)
