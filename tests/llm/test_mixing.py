from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lapidary.llm import mixing
from cases import TEXTS, documents, empty

WEIGHTS = ({"a": 0.7, "b": 0.3}, {"en": 0.6, "de": 0.4, "xx": 0.0}, {"s1": 2.0})


def fill(budget, children):
    """Water filling by repeated sharing: {name: (weight, capacity)} to {name: budget}."""
    open_, got = {n for n, (w, _) in children.items() if w > 0}, dict.fromkeys(children, 0.0)
    while open_:
        left = budget - sum(got[n] for n in children if n not in open_)
        share = {n: left * children[n][0] / sum(children[m][0] for m in open_) for n in open_}
        full = {n for n in open_ if share[n] >= children[n][1]}
        if not full:
            return got | share
        got |= {n: children[n][1] for n in full}
        open_ -= full
    return got


def brute(rows, weights, share, epochs, seed):
    """rows: (doc_id, text, path) to a list of (doc_id, epoch)."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = {}
    for i, t, path in rows:
        if count(t):
            leaves.setdefault(path, []).append((i, t))
    tokens = {p: sum(count(t) for _, t in v) for p, v in leaves.items()}
    granted = {(): sum(tokens.values()) * share}
    for level in range(3):
        following = {}
        for above, budget in granted.items():
            names = {p[level] for p in tokens if p[:level] == above}
            capacity = lambda n: epochs * sum(v for p, v in tokens.items() if p[: level + 1] == (*above, n))
            following |= {(*above, n): b for n, b in fill(budget, {n: (weights[level].get(n, 1.0), capacity(n)) for n in names}).items()}
        granted = following
    found = []
    for path, held in leaves.items():
        budget = int(granted[path] + 1e-6)
        full, rest = divmod(budget, tokens[path])
        order = lambda x: hashlib.md5(f"{seed}|{full + 1}|{'' if x[0] is None else x[0]}|{hashlib.md5(x[1].encode()).hexdigest()}".encode()).hexdigest()
        total = {}
        for x in held:
            total[order(x)] = total.get(order(x), 0) + count(x[1])
        running, taken = 0, set()
        for key in sorted(total):
            running += total[key]
            if running > rest:
                break
            taken.add(key)
        for x in held:
            found += [(x[0], e) for e in range(1, full + 1 + (order(x) in taken))]
    return sorted(found, key=str), granted


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (0.9, 3), (2.5, 4), (9.0, 2), (0.0, 1)])
def test_equals_brute_force(spark, share, epochs):
    paths = [("a", "en", "s1"), ("a", "en", "s2"), ("a", "de", None), ("a", "xx", "s9"), ("b", None, "s1"), ("c", "en", "s3")]
    rows = []
    for n, size in enumerate([90, 20, 3, 10, 40, 1]):
        rows += [(100 * n + i, " ".join(["t"] * (1 + (i * 37 + n) % 23)), paths[n]) for i in range(size)]
    rows += [(5000, None, paths[0]), (5001, " ", paths[1]), (None, "x y", paths[0]), (7, "re peat", paths[1]), (7, "re peat", paths[1])]
    made = spark.createDataFrame([(i, t, *p, "x", "y") for i, t, p in rows], "doc_id long, text string, d string, l string, s string, k0 string, budget string")
    got = mixing.mixed(made, [F.col("d"), F.col("l"), F.col("s")], WEIGHTS, share, epochs, seed=3)
    wanted, granted = brute(rows, WEIGHTS, share, epochs, 3)
    assert sorted(((r.row.doc_id, r.epoch) for r in got.collect()), key=str) == wanted


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("=a", "=en", "=s1", 10), ("=a", "=en", "=s2", 1000), ("=a", "=de", "=s3", 1000), ("=b", "=en", "=s4", 1000)], "k0 string, k1 string, k2 string, tokens long")
    got = {r.k2: r.budget for r in mixing.budgets(leaves, 3, ({}, {}, {}), 400 / 3010, 1).collect()}
    assert got == {"=s1": 10, "=s2": 90, "=s3": 100, "=s4": 200}


def test_defined_cases(spark):
    paths = [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]
    docs = documents(spark)
    taken = mixing.mixed(docs, paths, share=1.0, epochs=1)
    assert set(taken.first().row.asDict()) == set(docs.columns)
    assert sorted(str(r.row.doc_id) for r in taken.collect()) == sorted(str(i) for i, t in TEXTS if (t or "").strip(" \t\n"))
    assert mixing.mixed(empty(spark), paths).count() == 0
