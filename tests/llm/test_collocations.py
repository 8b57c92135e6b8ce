from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lapidary.llm import collocations, queries
import cases

LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, support=30, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        longest = Counter()
        for p, a in candidates.items():
            for part in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                longest[part] = max(longest[part], a)
        ranked = []
        for p, a in candidates.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return found


def rows_of(df):
    return {tuple(r[c] for c in "lang rank phrase a l r n score".split()) for r in df.collect()}


def random_rows(seed, size=400):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "AB", "a b", "x\x85y", "%"]
    sentences = [" ".join(draw.choices(words, range(1, 18), k=draw.randrange(1, 60))) for _ in range(25)]
    rows = []
    for _ in range(size):
        parts = [draw.choice(sentences) if draw.random() < 0.5 else " ".join(draw.choices(words, k=draw.randrange(9))) for _ in range(3)]
        rows.append((draw.choice([". ", ", ", "\n", " ", "\t"]).join(parts), draw.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_mining_by_brute_force(spark, seed):
    rows = random_rows(seed)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(collocations.mine(docs, support=8)) == brute(rows, 8)


def test_small_portions_few_marks_and_forced_cuts_change_nothing(spark, monkeypatch):
    rows = random_rows(3, 150) + [("the same " * 900, "en"), ("word " * 700, None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    expected = brute(rows, 5)
    assert rows_of(collocations.mine(docs, support=5)) == expected
    for name, value in (("ENTRIES", 20), ("WORDS", 50), ("LONGEST", 5), ("MARK_BITS", 10)):
        monkeypatch.setattr(collocations, name, value)
    assert rows_of(collocations.mine(docs, support=5)) == expected


def test_chunks_overlap_and_give_the_piece_back():
    draw = random.Random(5)
    words = [f"w{draw.randrange(90)}" for _ in range(500)]
    found, n = collocations.chunks_of(" ".join(words) + ". Last one", collocations._Hashes())
    assert n == 502 and len(found) > 10
    rebuilt = []
    for chunk in found:
        parts = chunk.decode().split(" ")
        rebuilt += parts[: -collocations.OVERLAP - 1] if parts[-1] == "." else parts
    assert rebuilt == [*words, "last", "one"]
    again, _ = collocations.chunks_of("before it. " + " ".join(words[40:]), collocations._Hashes())
    assert len(set(again) & set(found)) >= len(again) - 3


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    rows = [("en", 1, "a", big + 7), ("en", 1, "b", big), ("en", 2, "a b", big - 1)]
    phrases = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    assert collocations.scored(phrases).collect()[0].score == 2000000 * (big - 1) // (2 * big + 7)


def test_defined_cases(spark):
    docs = cases.documents(spark)
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert rows_of(collocations.mine(docs, support=2)) == brute(rows, 2)
    assert collocations.mine(cases.empty(spark)).count() == 0
    und = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "und"))
    assert rows_of(collocations.mine(und, support=2)) == brute([(t, "und") for t, _ in rows], 2)


def test_query_by_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("text", "lang").collect()
    assert rows_of(queries.op12_phrase_collocations(spark, "/root/testdata/sf0.001")) == brute([tuple(r) for r in docs])
