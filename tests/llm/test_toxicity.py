from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.llm import queries, toxicity
import cases

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "token, expected",
    [
        ("idiot", ("idiot", False)),
        ("«Idiot!»", ("idiot", False)),
        ("1d10t", ("idiot", True)),
        ("i.d-i.o_t", ("idiot", True)),
        ("stuuuupid,", ("stupid", True)),
        ("tr@sh", ("trash", True)),
        ("2024", ("", False)),
        ("--", ("", False)),
        ("ÜBER", ("über", False)),
    ],
)
def test_plain_words(token, expected):
    assert toxicity.plain(token) == expected


def test_features_by_hand():
    known = toxicity._Known({"gruk*": 0.9, "zzz": 0.5})
    x = toxicity.features("You GRUKLING!! are an 1d10t and the zzz?", known)
    n = 8
    assert x[0] == pytest.approx(np.log1p(n))
    assert x[1] == pytest.approx(1 / n) and x[4] == pytest.approx(np.log1p(1)) and x[5] == pytest.approx(0.9, abs=1e-6)
    assert x[6] == pytest.approx(np.log1p(2)) and x[7] == pytest.approx(1 / n)
    assert x[8] == pytest.approx(2 / n) and x[9] == pytest.approx(1 / 2)
    assert x[10] == pytest.approx(1.9 / toxicity.WINDOW, abs=1e-6) and x[11] == pytest.approx(1 / n)
    assert (x[12], x[13], x[14]) == (2 / n, 1 / n, 1 / n)
    assert x[15] == pytest.approx(1 / n) and x[16] == pytest.approx(1 / n) and x[17] == 0
    assert not toxicity.features(None, known).any() and not toxicity.features(" \t\n", known).any()


def test_codes_do_not_depend_on_what_is_remembered(monkeypatch):
    text = " ".join(f"w{i % 50} gruk{i % 9}" for i in range(400))
    expected = toxicity.features(text, toxicity._Known({"gruk*": 0.9}))
    monkeypatch.setattr(toxicity, "WORDS", 3)
    assert (toxicity.features(text, toxicity._Known({"gruk*": 0.9})) == expected).all()


def test_isotonic_equals_the_min_max_formula():
    draw = np.random.default_rng(1)
    for _ in range(40):
        n = int(draw.integers(1, 25))
        x, y, w = draw.integers(0, 8, n) / 4, draw.integers(0, 2, n).astype(float), draw.integers(1, 4, n).astype(float)
        points = np.unique(x)

        def mean(a, b):
            inside = (x >= a) & (x <= b)
            return (w * y)[inside].sum() / w[inside].sum()

        expected = [max(min(mean(a, b) for b in points if b >= p) for a in points if a <= p) for p in points]
        assert np.interp(points, *toxicity.isotonic(x, y, w)) == pytest.approx(expected)


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(2)
    x = draw.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = toxicity.boost(x[:600], y[:600], np.ones(600))
    assert ((toxicity.margin(model, x[600:]) > 0) == y[600:]).mean() > 0.9


def labelled(spark, n=600, seed=1):
    """Texts of invented words; label 1 has a word that begins with a stem of its own."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"{draw.choice('bcdfgl')}{draw.choice('aeiou')}{draw.choice('mnrst')}{draw.choice('aeiou')}" for _ in range(40)]
        if toxic := i % 4 == 0:
            words[draw.randrange(40)] = "quorv" + draw.choice(["ak", "em", "il", "os", "ut", "yx"])
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")


def test_stems_are_learnt_and_held_out_rows_teach_nothing(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    assert any(t.startswith("quorv") for t in model["lexicon"])
    got = {r.row.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.row.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, turned)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_held_out_remainders(spark):
    rows = spark.range(2000).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_samples_are_bounded_and_weighed(spark):
    docs, labels = labelled(spark)
    rows, weights = toxicity.drawn_rows(docs, labels, sample=50)
    assert {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()} == {0: 50, 1: 50}
    known = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5]
    assert weights == [sum(i % 4 > 0 for i in known) / 50, sum(i % 4 == 0 for i in known) / 50]


def test_defined_cases(spark):
    docs = cases.documents(spark)
    train_docs, labels = labelled(spark, 200)
    model = toxicity.train(train_docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and rows[0].row.asDict().keys() == set(docs.columns)
    blank = {r.score for r in rows if r.row.text is None or not r.row.text.strip()}
    assert len(blank) == 1
    assert toxicity.score(cases.empty(spark), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.train(train_docs, labels.withColumn("toxic", F.lit(1)))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {1.0}
    both = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic")))
    assert {r.score for r in toxicity.score(docs, toxicity.train(train_docs, both)).collect()} == {0.0}


def test_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, SF_DIR).collect()}
    assert len(got) == queries.table(spark, SF_DIR, "documents").count()
    known = [(got[r.doc_id], r.toxic) for r in queries.table(spark, SF_DIR, "labels").collect() if got[r.doc_id].held_out]
    clean = [r.predicted for r, toxic in known if not toxic]
    assert sum(clean) <= 0.02 * len(clean)
    assert np.mean([r.score for r, t in known if t]) > 5 * np.mean([r.score for r, t in known if not t])
