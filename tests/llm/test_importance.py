from __future__ import annotations

import math

import numpy as np
import pytest

from lapidary.llm import importance
from cases import TEXTS, documents, empty


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus():
    good = [(i, f"plain words about topic {i % 7} in a calm sentence number {i % 11}") for i in range(300)]
    bad = [(1000 + i, f"BUY!! {i % 3} $$$ CLICK!! now ### {i % 5} ***") for i in range(60)]
    return good + bad


def test_models_count_all_documents(spark):
    docs = corpus() + TEXTS
    made = importance.log_ratios(documents(spark, docs), labels(spark, [(i, 1, 0) for i in range(100)] + [(1000, 0, 0), (None, 1, 0)]))
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, text in docs:
        buckets = importance.ngram_buckets(text)
        np.add.at(raw, buckets, 1)
        if i is not None and i < 100:
            np.add.at(target, buckets, 1)
    wanted = np.log((target + 1) / (target.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    assert np.allclose(made, wanted, atol=1e-6)


def test_words_and_pairs():
    assert len(importance.ngram_buckets("a b\tc\n d")) == 7
    same = importance.ngram_buckets("x  y")
    assert (same == importance.ngram_buckets(" x\ny ")).all() and len(set(same)) == 3
    assert not len(importance.ngram_buckets(None)) and not len(importance.ngram_buckets(" "))


@pytest.mark.parametrize("k", [1, 17, 80, 119, 120])
def test_top_limit_equals_sort(spark, k):
    base = importance.SHIFT
    rows = [(base + v, t) for t, v in enumerate([3, 5, 5, 5, -7, 1 << 40, -(1 << 45), 0] * 15)]
    values = spark.createDataFrame(rows, "value long, tie long")
    value, order = importance.top_limit(values, k)
    from pyspark.sql import functions as F

    kept = values.filter((F.col("value") > value) | ((F.col("value") == value) & (F.xxhash64("tie") <= order))).collect()
    assert sorted(r.value for r in kept) == sorted((v for v, _ in rows), reverse=True)[:k][::-1]


def test_rejects_junk_and_keeps_clean(spark):
    known = [(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)]
    docs = documents(spark, corpus())
    rows = importance.resample(docs, labels(spark, known)).collect()
    kept = {r.row.doc_id for r in rows if r.kept}
    assert rows[0].row.component_id is not None and set(rows[0].row.asDict()) == set(docs.columns)
    limit = importance.good_share(labels(spark, known))
    assert len(kept) == math.ceil(360 * limit)
    assert set(range(300)) <= kept
    again = {r.row.doc_id for r in importance.resample(docs.repartition(7), labels(spark, known)).collect() if r.kept}
    assert again == kept


def test_defined_cases(spark):
    none = labels(spark, [])
    assert all(r.kept for r in importance.resample(documents(spark), none).collect())
    assert importance.resample(empty(spark), labels(spark, [(1, 1, 0)])).count() == 0
    rows = importance.resample(documents(spark), labels(spark, [(1, 1, 0), (6, 0, 0), (7, None, 0)]), share=1.0).collect()
    assert len(rows) == len(TEXTS) and all(r.kept for r in rows)
    assert {r.log_ratio for r in rows if not (r.row.text or "").strip()} == {0.0}


def test_whole_resampling_by_brute_force(spark):
    """Models, sums, noise and the kept set of the whole operator; only the random hash is taken from Spark."""
    from pyspark.sql import functions as F

    rows = corpus() + TEXTS
    docs = documents(spark, rows)
    known = [(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)]
    got = importance.resample(docs, labels(spark, known), share=0.6).collect()
    draws = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("tie"), F.xxhash64(F.xxhash64("text")).alias("order"),
        F.xxhash64(F.lit(importance.SEED + 1), "doc_id", F.xxhash64("text")).alias("draw"),
    ).collect()
    good = {i for i, quality, _ in known if quality}
    raw, target = np.ones(importance.BUCKETS), np.ones(importance.BUCKETS)
    for i, text in rows:
        for bucket in importance.ngram_buckets(text):
            raw[bucket] += 1
            target[bucket] += i in good
    model = np.log(target / target.sum()) - np.log(raw / raw.sum())
    ranked = []
    for r in draws:
        ratio = model[importance.ngram_buckets(r.text)].sum()
        noise = -math.log(-math.log((r.draw % (1 << 52) + 0.5) / (1 << 52)))
        ranked.append((-(ratio + noise), r.order, r.doc_id, r.text, ratio))
    ranked.sort(key=lambda x: x[:2])
    kept = {(x[2], x[3]) for x in ranked[: math.ceil(0.6 * len(rows))]}
    assert {(r.row.doc_id, r.row.text) for r in got if r.kept} == kept
    ratios = {(x[2], x[3]): x[4] for x in ranked}
    assert all(abs(r.log_ratio - ratios[r.row.doc_id, r.row.text]) < 0.05 for r in got)
