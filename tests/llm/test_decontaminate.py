from __future__ import annotations

import math
import random
import re

from lapidary.llm import decontaminate
from cases import LONG, TEXTS, documents, empty


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(docs, items):
    found = {}
    for doc, text in docs:
        own = shingles(text)
        for item, wanted in items:
            n, shared = len(shingles(wanted)), len(shingles(wanted) & own)
            if n and shared >= math.ceil(0.8 * n - 1e-9):
                found[doc, item] = max(found.get((doc, item), (0, 0)), (shared, n))
    return found


def table(rows):
    return {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in rows.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 7, 9, 12, 15, 16, 17, 31, 32, 33, 59, 64, 120] * 3)]
    docs = []
    for i in range(150):
        _, text = rng.choice(items)
        words = text.split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = word()
        around = [word() for _ in range(rng.choice([0, 3, 40, 2000]))]
        cut = rng.randrange(len(around) + 1)
        joined = [*around[:cut], *words, *around[cut:]]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(joined).upper()))
    docs += TEXTS + [(200, "alpha " + LONG)]
    items += [(900, None), (901, ""), (902, "..."), (903, " ".join(LONG.split()[500:540])), (904, TEXTS[0][1])]
    made = spark.createDataFrame(items, "item_id long, text string")
    got = table(decontaminate.contained(documents(spark, docs), made))
    assert got == brute(docs, items)
    assert any(a < b for a, b in got.values()) and (200, 903) in got


def test_stage_keeps_columns_and_clean_rows(spark):
    items = spark.createDataFrame([(1, TEXTS[0][1]), (2, TEXTS[8][1])], "item_id long, text string")
    docs = documents(spark)
    kept = decontaminate.without_items(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "7", "7", "8"]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained(empty(spark), items).count() == 0
    assert decontaminate.contained(documents(spark), items.limit(0)).count() == 0
    assert decontaminate.without_items(documents(spark), items.limit(0)).count() == len(TEXTS)


def test_sketch_cannot_miss(spark):
    """The sketch is longer than the number of shingles that a containing text may lack."""
    items = spark.createDataFrame([(n, " ".join(f"v{i}" for i in range(n + 4))) for n in range(1, 70)], "item_id long, text string")
    sizes = {r.item_id: r["count"] for r in decontaminate.sketches(items).groupBy("item_id").count().collect()}
    assert all(sizes[n] > n - math.ceil(0.8 * n - 1e-9) for n in range(1, 70))


def test_items_without_an_id_are_found(spark):
    rows = [(None, "a passage of ten words that has no id at all"), (None, "another one of seven words here too"), (3, "an item of six words here")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = [(i, f"before it {t} and after it") for i, (_, t) in enumerate(rows)] + [(9, "a text that holds none of the items")]
    docs = documents(spark, texts)
    assert set(table(decontaminate.contained(docs, items))) == {(0, None), (1, None), (2, 3)}
    assert [r.doc_id for r in decontaminate.without_items(docs, items).collect()] == [9]


def test_clean_texts_that_share_an_id_with_a_leaked_one_stay(spark):
    items = spark.createDataFrame([(1, TEXTS[0][1])], "item_id long, text string")
    clean = "a clean text under the same id stays where it is"
    docs = documents(spark, [(1, TEXTS[0][1]), (1, clean), (None, TEXTS[0][1]), (None, clean)])
    assert sorted((str(r.doc_id), r.text) for r in decontaminate.without_items(docs, items).collect()) == [("1", clean), ("None", clean)]
