from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from lapidary.llm import line_crf
from cases import LONG, TEXTS, documents, empty


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    texts = [t for _, t in TEXTS] + [LONG + "\n" + LONG[:5000], "#*$%&|<>!", "\n\n", "a\n\na\n a\na", "a b c d e f g h " * 2, "é\x0bü\x0c#ß\r\nx\x85y"]
    texts += ["".join(rng.choice("ab \n#é\t") for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in texts:
        base, rows, words, features = line_crf.measure(text)
        assert base == brute_base(text), repr(text)[:200]
        lines = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate((text or "").split("\n"))]
        assert list(zip(rows, words)) == [x for x in lines if x[1]]
        assert features.shape == (len(rows), line_crf.FEATURES) and np.isfinite(features).all()


def test_viterbi_and_expectations_equal_enumeration():
    rng = np.random.default_rng(0)
    for length in range(1, 8):
        scores, chain = rng.normal(size=length) * 2, rng.normal(size=(2, 2))
        paths = list(itertools.product((0, 1), repeat=length))
        value = lambda p: sum(s for s, y in zip(scores, p) if y) + sum(chain[a, b] for a, b in zip(p, p[1:]))
        assert tuple(line_crf.viterbi(scores, chain)) == max(paths, key=value)
        weights = np.exp([value(p) for p in paths])
        weights /= weights.sum()
        there = np.array([[True] * length + [False] * 2])
        lines, moves = line_crf._expected(np.concatenate([scores, [9.0, 9.0]])[None], there, chain, np.ones(1))
        assert np.allclose(lines[0, :length], (np.array(paths) * weights[:, None]).sum(axis=0))
        wanted = np.zeros((2, 2))
        for p, w in zip(paths, weights):
            for a, b in zip(p, p[1:]):
                wanted[a, b] += w
        assert np.allclose(moves, wanted)


def test_field_tells_boilerplate_from_content():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(6, 14))) + "."
    bad = lambda: " | ".join(word().upper() for _ in range(4))
    documents = [(line_crf.measure("\n".join(good() for _ in range(8)))[3], 1) for _ in range(60)]
    documents += [(line_crf.measure("\n".join([good(), *(bad() for _ in range(8))]))[3], 0) for _ in range(60)]
    model = line_crf.fit(documents)
    mixed = line_crf.measure("\n".join([bad(), bad(), *(good() for _ in range(5)), bad()]))[3]
    assert line_crf.viterbi(mixed @ model["weights"], model["chain"]) == [0, 0, 1, 1, 1, 1, 1, 0]
    assert line_crf.fit(documents[:60]) is None


@pytest.fixture(scope="module")
def held_out(spark):
    """Judged on the labels that the fit did not see."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = line_crf.train(docs, labels.filter("doc_id % 2 = 0"))
    unseen = labels.filter("doc_id % 2 = 1").withColumnRenamed("doc_id", "i")
    judged = line_crf.judge(docs, model)
    judged = judged.join(unseen, judged["row.doc_id"] == unseen["i"])
    return judged.select("quality", "base_failed", "kept").collect()


def test_held_out_accuracy(held_out):
    good = [r.kept for r in held_out if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in held_out if r.quality == 0 and not r.base_failed]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.1


def test_defined_cases(spark):
    docs = documents(spark)
    rows = line_crf.judge(docs, None).collect()
    assert len(rows) == len(TEXTS) and set(rows[0].row.asDict()) == set(docs.columns)
    by_id = {r.row.doc_id: r for r in rows}
    assert by_id[3].base_failed and by_id[3].content_share == 0 and not by_id[4].kept and by_id[6].content_share == 1
    assert line_crf.judge(empty(spark), None).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_crf.train(docs, none) is None
    assert line_crf.train(empty(spark), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], none.schema)) is None


def test_words_that_swap_bytes_256_apart_are_different():
    first = "b" + "a" * 255 + "c" + "a" * 256
    second = "c" + "a" * 255 + "b" + "a" * 256
    text = " ".join(["x"] * 7 + [first] + ["x"] * 7 + [second])
    assert line_crf.measure(text)[0][4] == 0
    assert line_crf.measure(text + " " + text)[0][4] == 32


def test_repeats_of_long_random_words_equal_brute_force():
    draw = random.Random(9)
    for _ in range(60):
        pool = ["".join(draw.choices("ab", k=draw.choice([1, 2, 300, 700]))) for _ in range(3)]
        words = draw.choices(pool, k=draw.randrange(170))
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        assert line_crf.measure(" ".join(words))[0][4] == len(inside)
