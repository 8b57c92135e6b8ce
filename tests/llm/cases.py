"""Rows with nulls, empty, blank and very long texts, repeated rows and clashing extra columns."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = " ".join(f"long{i % 997} word{i}" for i in range(30_000))
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog for a while today."),
    (2, "The cat sat on the mat and looked at the dog for a while today."),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, LONG),
    (7, "one two"),
    (7, "one two"),
    (None, "a row without an id has words as well"),
    (8, "Ünïcödé WÖRDS, mixed\x85Case and\u00a0blanks!"),
]
#: Extra columns named like the operators' own.
EXTRA = "row id h w key value kept tie found_id component_id digest k0 p0 host label epoch shard".split()


def documents(spark, rows=TEXTS, lang="en", source="src0"):
    made = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return made.select("*", *[F.lit(str(n)).alias(name) for n, name in enumerate(EXTRA)])


def empty(spark):
    return documents(spark).limit(0)
