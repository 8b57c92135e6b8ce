"""Quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of target texts (labelled good) and one of all
texts, give each text the log ratio of its probabilities. Gumbel noise is added and the k largest rows are kept,
which samples k rows without replacement in proportion to the ratio. The raw model counts all documents. The target
model counts the labelled good documents, at most ``sample`` of them by seeded hash (a documented bound).

k is the number of documents times the upper confidence limit of the good share among all labels, so clean text is
not lost to the error of that estimate. The k-th largest value is found by counts per leading bits of the value, in
four passes over the table of values, so nothing is sorted globally and no value list passes through the driver.
Tasks hash and count in numpy and send one row per bucket.

Defined results: null, empty and blank texts have no n-grams and a log ratio of 0. Ties are settled by a hash of
the text; rows that tie in it as well (repeated rows) are kept or dropped together, so k can be exceeded by them. Without labels nothing can be
judged and every row is kept. Very long texts are counted whole. An empty table gives an empty result. The row stands in
a struct, so names of other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapidary.llm.common import first_by, written
from lapidary.llm.wordhash import MIX, window_hashes, word_hashes, word_starts

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SAMPLE = 20_000
#: Rows whose texts a task holds as Python strings at a time.
PART = 256
SEED = 7
#: Values are kept as whole numbers of 2**-20, moved up to be positive; log ratios beyond 2**31 cannot occur.
UNIT, SHIFT, LEVELS = 1 << 20, 1 << 52, (39, 26, 13, 0)


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all words and all pairs of neighbouring words of a text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    hashes = word_hashes(data, word_starts(data))
    return (np.concatenate([hashes * MIX[1], window_hashes(hashes, 2) * MIX[1]]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _parts(batches):
    """Batches cut to ``PART`` rows, so that few texts are held twice."""
    for batch in batches:
        for first in range(0, batch.num_rows, PART):
            yield batch.slice(first, PART)


def _counts(batches):
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in _parts(batches):
        for text, good in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist()):
            buckets = ngram_buckets(text)
            for sums in (raw, target) if good else (raw,):
                np.add.at(sums, buckets, 1)
    seen = np.flatnonzero(raw)
    columns = [pa.array(seen), pa.array(target[seen]), pa.array(raw[seen])]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "target", "raw"])


def log_ratios(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> list[float] | None:
    """Log ratio of target to raw probability per bucket, both smoothed by one; None without good labels."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
    chosen = first_by(good, F.xxhash64(F.lit(seed), "good_id"), sample).select("good_id")
    # Bounded: at most `sample` ids.
    texts = docs.select("doc_id", "text")
    flagged = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("good_id"), "left")
    counts = (
        flagged.select("text", F.col("good_id").isNotNull().alias("target"))
        .mapInArrow(_counts, "bucket long, target long, raw long")
        .groupBy("bucket")
        .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    )
    # Bounded: a row for each bucket.
    target, raw = [0] * BUCKETS, [0] * BUCKETS
    for row in counts.collect():
        target[row.bucket], raw[row.bucket] = row.target, row.raw
    if not sum(target):
        return None
    of_target, of_raw = sum(target) + BUCKETS, sum(raw) + BUCKETS
    return [round(math.log((t + 1) / of_target) - math.log((r + 1) / of_raw), 6) for t, r in zip(target, raw)]


def scored(docs: DataFrame, ratios: list[float], seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, else all), ``log_ratio``, ``value`` (with Gumbel noise, in whole units), ``tie``."""
    model = np.array(ratios)

    def run(batches):
        for batch in _parts(batches):
            sums = [float(model[ngram_buckets(t)].sum()) for t in batch.column("text").to_pylist()]
            columns = [*(batch.column(c) for c in ("row", "doc_id", "tie")), pa.array(sums, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "tie", "log_ratio"])

    names = [F.col(f"`{c}`") for c in keep or docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    out = StructType([rows.schema[c] for c in ("row", "doc_id", "tie")]).add("log_ratio", "double")
    draw = (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "tie"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = rows.mapInArrow(run, out).withColumn("noise", -F.log(-F.log(draw)))
    value = F.round((F.col("log_ratio") + F.col("noise")) * UNIT).cast("long") + SHIFT
    return noisy.select("row", "tie", "log_ratio", value.alias("value"))


def top_limit(values: DataFrame, k: int) -> tuple[int, int]:
    """The least (value, tie) among the k largest rows of ``value, tie``."""
    above, prefix, rest = 0, None, values
    for bits in LEVELS:
        place = F.shiftright("value", bits)
        seen = rest.groupBy(place.alias("p")).count().collect()  # at most 2**14 rows a level
        for row in sorted(seen, key=lambda r: -r.p):
            if above + row["count"] >= k:
                prefix = row.p
                break
            above += row["count"]
        rest = rest.filter(place == prefix)
    if above + rest.count() == k:
        return prefix, (1 << 63) - 1
    ties = rest.select(F.xxhash64("tie").alias("order"))
    low, high = -(1 << 63), (1 << 63) - 1
    while low < high:  # more equal values than places: halve the range of the tie order
        middle = (low + high) // 2
        if above + ties.filter(F.col("order") <= middle).count() >= k:
            high = middle
        else:
            low = middle + 1
    return prefix, low


def good_share(labels: DataFrame) -> float | None:
    """Upper 95 % confidence limit (Wilson) of the share of good rows among the labels."""
    row = labels.filter("quality in (0, 1)").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("p")).first()
    if not row.n:
        return None
    n, p, z = row.n, row.p, 1.96
    return min(1.0, (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    share: float | None = None,
    sample: int = SAMPLE,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, else all), ``log_ratio`` and ``kept``.

    ``docs`` has ``doc_id, text``; ``labels`` has ``doc_id, quality``. ``share`` replaces the share from the labels.
    The values are computed once for the limit and once more beside the rows: that costs less than a shuffle of texts.
    """
    share = good_share(labels) if share is None else share
    ratios = log_ratios(docs, labels, sample, seed) if share is not None else None
    values = ratios and written(scored(docs, ratios, seed, ["doc_id"]).select("value", "tie"), "values")
    n = values.count() if ratios else 0
    if not n:
        names = [F.col(f"`{c}`") for c in keep or docs.columns]
        return docs.select(F.struct(*names).alias("row"), F.lit(0.0).alias("log_ratio"), F.lit(True).alias("kept"))
    value, order = top_limit(values, max(1, math.ceil(n * share)))
    kept = (F.col("value") > value) | ((F.col("value") == value) & (F.xxhash64("tie") <= order))
    return scored(docs, ratios, seed, keep).select("row", "log_ratio", kept.alias("kept"))
