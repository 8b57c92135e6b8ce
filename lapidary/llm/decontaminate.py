"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by the power of two of their number of distinct five-word shingles. An item's bottom-k
MinHash sketch are its k least shingle hashes. A document that holds at least ``share`` of an item lacks at most
``n - ceil(share n)`` of its shingles, so with k one above the largest such number in the item's partition at least
one sketch value is in the document: no item is missed, whatever the document's length. A document of fewer shingles
than the partition's least allowed overlap is not searched for it. Bottom-k values are small by construction: of
each document only the hashes up to the partition's largest sketch value are looked up, which spares most of them.

Candidates are then verified by the shingles themselves, as text. All work is native expressions.

Defined results: words are runs of letters and digits in lower case; a text of one to four words is one shingle, a
text without words (null, empty) has none and neither contains nor is contained. Repeated rows give one result row
per document id and item; several texts under one id are searched apart. Null ids are found like others. Very long texts
are searched whole. Items of equal text under several ids are found under each. An empty table on either side gives an
empty result. Only ids and texts are read, and rows that are kept stand in a struct, so names of other columns cannot
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import row_and, written

WIDTH = 5
SHARE = 0.8
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _starts(listed: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(listed) - width, F.lit(0)))


def with_shingle_hashes(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds ``h``, the distinct hashes of the shingles of ``text``, as hashes of word hashes; drops ``text``."""
    hashed = df.withColumn("w", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    listed = F.col("w")
    hashes = F.transform(_starts(listed, width), lambda i: F.xxhash64(*[F.get(listed, i + j) for j in range(width)]))
    some = F.when(F.size(listed) > 0, hashes).otherwise(F.array().cast("array<long>"))
    return hashed.withColumn("h", F.array_distinct(some)).drop("w")


def shingles(listed: Column, width: int = WIDTH) -> Column:
    texts = F.transform(_starts(listed, width), lambda i: F.array_join(F.slice(listed, i + 1, width), " "))
    return F.when(F.size(listed) > 0, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, share: float = SHARE) -> DataFrame:
    """``item_id, part, least_size, hash``: the sketch values of a table ``item_id, text``."""
    hashed = with_shingle_hashes(items.select("item_id", "text")).withColumn("h", F.array_sort("h"))
    n, part = F.size("h"), F.col("part")
    upper = (F.pow(F.lit(2), part + 1) - 1).cast("int")
    # 1e-9 keeps 0.8 * 5 at 4.
    k = upper - F.ceil(upper * share - 1e-9) + 1
    return (
        hashed.filter(n > 0)
        .withColumn("part", F.floor(F.log2(n)).cast("int"))
        .select(
            "item_id",
            "part",
            F.ceil(F.pow(F.lit(2), part) * share - 1e-9).cast("int").alias("least_size"),
            F.explode(F.slice("h", F.lit(1), k.cast("int"))).alias("hash"),
        )
    )


def candidates(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, copy, item_id``; ``copy`` is a hash of the document's text."""
    sketch = written(sketches(items, share), "sketches")
    # One row for each power of two of the items' sizes: never more than 32.
    parts = sketch.groupBy("part", "least_size").agg(F.max("hash").alias("top")).orderBy("part").collect()
    if not parts:
        return docs.join(items.select("item_id"), F.lit(False), "left_semi").select(
            "doc_id", F.xxhash64("text").alias("copy"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")
        )
    hashed = with_shingle_hashes(docs.select("doc_id", F.xxhash64("text").alias("copy"), "text"))
    size = F.size("h")
    limit = F.lit(None).cast("long")
    for p in parts:
        limit = F.greatest(limit, F.when(size >= p.least_size, F.lit(p.top)))
    reached = hashed.withColumn("size", size).withColumn("top", limit)
    low = reached.select("doc_id", "copy", "size", F.explode_outer(F.expr("filter(h, x -> x <= top)")).alias("hash"))
    return low.join(sketch, "hash").filter("size >= least_size").select("doc_id", "copy", "item_id").distinct()


def _verified(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """``doc_id, own, item_id, n_item, n_shared`` of all items held to at least ``share``; ``own`` is a hash of the text."""
    found = written(candidates(docs, items, share), "candidates").withColumnRenamed("doc_id", "found_id")
    texts = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    # The written pairs have a known size, so the texts are shuffled only where the pairs are too many to send around.
    pairs = texts.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("own") == F.col("copy")))
    item_words = items.select(F.col("item_id").alias("key"), words(F.col("text")).alias("iw"))
    item_shingles = item_words.select("key", shingles(F.col("iw")).alias("item"))
    held = pairs.select("doc_id", "own", "item_id", words(F.col("text")).alias("w")).select(
        "doc_id", "own", "item_id", shingles(F.col("w")).alias("doc")
    )
    compared = held.join(item_shingles, F.col("item_id").eqNullSafe(F.col("key"))).select(
        "doc_id",
        "own",
        "item_id",
        F.size("item").cast("long").alias("n_item"),
        F.size(F.array_intersect("item", "doc")).cast("long").alias("n_shared"),
    )
    return compared.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * share - 1e-9))


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of all items held to at least ``share``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``.
    """
    return (
        _verified(docs, items, share).groupBy("doc_id", "item_id")
        .agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("best"))
        .select(
            "doc_id", "item_id", "best.n_item", "best.n_shared",
            F.round(F.col("best.n_shared") / F.col("best.n_item"), 6).alias("containment"),
        )
    )


def without_items(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns; texts under one id are judged apart."""
    found = _verified(docs, items, share).select(F.col("doc_id").alias("leaked_id"), F.col("own").alias("leaked_copy"))
    leaked = written(found.distinct(), "leaked")
    rows = row_and(docs, id=F.col("doc_id"), copy=F.xxhash64("text"))
    same = F.col("id").eqNullSafe(F.col("leaked_id")) & (F.col("copy") == F.col("leaked_copy"))
    return rows.join(leaked, same, "left_anti").select("row.*")
