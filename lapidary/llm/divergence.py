"""Source divergence audit on run-length columns.

Each language has a vocabulary, each (language, source) group a column of counts over it. The vocabulary is reordered
so that terms with equal counts stand together, cut into blocks of contiguous terms, and every group's column of a
block is run-length encoded. Two groups are compared by intersecting their run boundaries: within a common run the
difference of their smoothed shares is one number, which is multiplied by the run's length. Blocks are independent and
their sums exact, so a language of any size is spread over as many tasks as it has blocks.

Shares are integers, parts of ``SCALE``: ``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))`` with N the count of
all kept terms in the group and V their number. Python integers or decimals are used where products pass 64 bits.

Bounds: a task that reads texts keeps at most ``ENTRIES`` counters beside those of one text; a block has about ``CELLS``
counts of terms and one row for each group of its language. The result holds each ordered pair of groups of a
language, since that is what is asked for; nothing larger is made on the way.

Defined results: null text, lang and source count as empty strings; empty and blank texts have no terms, but their
group is there. A language without kept terms has pairs of value 0. Repeated rows and repeated ids count as often as
they stand there. Ties in value go by item in UTF-8 order. Very long texts are read whole. An empty table gives an
empty result. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.common import written

MIN_DOCUMENTS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
ENTRIES, CELLS = 300_000, 1 << 19

#: Bytes of terms: letters, A-Z as a-z, and all bytes of characters beyond ASCII; every other byte is a blank.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def _counted(batches):
    """Partial counts of (lang, source, term): occurrences and documents."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def rows():
        for (lang, source), (n, docs) in counts.items():
            size = len(n)
            columns = [
                pa.array([lang] * size, pa.string()),
                pa.array([source] * size, pa.string()),
                pa.array(list(n), pa.binary()).cast(pa.string()),
                pa.array(list(n.values()), pa.int64()),
                pa.array([docs[term] for term in n], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for text, lang, source in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "source")]):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            terms = terms_of(text)
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            entries += len(n) - before
            if entries > ENTRIES:
                yield from rows()
                counts, entries = {}, 0
    yield from rows()


def columns_of(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(terms, groups): lang, term, cells (source, n) of each kept term; lang, source, total, vocabulary of each group."""
    texts = docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    partial = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A term has at most one row for each source here.
    term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("docs", F.sum("docs").over(term)).filter(F.col("docs") >= min_documents)
    terms = written(kept.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells")), "terms")
    sums = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    return terms, written(groups.na.fill(0, ["total", "vocabulary"]), "groups")


def share(counts: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """p of each count; numpy where products fit 64 bits, else Python integers."""
    if (int(counts.max(initial=0)) + PRIOR) * SCALE < 1 << 62:
        return 1 + (counts.astype(np.int64) + PRIOR) * SCALE // (total + PRIOR * vocabulary)
    return np.array([1 + (int(c) + PRIOR) * SCALE // (total + PRIOR * vocabulary) for c in counts], np.int64)


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, values) of the runs of equal numbers in a column."""
    first = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1]) if len(column) else np.zeros(0, int)
    return first, column[first]


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of absolute differences of two run-length columns of ``size`` rows."""
    first = np.union1d(a[0], b[0])
    left = a[1][np.searchsorted(a[0], first, "right") - 1]
    right = b[1][np.searchsorted(b[0], first, "right") - 1]
    return int((np.abs(left - right) * np.diff(first, append=size)).sum())


def _compared(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """All pairs of groups in one block."""
    rows = sorted(zip(*[groups.column(c).to_pylist() for c in ("source", "total", "vocabulary")]))
    names = [r[0] for r in rows]
    size = terms.num_rows
    encoded = []
    if size:
        terms = terms.sort_by("place")
        cells = terms.column("cells").combine_chunks()
        place = np.repeat(np.arange(size), np.diff(cells.offsets.to_numpy()))
        flat = cells.flatten()
        owner = flat.field("owner").to_numpy(zero_copy_only=False)
        n = flat.field("n").to_numpy(zero_copy_only=False)
        order = np.argsort(owner, kind="stable")
        # Owners are numbered by the size of the group; names settle which group a number stands for.
        numbers = dict(zip(groups.column("source").to_pylist(), groups.column("owner").to_pylist()))
        limits = {name: np.searchsorted(owner[order], [numbers[name], numbers[name] + 1]) for name in names}
        for name, total, vocabulary in rows:
            mine = order[slice(*limits[name])]
            column = np.zeros(size, np.int64)
            column[place[mine]] = n[mine]
            first, values = runs(column)
            encoded.append((first, share(values, total, vocabulary)))
    pairs = [(a, b, distance(encoded[i], encoded[i + 1 + j], size) if size else 0) for i, a in enumerate(names) for j, b in enumerate(names[i + 1 :])]
    lang = key[0].as_py()
    columns = [pa.array([lang] * len(pairs), pa.string())]
    columns += [pa.array([p[i] for p in pairs], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
    return pa.Table.from_arrays(columns, ["lang", "a", "b", "value"])


def pair_values(terms: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """lang, source, item, value for each ordered pair of sources of a language."""
    # Small groups first: their columns are mostly zeros, so sorting by them makes the longest runs. Only the groups of
    # one language, as many as its part of the result has rows for one source, are numbered in one window.
    numbered = groups.withColumn("owner", F.row_number().over(Window.partitionBy("lang").orderBy("total", "source")))
    numbered = written(numbered, "numbered")
    flat = terms.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.*")
    sparse = flat.join(numbered.select("lang", "source", "owner"), ["lang", "source"])
    vectors = sparse.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("owner", "n"))).alias("cells"))
    blocks = max(1, -(-flat.count() // cells))
    keys = ["lang", "cells", "term"]
    ordered = vectors.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    laid = written(
        ordered.select("lang", "cells", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place")),
        "laid",
    )
    # Every language has a block without terms, so that its pairs are there in any case.
    spots = laid.select("lang", "block").distinct().unionByName(groups.select("lang", F.lit(-1).alias("block")).distinct())
    sides = numbered.join(spots, "lang").select(*numbered.columns, F.col("block").alias("spot"))
    found = laid.groupBy("lang", "block").cogroup(sides.groupBy("lang", "spot")).applyInArrow(_compared, "lang string, a string, b string, value long")
    sums = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each term of a group whose share there is above its share in the language."""
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    whole = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    cells = terms.select("lang", "term", whole.alias("lang_n"), F.explode("cells").alias("c")).select("lang", "term", "lang_n", "c.*")
    joined = cells.join(groups, ["lang", "source"]).join(langs, "lang")

    def p(count: str, total: str):
        return F.expr(f"1 + cast({SCALE} as decimal(18,0)) * cast({count} + {PRIOR} as decimal(19,0)) div ({total} + {PRIOR} * vocabulary)")

    value = p("n", "total") - p("lang_n", "lang_total")
    return joined.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources are apart, and the terms that set each apart from its language."""
    terms, groups = columns_of(docs, min_documents)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(terms, groups).withColumn("rank", F.row_number().over(order))
    tops = term_values(terms, groups).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(names).unionByName(tops.withColumn("part", F.lit("term")).select(names))
