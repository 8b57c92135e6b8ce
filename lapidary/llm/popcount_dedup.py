"""SimHash near-duplicates by segment bit counts.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints. At most three differing bits therefore leave one
half of the vector (16 segments) at Manhattan distance one or less, so a grid range-join of the halves finds all
links: a fingerprint stands in the cell of each half, and looks into that cell and the cells one step up in one
segment; the pairs one step down are found from the other side. Pairs are then cut by the distance of the whole
vectors, which is one bit count of the counts written in steps, and those left are verified by their bits.

Equal fingerprints are one node, so exact copies, of whatever number, make no pairs; cells are join keys that the
runtime splits when they are hot. Links and components stay distributed tables.

Defined results: texts without a word (null, empty, blank) have fingerprint zero and are linked like any other; a
repeated row has the same component. A component's id is the least non-null id in it; null ids are kept. A bit set in
just half of the hashes is zero. Very long texts are read whole. An empty table gives an empty result. Other columns
stand in a struct or are not read, so their names cannot clash.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import row_and, written
from lapidary.llm.components import components

MAX_BITS = 3
HALF_SEGMENTS = 16
PAIRS = 0x55555555
#: The lower bit of each two-bit segment.
LOW_BITS = 0x5555555555555555

_digest = partial(xxhash.xxh64_digest, seed=42)


def simhash(text: str | None, width: int = 3) -> int:
    """Bit set where over half of the shingle hashes have it; bytes.split knows exactly the blanks of the word rule."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    bits = np.unpackbits(np.frombuffer(b"".join(map(_digest, shingles)), np.uint8).reshape(-1, 8), axis=1)
    ones = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits))
    return int(ones.view(">i8")[0])


def fingerprints(texts: DataFrame) -> DataFrame:
    """``fingerprint`` (signed long) in the place of ``text``, beside ``id`` and any other columns."""
    keyed = texts.select(F.struct(*[c for c in texts.columns if c != "text"]).alias("key"), "text")

    def run(batches):
        for batch in batches:
            prints = pa.array(map(simhash, batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), prints], ["key", "fingerprint"])

    key_type = keyed.schema["key"].dataType.simpleString()
    return keyed.mapInArrow(run, f"key {key_type}, fingerprint long").select("key.*", "fingerprint")


def _counts(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of a 32-bit value, each in the place of its segment."""
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(PAIRS)


def _halves(fingerprint: Column) -> list[Column]:
    return [fingerprint.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(fingerprint, 32)]


def _steps(fingerprint: Column) -> Column:
    """The bit counts of all 32 segments in steps: 0, 1 and 2 as 00, 01 and 11."""
    other = F.shiftrightunsigned(fingerprint, 1)
    low = fingerprint.bitwiseOR(other).bitwiseAND(LOW_BITS)
    return low.bitwiseOR(F.shiftleft(fingerprint.bitwiseAND(other).bitwiseAND(LOW_BITS), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of the bit counts of two fingerprints: the bits in which their steps differ."""
    return F.bit_count(_steps(a).bitwiseXOR(_steps(b)))


def within(pairs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs of the grid whose whole vectors are near enough; what is left is compared by bits."""
    return pairs.filter(manhattan(F.col("a"), F.col("b")) <= max_bits)


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` of fingerprints at one to ``max_bits`` differing bits, each at least once; ``nodes`` are distinct."""
    if max_bits > 3:
        raise ValueError("two halves cover at most three bits")
    f = F.col("fingerprint")
    cells, looks = [], []
    for half, value in enumerate(map(_counts, _halves(f))):
        name = F.lit(half).alias("half")
        cells.append(F.struct(name, value.alias("cell")))
        looks.append(F.struct(name, value.alias("cell"), F.lit(0).alias("step")))
        for i in range(HALF_SEGMENTS):
            room = F.shiftrightunsigned(value, 2 * i).bitwiseAND(3) < 2
            looks.append(F.when(room, F.struct(name, (value + (1 << 2 * i)).alias("cell"), F.lit(1).alias("step"))))
    standing = nodes.select(f.alias("b"), F.explode(F.array(*cells)).alias("at")).select("b", "at.half", "at.cell")
    looking = nodes.select(f.alias("a"), F.explode(F.array_compact(F.array(*looks))).alias("at")).select("a", "at.*")
    met = looking.join(standing, ["half", "cell"]).filter("step = 1 or a < b")
    near = within(met, max_bits).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(texts: DataFrame, max_bits: int) -> DataFrame:
    """``fingerprint, component_id, least`` beside the columns but ``text``; ``least`` is the component's least fingerprint."""
    prints = written(fingerprints(texts), "fingerprints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "nodes")
    stars = components(links(nodes, max_bits))
    tied = nodes.join(stars, nodes.fingerprint == stars.node, "left").select(
        "fingerprint", "first", F.coalesce("least", "fingerprint").alias("least")
    )
    several = stars.select("least").distinct()
    of_component = tied.join(several, "least", "left_semi").groupBy("least").agg(F.min("first").alias("component_id"))
    named = tied.join(of_component, "least", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"), "least")
    return prints.join(named, "fingerprint")


def near_duplicates(texts: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``id, fingerprint, component_id`` of a table ``id, text``, a row for each row."""
    return _grouped(texts.select("id", "text"), max_bits).select("id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of each component's least id, once each; rows without an id are kept, as no group can name them.

    Texts under one id are told apart by their hash: each stands in its own component, and of those of one component
    and of repeated rows one stays.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("copy", F.xxhash64("text"))
    least = _grouped(texts, MAX_BITS).filter("id = component_id").groupBy("id", "least").agg(F.min("copy").alias("kept_copy"))
    kept = written(least.select(F.col("id").alias("kept_id"), "kept_copy").distinct(), "kept")
    rows = row_and(docs, id=F.col(id_column), copy=F.xxhash64(F.col(text_column)))
    same = (F.col("id") == F.col("kept_id")) & (F.col("copy") == F.col("kept_copy"))
    named = rows.filter("id is not null").join(kept, same, "left_semi")
    ties = named.groupBy("id", "copy").agg(F.first("row").alias("row"))
    return ties.select("row.*").unionByName(rows.filter("id is null").select("row.*"))
