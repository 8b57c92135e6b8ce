"""Content identities, seeds and multiset digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_id(thinker_qid: Column, text: Column) -> Column:
    return F.sha2(F.concat(thinker_qid, F.lit("|"), text), 256)


def occurrence_id(quote: Column, category: Column, work: Column, revision: Column, url: Column) -> Column:
    """Null as soon as one required part is null, hence ``concat`` and not ``concat_ws``."""
    bar = F.lit("|")
    return F.sha2(
        F.concat(quote, bar, category, bar, F.coalesce(work, F.lit("")), bar, revision.cast("string"), bar, url), 256
    )


def selection_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(part, F.lit("")) for part in parts])


def seed(key: Column) -> Column:
    """First eight bytes of SHA-256 as an unsigned big-endian integer."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seeded_index(seed_value: Column, size: Column) -> Column:
    return F.pmod(seed_value, size.cast("decimal(20,0)")).cast("long")


def row_digest(label: str, fields: Sequence[Column]) -> Column:
    """SHA-256 of a row; length prefixes keep neighbouring fields and nulls apart."""
    encoded = [F.lit(label)]
    for field in fields:
        value = field.cast("string")
        encoded.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("~")))
    return F.sha2(F.concat(*encoded), 256)


def digest_sums(digest: Column) -> list[Column]:
    """Order-free aggregates of row digests: four sums of 60-bit parts and the row count.

    Sums of parts combine map-side and never bring rows together, unlike a
    sorted hash chain over the whole table.
    """
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).alias(f"part_{i}")
        for i in range(4)
    ]
    return [F.count(F.lit(1)).alias("row_total"), *parts]


def digest_of_sums(prefix: str = "") -> Column:
    names = ["row_total"] + [f"part_{i}" for i in range(4)]
    values = [F.coalesce(F.col(name).cast("decimal(38,0)"), F.lit(0)).cast("string") for name in names]
    return F.sha2(F.concat_ws("|", F.lit(prefix), *values), 256)
