"""URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact join.

The filter is split into blocks of eight 64-bit words; a key sets one bit in each word of one block. It is built by
one aggregation and kept as a table of at most ``max_blocks`` rows, the only table that is broadcast. URLs that pass
it go to an exact join with the list, so the filter's false positives never show. All work is native expressions.

Defined results: null URLs and URLs without ``://`` have empty host and path, no rule and no canonical form, and
are allowed. Repeated list entries count once; repeated pages are judged one by one. Very long URLs are compared whole;
of rules that fit the longest wins. An empty list blocks nothing, an empty table gives an empty result. The row stands
in a struct, so names of other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import lower_ascii, row_and, written

WORDS = 8
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, sorted parameters without ``utm_``; no scheme, no fragment."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_")))
    parameters = F.array_join(F.array_sort(kept), "&")
    place = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(place, F.when(parameters != "", F.concat(F.lit("?"), parameters)).otherwise("")))


def matching_rule(host_column: Column, path_column: Column, rules: Sequence[tuple[str, str, str]], what: int) -> Column:
    """The longest fitting rule: its text (``what`` 1) or its verdict (``what`` 0); null if none fits."""
    found = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        on_host = (host_column == rule_host) | F.endswith(host_column, F.lit("." + rule_host))
        fits = on_host & F.startswith(path_column, F.lit(rule_path))
        found = F.when(fits, F.lit(verdict if what == 0 else rule_host + rule_path)).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit of each of the eight words."""
    second = F.xxhash64(F.lit(1), key)
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """``block``, ``w0`` to ``w7`` of a one-column table of keys."""
    key = F.col(keys.columns[0])
    return (
        keys.select(_block(key, blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(key))])
        .groupBy("block")
        .agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def judge(
    pages: DataFrame,
    listed: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    keys_per_block: int = 32,
    max_blocks: int = 1 << 18,
) -> DataFrame:
    """Struct ``row`` of all columns of ``pages`` with host, path, rule, verdict and listed.

    ``listed`` has a column ``url``. The filter has a block for each ``keys_per_block`` listed keys, at most
    ``max_blocks`` (64 bytes each: 16 MB); a longer list makes it pass more rows to the exact join, nothing else.
    """
    keys = written(listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct(), "listed")
    blocks = min(max_blocks, max(1, -(-keys.count() // keys_per_block)))
    key = canonical(F.col(f"`{url}`"))
    probes = row_and(pages, host=host(F.col(f"`{url}`")), path=path(F.col(f"`{url}`")), key=key, block=_block(key, blocks))
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    passed = F.coalesce(hit & F.col("key").isNotNull(), F.lit(False))
    # Bounded: at most max_blocks rows of 64 bytes.
    probed = probes.join(F.broadcast(bloom_filter(keys, blocks)), "block", "left").select(
        "row", "host", "path", "key", passed.alias("possible")
    )
    possible = probed.filter("possible").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    columns = ["row", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")]
    both = possible.select(*columns).unionByName(probed.filter("not possible").withColumn("listed", F.lit(False)).select(*columns))
    by_rule = matching_rule(F.col("host"), F.col("path"), rules, 0)
    return both.select(
        "row",
        "host",
        "path",
        matching_rule(F.col("host"), F.col("path"), rules, 1).alias("rule"),
        F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
