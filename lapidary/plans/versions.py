"""Differences of two versions of a table by a tree of digests.

Rows are digested and summed per leading digits of their key, and the sums again per shorter digits, up to one sum for
the whole table: a Merkle tree over digest prefixes whose sums do not depend on the order of rows. Two versions are
compared from the top; a branch with equal sums is not entered, and rows are read only in the leaves that differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions import ids
from lapidary.session import reused

#: Digits of a leaf, and differing leaves up to which the scan is told their ranges.
LEAF_DIGITS, PUSHED_LEAVES = 4, 200
_SUMS = ["row_total", *(f"part_{i}" for i in range(4))]


def _prefix(key: str, digits: Column | int) -> Column:
    return F.substring(F.coalesce(F.col(key), F.lit("")), F.lit(1), F.lit(digits) if isinstance(digits, int) else digits)


def _digest(fields: Sequence[str]) -> Column:
    return ids.row_digest("row", [F.col(c) for c in fields])


def digest_tree(rows: DataFrame, key: str, fields: Sequence[str], digits: int = LEAF_DIGITS) -> DataFrame:
    """level, prefix, sums: a row for each prefix of 0 to ``digits`` digits that a key begins with.

    Rows are summed per leaf map-side; the upper levels are sums of leaves, at most ``16 ** digits`` of them.
    """
    leaves = rows.select(_prefix(key, digits).alias("leaf"), _digest(fields).alias("digest")).groupBy("leaf").agg(*ids.digest_sums(F.col("digest")))
    levels = leaves.select("*", F.explode(F.sequence(F.lit(0), F.lit(digits))).alias("level"))
    placed = levels.withColumn("prefix", F.substring("leaf", F.lit(1), F.col("level")))
    return placed.groupBy("level", "prefix").agg(*[F.sum(c).alias(c) for c in _SUMS])


def differing_leaves(old: DataFrame, new: DataFrame, digits: int = LEAF_DIGITS) -> DataFrame:
    """Prefixes of the leaves in which two trees differ, found from the top; only children of differing nodes are compared."""
    differing = old.sparkSession.range(1).select(F.lit("").alias("prefix"))
    for level in range(digits + 1):
        sides = [tree.filter(F.col("level") == level) for tree in (old, new)]
        if level:
            parent = differing.select(F.col("prefix").alias("parent"))
            sides = [
                side.withColumn("parent", F.substring("prefix", 1, level - 1)).join(parent, "parent", "left_semi").drop("parent")
                for side in sides
            ]
        both = sides[0].unionByName(sides[1]).groupBy("prefix", *_SUMS).agg(F.count(F.lit(1)).alias("trees"))
        differing = reused(both.filter("trees = 1").select("prefix").distinct())
    return differing


def rows_in(rows: DataFrame, key: str, leaves: DataFrame, digits: int = LEAF_DIGITS) -> DataFrame:
    """Rows whose key begins with one of the leaves; a few leaves become ranges of the key, which prune files."""
    few = [row.prefix for row in leaves.limit(PUSHED_LEAVES + 1).collect()]
    if not few:
        return rows.limit(0)
    if len(few) <= PUSHED_LEAVES:
        inside = F.lit(False)
        for prefix in few:
            # "g" is after all digits.
            inside = inside | ((F.col(key) >= prefix) & (F.col(key) < prefix + "g") if len(prefix) == digits else _prefix(key, digits) == prefix)
        return rows.filter(inside)
    return rows.withColumn("_leaf", _prefix(key, digits)).join(leaves.select(F.col("prefix").alias("_leaf")), "_leaf", "left_semi").drop("_leaf")


def version_difference(
    old: DataFrame,
    new: DataFrame,
    key: str,
    fields: Sequence[str],
    trees: tuple[DataFrame, DataFrame] | None = None,
    digits: int = LEAF_DIGITS,
) -> DataFrame:
    """(key, change): rows that were added, removed or changed between two versions; keys are digests without repeats.

    ``trees``: the stored trees of both versions (``digest_tree``), else they are made here. Rows without a key are
    compared as a set of their own.
    """
    old_tree, new_tree = trees or (reused(digest_tree(old, key, fields, digits)), reused(digest_tree(new, key, fields, digits)))
    leaves = differing_leaves(old_tree, new_tree, digits)
    before = rows_in(old, key, leaves, digits).select(F.col(key).alias("_old"), _digest(fields).alias("_was"))
    after = rows_in(new, key, leaves, digits).select(key, _digest(fields).alias("_is"))
    both = before.join(after, F.col("_old").eqNullSafe(F.col(key)) & (F.col(key).isNotNull() | (F.col("_was") == F.col("_is"))), "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_was") != F.col("_is"), "changed")
    return both.select(F.coalesce(key, "_old").alias(key), change.alias("change")).filter("change is not null")
