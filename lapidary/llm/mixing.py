"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the paths (domain, language, source). Each level of the tree divides a node's budget among its children in
proportion to their weights, no child above its capacity (its tokens times the number of epochs). What a short child
leaves over goes to its siblings by weight; only when all of them are full the node itself is short, and its own
siblings share the rest. This is done top-down with the capacity of whole subtrees, as one window sort per level over
sums, with no loop over nodes.

A leaf's budget is taken from seeded epochs: each epoch is the leaf in its own seeded order, whole epochs come first,
and the last one is cut after the last document that fits. The cut is one order value per leaf, found from sums per
slice of the order (its first three hex digits) and a running sum inside the one slice that holds it, so a leaf with a
third of all documents is no single task's work. Documents are then judged one by one against their leaf's cut; texts
are never shuffled. All work is native expressions.

Defined results: null paths are leaves of their own; weights that are not given are 1, weights of 0 give nothing.
Texts without a word (null, empty) have no tokens and are never taken. Rows that agree in id and text share one order
value and are taken or left together. Very long texts are counted whole. An empty table gives an empty result. The row
stands in a struct, so names of other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.common import row_and, written

WORD = r"[^\x20\x09-\x0D]+"
SLICE_DIGITS = 3

#: Production parameters: the domain of each source (others are "other"), the weights of each level, the budget.
DOMAINS = {"web": [f"src{i}" for i in range(10)], "reference": [f"src{i}" for i in range(10, 15)], "books": [f"src{i}" for i in range(15, 20)]}
WEIGHTS = ({"web": 0.5, "reference": 0.3, "books": 0.2}, {"en": 0.6, "de": 0.2, "fr": 0.1, "es": 0.1}, {"src0": 3.0})
EPOCHS = 3


def domain_of(source: Column, domains: Mapping[str, Sequence[str]] = DOMAINS) -> Column:
    found = F.lit("other")
    for name, sources in domains.items():
        found = F.when(source.isin(list(sources)), name).otherwise(found)
    return found


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(column: Column) -> Column:
    """Path part as text; null differs from any text."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def _weight(key: Column, weights: Mapping[str, float]) -> Column:
    found = F.lit(1.0)
    for name, weight in weights.items():
        found = F.when(key == f"={name}", float(weight)).otherwise(found)
    return found


def order_value(seed: int, epoch: Column, doc_id: Column, text_digest: Column) -> Column:
    parts = [F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), text_digest]
    return F.md5(F.concat_ws("|", *parts))


def budgets(leaves: DataFrame, levels: int, weights: Sequence[Mapping[str, float]], share: float, epochs: int) -> DataFrame:
    """Adds ``budget`` to ``k0 .. k(levels-1), tokens``; the total is ``share`` of all tokens."""
    names = [f"k{i}" for i in range(levels)]
    granted = leaves.agg((F.sum("tokens") * share).alias("budget"))
    for level in range(levels):
        above, path = names[:level], names[: level + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).cast("double").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(F.col(names[level]), weights[level])).filter("weight > 0")
        if above:
            nodes = nodes.join(granted, above)
        else:  # one row: the total
            nodes = nodes.withColumn("budget", granted.scalar())
        siblings = Window.partitionBy(*above).orderBy("fill", names[level])
        before = siblings.rowsBetween(Window.unboundedPreceding, -1)
        onward = siblings.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        everyone = siblings.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        filled = nodes.withColumn("fill", F.col("capacity") / F.col("weight")).withColumn(
            "rate", (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
        )
        rate = F.first(F.when(F.col("rate") <= F.col("fill"), F.col("rate")), ignorenulls=True).over(everyone)
        granted = filled.withColumn("rate", rate).select(
            *path, F.least("capacity", F.coalesce(F.col("rate") * F.col("weight"), F.col("capacity"))).alias("budget")
        )
    return leaves.join(granted, names).withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("long"))


def cuts(sizes: DataFrame, leaves: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Per leaf: ``full`` epochs and ``cut``, the last order value that is taken of the next epoch (null: none)."""
    plan = leaves.withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn(
        "rest", F.col("budget") - F.col("full") * F.col("tokens")
    )
    partial = sizes.join(plan.select(*names, "full", "rest"), names)
    partial = partial.withColumn("order", order_value(seed, F.col("full") + 1, F.col("doc_id"), F.col("digest")))
    partial = partial.withColumn("slice", F.substring("order", 1, SLICE_DIGITS))
    slices = partial.groupBy(*names, "slice", "rest").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*names).orderBy("slice")
    placed = slices.withColumn("through", F.sum("n").over(running))
    whole = placed.filter("through <= rest").groupBy(*names).agg(F.max("slice").alias("whole_slice"))
    split = placed.filter("through > rest and through - n < rest").select(*names, "slice", (F.col("through") - F.col("n")).alias("before"))
    inside = Window.partitionBy(*names, "slice").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = partial.join(split, [*names, "slice"]).withColumn("sum", F.col("before") + F.sum("n_tokens").over(inside))
    last = taken.filter("sum <= rest").groupBy(*names).agg(F.max("order").alias("last"))
    # A whole slice is taken up to its last possible order value.
    found = plan.join(whole, names, "left").join(last, names, "left")
    top = F.concat(F.col("whole_slice"), F.lit("g"))
    return found.select(*names, "tokens", "budget", "full", F.coalesce("last", top).alias("cut"))


def mixed(
    docs: DataFrame,
    paths: Sequence[Column],
    weights: Sequence[Mapping[str, float]] = WEIGHTS,
    share: float = 0.8,
    epochs: int = EPOCHS,
    seed: int = 11,
) -> DataFrame:
    """``row`` (all columns of ``docs``), the path ``p0 ..``, ``n_tokens`` and ``epoch``: a row for each time taken.

    ``docs`` has ``doc_id, text``; ``paths`` are the levels from the root; ``share`` of all tokens is the budget.
    """
    names = [f"k{i}" for i in range(len(paths))]
    keys = {n: _key(p) for n, p in zip(names, paths)}
    shown = {f"p{i}": p for i, p in enumerate(paths)}
    rows = row_and(
        docs, **shown, **keys, doc_id=F.col("doc_id"), n_tokens=n_tokens(F.col("text")), digest=F.md5(F.coalesce("text", F.lit("")))
    ).filter("n_tokens > 0")
    sizes = written(rows.select(*names, "doc_id", "n_tokens", "digest"), "sizes")
    leaves = written(sizes.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    granted = written(budgets(leaves, len(names), weights, share, epochs), "budgets")
    limits = written(cuts(sizes, granted, names, seed), "cuts")
    order = order_value(seed, F.col("full") + 1, F.col("doc_id"), F.col("digest"))
    times = F.col("full") + F.coalesce((order <= F.col("cut")).cast("int"), F.lit(0))
    judged = rows.join(limits, names).withColumn("times", times).filter("times > 0")
    return judged.select("row", *shown, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"))
