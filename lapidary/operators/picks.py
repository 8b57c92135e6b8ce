"""Positions in an ordered set without sorting the set in one place.

Occurrence identities are hex digests, so their leading digits cut any set into
even slices whose order is known. Counting rows per slice tells which slice holds
a wanted position; only the rows of that slice are ranked. Where the set differs
from request to request, slices are refined level by level, only where wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import ids
from lapidary.session import reused

SLICE_DIGITS = 3
#: Slice of rows without identity: after all digits, so they come last.
LAST = "g"


def slice_of(identity: Column, digits: int = SLICE_DIGITS) -> Column:
    return F.coalesce(F.substring(identity, 1, digits), F.lit(LAST))


def slice_bounds(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each slice (``before``), in it (``rows``) and in all slices of the key (``total``).

    The window runs over counts, at most ``16 ** digits`` rows for a key.
    """
    ordered = Window.partitionBy(*keys).orderBy("slice")
    running = F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("before", running - F.col("rows")).withColumn(
        "total", F.sum("rows").over(Window.partitionBy(*keys))
    )


def page_figures(totals: DataFrame, offset: int, limit: int) -> DataFrame:
    """Figures of the page ``offset .. offset + limit`` for every key of ``totals`` (keys, total), empty pages too."""
    size = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset))
    return totals.select(
        "*",
        size.cast("long").alias("page_count"),
        F.lit(offset).alias("page_offset"),
        F.lit(limit).alias("page_limit"),
        (F.col("total") > offset + limit).alias("has_more"),
    )


def _with_figures(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return page_figures(rows, offset, limit).drop("page_offset", "page_limit")


def page_of(
    rows: DataFrame, keys: list[str], identity: str, offset: int, limit: int, digits: int = SLICE_DIGITS
) -> DataFrame:
    """Rows ``offset .. offset + limit`` of every key in identity order, with ``position`` and page figures.

    Rows without identity come last. Keys without a row on the page have none here; see ``page_figures``.
    """
    sliced = rows.withColumn("slice", slice_of(F.col(identity), digits))
    counts = sliced.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("rows"))
    wanted = slice_bounds(counts, keys).filter(
        (F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)
    )
    same = F.col("slice") == F.col("wanted_slice")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"wanted_{key}"))
    renamed = wanted.drop("rows").withColumnsRenamed({name: f"wanted_{name}" for name in [*keys, "slice"]})
    order = Window.partitionBy(*keys, "slice").orderBy(F.asc_nulls_last(identity))
    ranked = (
        sliced.join(renamed, same)
        .withColumn("position", F.col("before") + F.row_number().over(order) - 1)
        .filter((F.col("position") >= offset) & (F.col("position") < offset + limit))
    )
    return _with_figures(ranked.drop("slice", "before", *[c for c in renamed.columns if c.startswith("wanted_")]), offset, limit)


def page_in_order(rows: DataFrame, page: list[str], order: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit`` of each source page in page order, with page figures.

    The windows cover the rows of one page, which arrived as one record.
    """
    whole = Window.partitionBy(*page)
    numbered = rows.withColumns(
        {
            "position": F.row_number().over(whole.orderBy(order)).cast("long") - 1,
            "total": F.count(F.lit(1)).over(whole),
        }
    )
    on_page = numbered.filter((F.col("position") >= offset) & (F.col("position") < offset + limit))
    return _with_figures(on_page, offset, limit)


#: Digits that one level of the count tree adds, and rows of a node that need no further level.
LEVEL_DIGITS, LEAF_ROWS = 2, 256
#: Length of quotes without a length and limit of requests without a limit: such a quote fits only such a request.
_NO_LIMIT = (1 << 63) - 1
_FILTER = ["scope", "kind", "max_length"]


def _kind(category: Column) -> Column:
    """A category as a key; the empty key stands for every category."""
    return F.concat(F.lit("="), category)


def _children(
    cells: DataFrame, points: DataFrame, members: DataFrame, depth: int
) -> DataFrame:
    """Rows that fit each limit of ``points`` (scope, kind, node, max_length) in each child of its node, in the children
    before it (``before``) and in all (``in_node``).

    ``cells``: thinker_name, category, character_count, occurrence_id; one column of digits, ``depth`` of which name a
    child. Limits meet the lengths in one running count over both, so a child's window has a row for each distinct
    length and limit, never one for each quote, and no limit is compared with each quote or each other limit.
    """
    child = F.substring("occurrence_id", 1, depth)
    node = F.substring("occurrence_id", 1, depth - LEVEL_DIGITS)
    length = F.coalesce(F.col("character_count").cast("long"), F.lit(_NO_LIMIT))
    counted = cells.groupBy(
        "thinker_name", "category", node.alias("node"), child.alias("child"), length.alias("length")
    ).agg(F.count(F.lit(1)).alias("rows"))
    kinds = F.explode(F.array_compact(F.array(F.lit(""), _kind(F.col("category"))))).alias("kind")
    spread = counted.join(members, "thinker_name").select("scope", kinds, "node", "child", "length", "rows")
    nodes = points.select("scope", "kind", "node").distinct()
    place = ["scope", "kind", "node", "child"]
    held = spread.join(nodes, ["scope", "kind", "node"], "left_semi").groupBy(*place, "length").agg(F.sum("rows").alias("rows"))
    asked = held.select(*place).distinct().join(points, ["scope", "kind", "node"])
    both = held.withColumn("asked", F.lit(False)).unionByName(
        asked.select(*place, F.col("max_length").alias("length"), F.lit(0).cast("long").alias("rows"), F.lit(True).alias("asked"))
    )
    # A limit stands after the lengths equal to it.
    running = Window.partitionBy(*place).orderBy("length", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = both.withColumn("rows", F.sum("rows").over(running)).filter("asked").withColumnRenamed("length", "max_length")
    # At most as many rows as a node has children.
    node_rows = Window.partitionBy("scope", "kind", "node", "max_length")
    in_order = node_rows.orderBy("child").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("rows").over(in_order) - F.col("rows")
    return fitting.withColumns({"before": before, "in_node": F.sum("rows").over(node_rows)}).filter("rows > 0").drop("asked")


def pick_by_seed(quotes: DataFrame, requests: DataFrame, members: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """For each request, the quote at ``seed mod n`` among the ``n`` matching quotes by occurrence order.

    ``quotes``: thinker_name, category, character_count, occurrence_id and any others;
    ``requests``: request_id, scope, category, max_length (both nullable), seed;
    ``members``: scope, thinker_name, without repeats.
    Identities are digests, so their leading digits make a tree of even nodes in known order. Each level counts the
    rows that fit in the children of the nodes that requests stand in, and a request goes down to the child that holds
    its position. The number of levels follows from the number of quotes: the last nodes have about ``leaf_rows``
    rows, and only these are ranked, once for each distinct filter that ends there.
    Quotes without an occurrence_id are not eligible.
    Returns request_id, ``matches`` and the columns of the picked quote; requests without a match are absent.
    """
    eligible = quotes.filter(F.col("occurrence_id").isNotNull())
    cells = reused(eligible.select("thinker_name", "category", "character_count", "occurrence_id"))
    standing = requests.select(
        "request_id",
        "scope",
        F.coalesce(_kind(F.col("category")), F.lit("")).alias("kind"),
        F.coalesce(F.col("max_length").cast("long"), F.lit(_NO_LIMIT)).alias("max_length"),
        F.lit("").alias("node"),
        "seed",
    )
    named = members.join(requests.select("scope").distinct(), "scope", "left_semi")
    total, levels = cells.count(), 1
    while total > leaf_rows * 16 ** (LEVEL_DIGITS * levels):
        levels += 1
    for level in range(1, levels + 1):
        points = standing.select(*_FILTER, "node").distinct()
        met = standing.join(_children(cells, points, named, LEVEL_DIGITS * level), [*_FILTER, "node"])
        if level == 1:
            met = met.withColumn("matches", F.col("in_node")).withColumn("position", ids.seeded_index(F.col("seed"), F.col("matches")))
        down = met.filter((F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("rows")))
        standing = reused(
            down.select("request_id", *_FILTER, F.col("child").alias("node"), "matches", (F.col("position") - F.col("before")).alias("position")),
            plain=True,
        )
    points = standing.select(*_FILTER, "node").distinct()
    leaves = cells.withColumn("node", F.substring("occurrence_id", 1, LEVEL_DIGITS * levels)).join(named, "thinker_name")
    fits = F.coalesce(F.col("character_count").cast("long"), F.lit(_NO_LIMIT)) <= F.col("max_length")
    of_kind = (F.col("kind") == "") | (F.col("kind") == _kind(F.col("category")))
    ranked = (
        leaves.join(points, ["scope", "node"])
        .filter(fits & of_kind)
        .withColumn("position", F.row_number().over(Window.partitionBy(*_FILTER, "node").orderBy("occurrence_id")).cast("long") - 1)
        .join(standing, [*_FILTER, "node", "position"])
        .select("request_id", "matches", "thinker_name", "category", "occurrence_id")
    )
    key = ["thinker_name", "category", "occurrence_id"]
    # One row of repeated identities; every other column comes with the picked rows alone.
    rest = [c for c in quotes.columns if c not in key]
    picked = ranked.withColumnsRenamed({c: f"picked_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"picked_{c}"))
    found = picked.join(eligible, same)
    once = found.groupBy("request_id", "matches", *key).agg(F.min(F.struct(*rest)).alias("rest"))
    return once.select("request_id", "matches", *key, "rest.*")
