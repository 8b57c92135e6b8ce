"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.common import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    larger = both.filter("b > a").join(least, "a")
    return larger.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, least`` for each node that is not the least of its component; ``links`` has long columns a, b.

    Each round is one table in the shared folder. A star's centre is joined with its rays, which the runtime splits
    when a centre is hot; minima are summed per task first. No link set or component passes through the driver.
    """
    stars = written(_small_star(written(links.filter("a != b"), "links")), "stars")
    before = None
    while (now := _state(stars)) != before:
        before = now
        stars = written(_small_star(_large_star(stars).distinct()), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("least"))
