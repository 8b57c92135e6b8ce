"""Keep-one-per-key operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows of every key in the given order.

    The row-number filter lets Spark drop all but ``n`` rows of a key in each
    task before the shuffle, so a key that holds most rows costs its reader
    ``n`` rows per task and no more.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def first_mentions(df: DataFrame, column: str, position: str) -> DataFrame:
    """Distinct values with the position of their first mention."""
    return df.groupBy(column).agg(F.min(position).alias(position))


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_by: str, ties: Sequence[str]) -> DataFrame:
    """Newest row of every key; equal times are settled by the ``ties`` columns, nulls last."""
    order = [F.desc_nulls_last(newest_by), *[F.asc_nulls_last(name) for name in ties]]
    return first_per_key(df, keys, order)
