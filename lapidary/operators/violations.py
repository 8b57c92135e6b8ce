"""Generic data tests; each returns the violating rows, none when the test passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of many columns in one scan, as (column_name, violations)."""
    counted = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return counted.unpivot([], list(columns), "column_name", "violations")


def repeated_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; null keys do not count as repeats."""
    known = df.select(*columns).na.drop("any")
    return known.groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def unaccepted_values(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """Values outside the accepted list with their row counts; null passes."""
    outside = df.filter(~F.col(column).isin(*accepted))
    return outside.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-null references without a parent, with their row counts.

    References are counted before the join, so a reference most rows share
    reaches the anti join as one row.
    """
    references = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("occurrences"))
    return references.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def missing(expected: DataFrame, available: DataFrame, column: str) -> DataFrame:
    """Set difference of one column."""
    return expected.select(column).distinct().join(available.select(column), column, "left_anti")


def violation_counts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Many row-level tests in one scan, as (check, violations)."""
    counted = df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    return counted.unpivot([], list(tests), "check", "violations")
