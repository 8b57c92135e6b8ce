"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.session import run_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of the warehouse: one machine, or a warehouse on a shared store. On a cluster with
    a warehouse on a local disk no folder is shared, which is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    on_disk = "://" not in warehouse or warehouse.startswith("file:")
    if on_disk and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir: without it intermediate tables would go to a local disk of each machine")
    return f"{warehouse}/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the run folder of this application, which goes when the driver ends."""
    return f"{run_folder(shared_folder(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, a lost executor costs a re-read.

    The schema is read from the files, so a folder without files is an error and never an empty table.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(column, UPPER, LOWER)


def row_and(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside new ones, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def first_by(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The ``n`` rows of least ``order`` (a 64-bit hash) with the column ``order``.

    Only about 4 n rows, those below a hash limit taken from the number of rows, are ever sorted, so the one task that
    does it reads as much at any size of the table.
    """
    total = df.count()
    limit = (1 << 63) - 1 if total <= 4 * n else -(1 << 63) + (1 << 64) * 4 * n // total
    ordered = df.withColumn("order", order)
    return ordered.filter(F.col("order") <= F.lit(limit).cast("long")).orderBy("order").limit(n)
