"""Session helpers."""

from __future__ import annotations

import atexit
import uuid
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Session setting: number of partitions over which rows of small inputs are dealt; unset leaves the scan's own.
INPUT_PARTITIONS = "spark.lapidary.input.partitions"
#: Rows that one task sorts where they are dealt by number.
ROWS_A_TASK = 200_000


def shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def _remove(jvm, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except (Py4JError, OSError):  # the JVM has ended first; what is left is named by its application
        return


@lru_cache
def run_folder(base: str, application: str) -> str:
    """A folder of one application, removed when its driver's Python ends: its tables are read no more then."""
    folder = f"{base.rstrip('/')}/run-{application}"
    atexit.register(_remove, SparkSession.active()._jvm, folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; on one machine without a shared folder, in the warehouse."""
    folder = shared_folder(spark)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{run_folder(base, spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def reused(df: DataFrame, plain: bool = False) -> DataFrame:
    """Rows that a plan reads more than once.

    Where the cluster names a shared folder (``spark.checkpoint.dir``) they are written to it, which also ends the plan
    behind them; the schema is read from the files, so missing files are an error. Else the executors keep the rows and
    what a lost one held is computed again. No folder is chosen here. Callers keep narrow rows only.
    Joins take the size of files for the size of rows. Rows that compress to a small part, such as millions of requests
    with few distinct filters, would thus be broadcast through the driver; ``plain`` writes them as they are.
    """
    if not shared_folder(df.sparkSession):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = new_folder(df.sparkSession, "reused")
    options = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {"compression": "zstd"}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Deal rows over an explicit number of partitions; None leaves the table as the scan splits it."""
    return df if partitions is None else df.repartition(partitions, key)


def input_partitions(df: DataFrame) -> int | None:
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return int(wanted) if wanted else None


def dealt_by_rows(df: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """Deal rows by a key over as many partitions as give each about ``rows``, however few files hold them."""
    return df.repartition(max(1, -(-df.count() // rows)), key)
