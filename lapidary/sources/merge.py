"""A table kept in buckets of its key and merged snapshot by snapshot.

The key is a digest, so its first digits make even buckets. A merge reads only the buckets that the new rows touch,
writes these anew and carries the others over by name: the log of commits maps each bucket to its folder. A reader
holds one commit and is not disturbed by later ones; two merges that start from one commit cannot both end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapidary.operators.latest import latest_per_key
from lapidary.session import reused
from lapidary.sources import commits

#: Bucket of rows without a key.
NO_KEY = "none"


def latest_in_order(rows: DataFrame, key: str, newest_by: str, ties: Sequence[str]) -> DataFrame:
    """The latest row of each key, by bucket and key.

    A range over bucket and key lets a large bucket span several tasks and files. It also brings the rows of a key
    together, and the ranking leaves them in the order in which they are written: rows are shuffled and sorted once.
    """
    ranged = rows.repartitionByRange("bucket", key)
    return latest_per_key(ranged, ["bucket", key], newest_by, ties).sortWithinPartitions("bucket", key)


def merge_latest(rows: DataFrame, target: str, key: str, newest_by: str, ties: Sequence[str], digits: int = 2) -> list[str]:
    """Merge ``rows`` into the table in ``target``, the latest row of each key staying; returns the buckets written.

    ``digits`` is fixed with the first merge: there are at most ``16 ** digits`` buckets and one more.
    """
    spark, log = rows.sparkSession, f"{target}/commits"
    number = commits.newest(spark, log)
    held = commits.read(spark, log, number)["buckets"] if number else {}
    marked = rows.withColumn("bucket", F.coalesce(F.substring(key, 1, digits), F.lit(NO_KEY)))
    folder = f"{target}/data/{uuid.uuid4().hex}"
    if held:
        fresh = reused(marked)
        # Bounded: a name for each bucket.
        touched = sorted(row.bucket for row in fresh.select("bucket").distinct().collect())
        before = [held[b] for b in touched if b in held]
        if before:
            old = spark.read.schema(rows.schema).parquet(*before)
            fresh = fresh.unionByName(old.withColumn("bucket", F.coalesce(F.substring(key, 1, digits), F.lit(NO_KEY))))
    else:
        fresh = marked
    latest_in_order(fresh, key, newest_by, ties).write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
    if not held:
        # The names of the folders written.
        touched = commits.folders(spark, folder, "bucket=")
    written = {b: f"{folder}/bucket={b}" for b in touched}
    commits.commit(spark, log, number + 1, {"buckets": held | written, "schema": rows.schema.json()})
    return touched


def read_merged(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """The table as of a commit, the newest by default."""
    log = f"{target}/commits"
    record = commits.read(spark, log, number or commits.newest(spark, log))
    schema = StructType.fromJson(json.loads(record["schema"]))
    folders = sorted(record["buckets"].values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
