"""Ways to rows by key: statistics of files, and bucketed tables.

``file_statistics`` has a row for each file of a table: rows, least and greatest key, and a Bloom filter of the keys. A
look-up of one key reads this small table first and opens only files that may hold it, however the files are sorted.
``bucketed`` tables hold the rows of a key in one bucket, so joins and sums by that key need no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a file's filter for each of its rows, and bits that are set for a key.
BITS_PER_ROW, PROBES = 16, 3


def _places(key: Column, bits: Column) -> Column:
    """Places of a key's bits among ``bits``, a power of two."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), bits) for i in range(PROBES)])


def file_statistics(table: DataFrame, key: str) -> DataFrame:
    """file, rows, low, high, bits, words: statistics of ``key`` for each file that ``table`` reads.

    ``words`` maps the number of a 64-bit word of the file's filter to its value; words of zeros are absent. Null keys
    count as rows only. The filter grows with the rows of its file, which the writer bounds.
    """
    rows = table.select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key"))
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    power = F.ceil(F.log2(F.greatest(F.lit(64), F.col("rows") * BITS_PER_ROW).cast("double")))
    sized = sizes.withColumn("bits", F.pow(F.lit(2.0), power).cast("long"))
    places = rows.filter("key is not null").join(sized.select("file", "bits"), "file")
    place = places.select("file", F.explode(_places(F.col("key"), F.col("bits"))).alias("place"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    words = place.groupBy("file", F.shiftright("place", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))
    filters = words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"))
    return sized.join(filters, "file", "left")


def files_with(statistics: DataFrame, value: str) -> list[str]:
    """Files that may hold a key: all that do, and few others."""
    key = F.lit(value)
    held = F.forall(
        _places(key, F.col("bits")),
        lambda p: F.getbit(F.coalesce(F.element_at("words", F.shiftright(p, 6)), F.lit(0).cast("long")), F.pmod(p, F.lit(64)).cast("int")) == 1,
    )
    found = statistics.filter((F.col("low") <= key) & (F.col("high") >= key)).filter(held)
    return [row.file for row in found.select("file").collect()]


def look_up(table: DataFrame, statistics: DataFrame, key: str, value: str, path: str) -> DataFrame:
    """Rows of ``table``, a Parquet table in ``path``, whose ``key`` is ``value``, from the files that may hold it."""
    files = files_with(statistics, value)
    if not files:
        return table.limit(0)
    read = table.sparkSession.read.schema(table.schema).option("basePath", path)
    return read.parquet(*files).filter(F.col(key) == value)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, order: str, buckets: int) -> None:
    """Write ``df`` to ``path`` in ``buckets`` buckets of ``key``, known to this session as table ``name``."""
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key, order).option("path", path).option("compression", "zstd").saveAsTable(name)


def attach_bucketed(spark: SparkSession, name: str, path: str, key: str, order: str, buckets: int) -> DataFrame:
    """Make a bucketed table of another session known to this one."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(
        f"create table if not exists {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}, {order}) into {buckets} buckets location '{path}'"
    )
    return spark.table(name)
