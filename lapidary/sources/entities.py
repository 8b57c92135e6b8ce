"""Entity documents to claims, labels and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLAIMS = """map<string, array<struct<rank: string,
    mainsnak: struct<datavalue: struct<type: string, value: string>>>>>"""
_TEXTS = "map<string, struct<value: string>>"


def read_claims(entities: DataFrame) -> DataFrame:
    """Claims of entities (``qid``, ``claims`` as JSON) in document order.

    The value is kept as JSON text first, since it is an object for some types
    and a string for others.
    """
    listed = entities.select("qid", F.explode(F.from_json("claims", _CLAIMS)).alias("pid", "statements"))
    each = listed.select("qid", "pid", F.posexplode("statements").alias("pos", "claim"))
    value = F.col("claim.mainsnak.datavalue.value")
    return each.select(
        "qid",
        "pid",
        "pos",
        F.col("claim.rank").alias("rank"),
        F.col("claim.mainsnak.datavalue.type").alias("vtype"),
        F.get_json_object(value, "$.id").alias("ref_id"),
        F.get_json_object(value, "$.time").alias("time"),
        F.get_json_object(value, "$.precision").try_cast("int").alias("precision"),
    )


def read_texts(entities: DataFrame, column: str) -> DataFrame:
    """Labels or descriptions (``qid``, JSON column) as (qid, lang, value)."""
    return entities.select("qid", F.explode(F.from_json(column, _TEXTS)).alias("lang", "text")).select(
        "qid", "lang", F.col("text.value").alias("value")
    )
