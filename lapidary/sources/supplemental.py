"""The reviewed CSV source: reading, validation and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions.text import strip_whitespace
from lapidary.session import reused

_OPTIONAL = [f for f in fixed.SUPPLEMENTAL_FIELDS if f not in fixed.SUPPLEMENTAL_REQUIRED]
_INTEGER = r"^[+-]?[0-9]+\z"
_ISO_TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)?)?\z"
)
_ZONE = r"[T ][0-9:.,]+(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)\z"


class InvalidSource(ValueError):
    """The CSV header or a row breaks the source's contract."""


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_number, record): the records of CSV files, each file read by as many tasks as it has splits.

    A line break ends a record where the quotes before it are even in number. Quotes are counted per line, per split
    and over the splits of a file, and record starts likewise, so no task reads more than a split; only the lines of
    one record meet. Records are numbered from 1 in every file; blank lines between records are none. Quotes stand
    around fields and are doubled within, as in RFC 4180.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
        "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )
    lines = reused(lines)
    split = ["source_file", "split"]
    in_split = Window.partitionBy(*split).orderBy("place")
    # A row for each split of a file.
    over_splits = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)

    def before(df: DataFrame, column: str) -> DataFrame:
        sums = df.groupBy(*split).agg(F.sum(column).alias("sum"))
        return sums.select(*split, F.coalesce(F.sum("sum").over(over_splits), F.lit(0)).alias(f"{column}_before"))

    earlier = F.coalesce(F.sum("quotes").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    even = lines.withColumn("earlier", earlier).join(before(lines, "quotes"), split).withColumn(
        "even", (F.col("earlier") + F.col("quotes_before")) % 2 == 0
    )
    full = even.filter(~(F.col("even") & F.rtrim("value", F.lit("\r")).isin("", "\ufeff"))).withColumn("starts", F.col("even").cast("int"))
    full = reused(full.select(*split, "place", "value", "starts"))
    running = F.sum("starts").over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = full.withColumn("running", running).join(before(full, "starts"), split)
    parts = F.array_sort(F.collect_list(F.struct("split", "place", "value")))
    records = numbered.groupBy("source_file", (F.col("running") + F.col("starts_before")).alias("line_number")).agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return records.select("source_file", "line_number", F.regexp_replace(text, r"\r\z", "").alias("record"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All fields as text with ``source_file`` and ``line_number``; the header of every file must match exactly.

    ``path`` may hold many files; one whose header differs in any way refuses the source by its name. Record numbers
    start at 2 in every file, below its header, and quoted fields may span lines.
    """
    fields = fixed.SUPPLEMENTAL_FIELDS
    # One column more than the header may have, so that a longer header shows.
    schema = ", ".join(f"`{name}` string" for name in [*fields, "_more"])
    records = csv_records(spark, path)
    parsed = records.withColumn("fields", F.from_csv("record", F.lit(schema), {"escape": '"', "mode": "PERMISSIVE"}))
    rows = reused(parsed.select("source_file", "line_number", "fields.*"))
    wanted = F.array(*[F.lit(name) for name in fields], F.lit(None).cast("string"))
    shown = F.transform(F.array(*fields, "_more"), lambda value, place: F.when(place == 0, F.ltrim(value, F.lit("\ufeff"))).otherwise(value))
    headers = rows.filter("line_number = 1")
    wrong = headers.filter(~shown.eqNullSafe(wanted)).agg(F.min("source_file").alias("file"), F.count(F.lit(1)).alias("n")).first()
    if wrong.n:
        raise InvalidSource(f"the header of the supplemental source does not match: {wrong.file}")
    if headers.count() < len(spark.read.text(path).inputFiles()):
        raise InvalidSource("the header of the supplemental source does not match: a file is empty")
    return rows.filter("line_number > 1").drop("_more")


def _stripped(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {name: F.coalesce(strip_whitespace(F.col(name)), F.lit("")) for name in fixed.SUPPLEMENTAL_FIELDS}
    )


def _errors(repeated: Column) -> Column:
    """Names of all broken rules, in the order in which the rules are tested; the first names the missing fields."""
    col = F.col
    lacking = F.array_compact(F.array(*[F.when(col(name) == "", F.lit(name)) for name in fixed.SUPPLEMENTAL_REQUIRED]))
    revision = F.replace(col("source_revision"), F.lit("_"), F.lit("")).try_cast("long")
    number = col("source_revision").rlike(_INTEGER) & revision.isNotNull()
    iso = col("reviewed_at").rlike(_ISO_TIME) & F.try_to_timestamp("reviewed_at").isNotNull()
    details = [col(c) for c in ("original_language", "translator_name", "translation_license", "translation_url")]
    all_details, any_details = F.lit(True), F.lit(False)
    for detail in details:
        all_details = all_details & (detail != "")
        any_details = any_details | (detail != "")
    original = col("original_text") != ""
    # Rule names in testing order.
    rules = [
        ("unknown_thinker", ~col("_known")),
        ("invalid_category", ~col("category").isin(*fixed.CATEGORIES)),
        ("source_url_not_https", ~col("source_url").startswith("https://")),
        ("revision_not_integer", ~number),
        ("revision_not_positive", number & (revision < 1)),
        ("reviewed_at_not_iso", ~iso),
        ("reviewed_at_without_zone", iso & ~col("reviewed_at").rlike(_ZONE)),
        ("incomplete_translation", original & ~all_details),
        ("translation_without_original", ~original & any_details),
        ("translation_url_not_https", (col("translation_url") != "") & ~col("translation_url").startswith("https://")),
        ("repeated_quote", repeated),
    ]
    missing = F.when(F.size(lacking) > 0, F.concat(F.lit("missing_field "), F.array_join(lacking, " ")))
    return F.array_compact(F.array(missing, *[F.when(test, F.lit(name)) for name, test in rules]))


def validate(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Stripped rows with ``errors``; ``names`` (thinker_name) is the catalogue.

    ``raw`` holds the CSV fields, ``source_file`` and ``line_number``. The first
    row of a (thinker, text) pair is found by an aggregate and joined back, so
    copies of one text are never sorted together.
    """
    rows = _stripped(raw)
    identity = F.xxhash64("thinker_qid", "text")
    rows = rows.withColumn("_identity", identity)
    place = F.struct("source_file", "line_number")
    first = rows.groupBy("_identity", "thinker_qid", "text").agg(F.min(place).alias("_first"))
    known = names.select("thinker_name").distinct().withColumn("_known", F.lit(True))
    joined = (
        rows.join(first, ["_identity", "thinker_qid", "text"])
        .join(known, "thinker_name", "left")
        .withColumn("_known", F.coalesce("_known", F.lit(False)))
    )
    checked = joined.withColumn("errors", _errors(place > F.col("_first")))
    return checked.select("source_file", "line_number", *fixed.SUPPLEMENTAL_FIELDS, "errors")


def first_error(validated: DataFrame) -> DataFrame:
    """The row a reader that stops at the first error reports."""
    place = F.struct("source_file", "line_number", F.try_element_at("errors", F.lit(1)).alias("error"))
    first = validated.filter(F.size("errors") > 0).agg(F.min(place).alias("first"))
    return first.filter("first is not null").select("first.*")


def typed(validated: DataFrame) -> DataFrame:
    """Valid rows as bronze rows; empty optional fields become null."""
    valid = validated.filter(F.size("errors") == 0)
    optional = {name: F.nullif(F.col(name), F.lit("")) for name in _OPTIONAL}
    return valid.withColumns(
        {
            **optional,
            "source_revision": F.col("source_revision").cast("long"),
            "reviewed_at": F.to_timestamp("reviewed_at"),
        }
    ).select(*fixed.SUPPLEMENTAL_FIELDS)


def load(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Bronze rows of a CSV source, refused as a whole when one row is invalid."""
    validated = validate(read_csv(spark, path), names)
    problem = first_error(validated).first()
    if problem is not None:
        raise InvalidSource(f"supplemental source, line {problem.line_number}: {problem.error}")
    return typed(validated)
