"""Shape the given Parquet tables into the engine's input tables.

Every row comes from a row of the given tables; nothing is filtered by id or
cut short. The SQL twins of these adapters are in ``bindings/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions import ids, text
from lapidary.session import input_partitions, spread

BASE_TIME = 1767225600  # 2026-01-01T00:00:00Z
DATASET_VERSION = "0123456789abcdef"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A given table whose rows carry much work, over as many partitions as the session asks for."""
    rows = table(spark, sf_dir, name)
    return spread(rows, key, input_partitions(rows))


def minutes_after_base(minutes: Column) -> Column:
    return F.timestamp_seconds(F.lit(BASE_TIME) + minutes * 60)


def _lines(df: DataFrame, *keep: str) -> DataFrame:
    exploded = df.select(*keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return exploded.filter(f"length(line) >= {fixed.MIN_QUOTE_LENGTH}")


def document_quotes(documents: DataFrame) -> DataFrame:
    """Document lines as bronze quotes, some of them worded with an artefact or as a reference."""
    worded = """case (doc_id + length(line)) % 29
        when 0 then concat(line, ' [1][2]')
        when 1 then concat(line, '"')
        when 2 then concat(line, '".')
        when 3 then concat('...', line)
        when 4 then concat('(...) ', line)
        when 5 then concat(char(160), char(9), replace(line, ' ', '  '))
        when 6 then concat('Livro ', doc_id, ' IV. ', length(line))
        when 7 then concat(line, ' [1] [2]')
        when 8 then concat(line, '""')
        else line end"""
    category = "case when doc_id % 5 = 0 then 'atribuida' when doc_id % 5 <= 2 then 'verificada' else 'obra' end"
    work = "case when doc_id % 7 = 0 then 'Obras Atribuídas' else concat('Livro ', doc_id % 11) end"
    return _lines(documents, "doc_id", "source", "lang").selectExpr(
        "doc_id",
        "source as thinker_qid",
        "upper(source) as thinker_name",
        f"{worded} as text",
        f"{category} as category",
        f"case when doc_id % 5 >= 3 then {work} end as work",
        f"concat('{fixed.PAGE_URL_PREFIX}', source, '_', lang) as source_url",
        f"'{fixed.PAGE_SOURCE_NAME}' as source_name",
        f"'{fixed.PAGE_LICENSE}' as source_license",
        "doc_id + 1 as source_revision",
        f"timestamp_seconds({BASE_TIME} + 60 * ((doc_id * 7 + line_no * 3) % 100000)) as fetched_at",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "lang", "source")


def labelled(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").filter(condition).select("doc_id")
    return documents(spark, sf_dir).join(chosen, "doc_id", "left_semi")


def bronze_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quotes(documents(spark, sf_dir)).drop("doc_id")


def bronze_supplemental(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = dealt(spark, sf_dir, "conversations", "conv_id")
    spoken = _lines(talks, "conv_id", "turn", "role").selectExpr(
        "concat('src', conv_id % 23) as thinker_qid",
        "concat('SRC', conv_id % 23) as thinker_name",
        "line as text",
        "case when role = 'assistant' then concat('[o] ', line) end as original_text",
        """case when role = 'assistant' then 'fr'
            when role = 'user' and (conv_id + turn) % 19 = 0 then 'de' end as original_language""",
        "case when conv_id % 41 = 0 then 'outra' else 'obra' end as category",
        "'Conversas' as work",
        "concat('https://example.test/c/', conv_id) as source_url",
        "'Edition' as source_name",
        "case when conv_id % 37 <> 0 then 'Public domain' end as source_license",
        "conv_id + 1 as source_revision",
        """case when role = 'assistant' and (conv_id + turn) % 17 <> 0
            then concat('Tradutor ', conv_id % 5) end as translator_name""",
        "case when role = 'assistant' then 'CC0 1.0' end as translation_license",
        "case when role = 'assistant' then concat('https://example.test/t/', conv_id) end as translation_url",
        f"timestamp_seconds({BASE_TIME} + 60 * (conv_id * 3 + turn)) as reviewed_at",
    )
    repeated = document_quotes(labelled(spark, sf_dir, "quality = 1 and toxic = 1")).selectExpr(
        "thinker_qid",
        "thinker_name",
        "text",
        "cast(null as string) as original_text",
        "cast(null as string) as original_language",
        "category",
        "work",
        "concat('https://example.test/d/', doc_id) as source_url",
        "source_name",
        "source_license",
        "source_revision",
        "cast(null as string) as translator_name",
        "cast(null as string) as translation_license",
        "cast(null as string) as translation_url",
        "fetched_at as reviewed_at",
    )
    return spoken.unionByName(repeated)


def bronze_thinkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("qid"),
        F.when(doc % 97 != 0, F.upper("source")).alias("name"),
        F.concat("source", F.lit(" "), "lang").alias("wikiquote_title"),
        F.concat(F.lit(fixed.PAGE_URL_PREFIX), "source", F.lit("_"), "lang").alias("source_url"),
        (doc + 1).alias("source_revision"),
        minutes_after_base((doc * 7) % 100000).alias("fetched_at"),
    )


def _labelled_ids(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    rows = document_quotes(labelled(spark, sf_dir, condition))
    identity = ids.quote_id(F.col("thinker_qid"), text.clean_text(F.col("text")))
    return rows.select("doc_id", "thinker_qid", identity.alias("quote_id"))


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of documents labelled good and not toxic."""
    return _labelled_ids(spark, sf_dir, "quality = 1 and toxic = 0").select("thinker_qid", "quote_id").distinct()


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of documents labelled poor; some entries carry the identity of an older wording."""
    first = (
        _labelled_ids(spark, sf_dir, "quality = 0").groupBy("thinker_qid", "quote_id").agg(F.min("doc_id").alias("doc"))
    )
    doc = F.col("doc")

    def chosen(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (doc % len(values) + 1).cast("int"))

    return first.select(
        "thinker_qid",
        F.when(doc % 10 == 0, F.sha2("quote_id", 256)).otherwise(F.col("quote_id")).alias("quote_id"),
        chosen(fixed.REVIEW_STATUSES).alias("review_status"),
        F.when(doc % 13 == 0, "other").otherwise(chosen(fixed.REVIEW_REASONS)).alias("review_reason"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections by region and by remainder: every member is in two of them."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    by_region = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(
        F.lower("r_name").alias("slug"),
        F.col("r_name").alias("title"),
        F.concat(F.lit("SRC"), key).alias("thinker_name"),
    )
    by_remainder = nations.select(
        F.concat(F.lit("grupo-"), key % 3).alias("slug"),
        F.concat(F.lit("Grupo "), key % 3).alias("title"),
        F.concat(F.lit("SRC"), key).alias("thinker_name"),
    )
    return by_region.unionByName(by_remainder)


def member_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue order: the members by region, then all members again by remainder."""
    key = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("SRC"), key).alias("thinker_name"), key.alias("position"))
    return nations.unionByName(nations.withColumn("position", F.col("position") + 100))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selection request per event."""
    user, value = F.col("user_id"), F.col("value")
    slug = F.element_at(
        F.array(*[F.lit(s) for s in ("africa", "asia", "europe", "grupo-0", "grupo-2", "desconhecida")]),
        (user % 6 + 1).cast("int"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("date").cast("string").alias("on_date"),
        F.when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit("SRC"), user % 30)).alias("thinker"),
        F.when(F.col("event_type").isin("view", "purchase", "error"), slug).alias("collection"),
        F.when(user % 4 == 0, "verificada").when(user % 4 == 1, "obra").alias("category"),
        F.when(value < 30, ((F.floor(value / 10) + 2) * 60).cast("long")).alias("max_length"),
    )


def raw_supplemental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV-shaped text records: conversation lines with faults of every kind, and document lines."""
    conv, line = F.col("conv_id"), F.col("line")
    translated = F.col("role") == "assistant"
    blank = F.lit("")
    spoken = _lines(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select(
        F.lit("conversations").alias("source_file"),
        (conv * 1000000 + F.col("turn") * 10000 + F.col("line_no")).alias("line_number"),
        F.when(conv % 43 != 0, F.concat(F.lit("src"), conv % 23)).alias("thinker_qid"),
        F.concat(F.lit(" SRC"), conv % 29).alias("thinker_name"),
        F.concat(F.lit("\t"), line, F.lit(" ")).alias("text"),
        F.when(translated, F.concat(F.lit("[o] "), line)).otherwise(blank).alias("original_text"),
        F.when(translated | (conv % 47 == 0), "fr").otherwise(blank).alias("original_language"),
        F.when(conv % 41 == 0, "outra").otherwise("obra").alias("category"),
        F.when(translated, "Conversas").otherwise(blank).alias("work"),
        F.concat(F.when(conv % 31 == 0, "http").otherwise("https"), F.lit("://example.test/c/"), conv).alias("source_url"),
        F.lit("Edition").alias("source_name"),
        F.lit("Public domain").alias("source_license"),
        F.when(conv % 37 == 0, "x1").when(conv % 37 == 1, "0").otherwise((conv + 1).cast("string")).alias("source_revision"),
        F.when(translated & (conv % 17 != 0), F.concat(F.lit("Tradutor "), conv % 5)).otherwise(blank).alias("translator_name"),
        F.when(translated, "CC0 1.0").otherwise(blank).alias("translation_license"),
        F.when(translated, F.concat(F.when(conv % 19 == 0, "http").otherwise("https"), F.lit("://example.test/t/"), conv))
        .otherwise(blank)
        .alias("translation_url"),
        F.when(conv % 23 == 0, "2026-01-01T00:00:00")
        .when(conv % 23 == 1, "yesterday")
        .when(conv % 23 == 2, "2026-01-01T00:00:00+02:00")
        .otherwise("2026-01-01T00:00:00Z")
        .alias("reviewed_at"),
    )
    doc = F.col("doc_id")
    written = _lines(documents(spark, sf_dir), "doc_id", "source").select(
        F.lit("documents").alias("source_file"),
        (doc * 100000 + F.col("line_no")).alias("line_number"),
        F.col("source").alias("thinker_qid"),
        F.upper("source").alias("thinker_name"),
        line.alias("text"),
        F.lit(None).cast("string").alias("original_text"),
        F.lit(None).cast("string").alias("original_language"),
        F.lit("verificada").alias("category"),
        F.lit(None).cast("string").alias("work"),
        F.concat(F.lit("https://example.test/d/"), doc).alias("source_url"),
        F.lit("Edition").alias("source_name"),
        F.lit("Public domain").alias("source_license"),
        (doc + 1).cast("string").alias("source_revision"),
        F.lit(None).cast("string").alias("translator_name"),
        F.lit(None).cast("string").alias("translation_license"),
        F.lit(None).cast("string").alias("translation_url"),
        F.lit("2026-01-01T00:00:00Z").alias("reviewed_at"),
    )
    return spoken.unionByName(written)


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw fetch results: resolution, page and entity documents as JSON, with failures of every kind."""
    page = F.col("page_id")
    props = F.struct(F.when(page % 11 != 0, F.concat(F.lit("Q"), page)).alias("wikibase_item"))
    resolved = F.struct(
        F.struct(F.array(F.struct(F.col("url").alias("title"), props.alias("pageprops"))).alias("pages")).alias("query")
    )
    revision = F.when(page % 13 == 0, F.concat(F.lit('"'), page, F.lit('"'))).otherwise(page.cast("string"))
    # Keys out of order and with blanks: the canonical form has neither.
    raw_page = F.concat(
        F.lit('{ "parse": {"text": '),
        F.regexp_extract(F.to_json(F.struct("html")), r"(?s)^\{.html.:(.*)\}\z", 1),
        F.lit(', "revid": '),
        revision,
        F.lit("} }"),
    )
    entity = F.concat(F.lit('{"entities": {"Q'), page, F.lit('": {}}}'))
    return dealt(spark, sf_dir, "pages", "page_id").select(
        F.concat(F.lit("page "), page).alias("requested_name"),
        minutes_after_base(page).alias("fetched_at"),
        F.to_json(resolved).alias("resolution"),
        raw_page.alias("wikiquote"),
        entity.alias("wikidata"),
        F.when(page % 17 == 0, "ConnectError").alias("fetch_error"),
    )


def entity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims: sixteen events make the record of one entity."""
    event, user, value = F.col("event_id"), F.col("user_id"), F.col("value")
    pids = [*fixed.LABELLED_PROPERTIES, fixed.BIRTH_DATE, fixed.DEATH_DATE, fixed.INFLUENCED_BY]
    pid = F.element_at(F.array(*[F.lit(p) for p in pids]), (user % 9 + 1).cast("int"))
    is_time = F.col("pid").isin(fixed.BIRTH_DATE, fixed.DEATH_DATE)
    key = F.get_json_object("props", "$.k").cast("long")

    def padded(number: Column, width: int) -> Column:
        return F.lpad(number.cast("string"), width, "0")

    time = F.concat(
        F.when(event % 3 == 0, "-").otherwise("+"),
        padded(event * 7 % 2100, 4),
        F.lit("-"),
        padded(event % 13, 2),
        F.lit("-"),
        padded(event % 29, 2),
        F.lit("T00:00:00Z"),
    )
    return (
        table(spark, sf_dir, "events")
        .withColumn("pid", pid)
        .select(
            F.concat(F.lit("Q"), F.floor(event / 16)).alias("qid"),
            "pid",
            (event % 16).cast("int").alias("pos"),
            F.when(value < 5, "preferred").when(value > 100, "deprecated").otherwise("normal").alias("rank"),
            F.when(user % 31 == 0, "string").when(is_time, "time").otherwise("wikibase-entityid").alias("vtype"),
            F.when(~is_time & (user % 31 != 0), F.concat(F.lit("L"), key * 25 + user % 25)).alias("ref_id"),
            F.when(is_time & (user % 31 != 0), time).alias("time"),
            F.when(is_time & (user % 31 != 0), event % 7 + 6).cast("int").alias("precision"),
            "event_id",
            "event_type",
            "user_id",
        )
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_events(spark, sf_dir).drop("event_id", "event_type", "user_id")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    qids = entity_events(spark, sf_dir).select("qid").distinct()
    return qids.withColumn("name", F.concat(F.lit("Entity "), "qid"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.when(F.col("event_type") == "view", "pt").when(F.col("event_type") == "click", "en").otherwise("fr")
    return entity_events(spark, sf_dir).select(
        "qid", lang.alias("lang"), F.concat(F.col("event_type"), F.lit(" "), "user_id").alias("value")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as labels: some ids have both languages, some one, some none."""
    part = table(spark, sf_dir, "part")
    qid = F.concat(F.lit("L"), "p_partkey").alias("qid")
    portuguese = part.filter(F.col("p_size") % 2 == 1).select(
        qid, F.lit("pt").alias("lang"), F.concat("p_name", F.lit(" (pt)")).alias("value")
    )
    english = part.filter(F.col("p_size") % 5 != 0).select(qid, F.lit("en").alias("lang"), F.col("p_name").alias("value"))
    return portuguese.unionByName(english)


def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as the JSON documents they come in, sixteen claims at most in each."""
    value = F.when(F.col("vtype") == "time", F.to_json(F.struct("time", "precision"))).when(
        F.col("vtype") == "wikibase-entityid", F.to_json(F.struct(F.col("ref_id").alias("id")))
    )
    claim = F.concat(
        F.lit('{"rank":"'), "rank", F.lit('","mainsnak":{"datavalue":{"type":"'), "vtype", F.lit('","value":'),
        F.coalesce(value, F.lit('"text"')), F.lit("}}}"),
    )
    statements = (
        entity_events(spark, sf_dir)
        .groupBy("qid", "pid")
        .agg(F.array_sort(F.collect_list(F.struct("event_id", claim.alias("claim")))).alias("listed"))
    )
    property_json = F.concat(
        F.lit('"'), "pid", F.lit('":['), F.array_join(F.transform("listed", lambda x: x["claim"]), ","), F.lit("]")
    )
    return statements.groupBy("qid").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(property_json), ","), F.lit("}")).alias("claims")
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("thinker_qid"),
        F.col("p_name").alias("thinker_name"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("wikiquote_title"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("E"), "p_partkey")).alias("entity_qid"),
    )


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name, every word of a name, and every nation, as search text."""
    known = table(spark, sf_dir, "part").select("p_name").distinct()
    words = known.select(F.explode(F.split("p_name", " ")).alias("query_text"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("query_text"))
    texts = known.select(F.upper("p_name").alias("query_text")).unionByName(words).unionByName(nations).distinct()
    return texts.select(F.col("query_text").alias("query_id"), "query_text")


def partial_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of the words of names, words with a letter left out, doubled or changed, and two of these together."""
    words = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w"))
    first, last = F.element_at("w", 1), F.element_at("w", -1)
    texts = [
        F.substring(first, 1, 3),
        F.concat(F.substring(first, 1, 2), F.expr("substring(element_at(w, 1), 4)")),
        F.concat(F.substring(last, 1, 4), F.expr("substring(element_at(w, -1), 4)")),
        F.concat(F.substring(last, 1, 2), F.lit("q"), F.expr("substring(element_at(w, -1), 4)")),
        F.concat(F.substring(last, 1, 2), F.lit(" "), F.expr("substring(element_at(w, 1), 2)")),
    ]
    asked = words.select(F.explode(F.array(*texts)).alias("query_text")).distinct()
    return asked.select(F.col("query_text").alias("query_id"), "query_text")


def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages and lines as blocks; short lines are headings."""
    line = F.col("line")
    lines = documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    size = F.length(line)
    heading = (
        F.when(size % 6 == 0, "Verificadas")
        .when(size % 6 == 1, F.concat(F.lit(" Atribuídas ("), size, F.lit(") ")))
        .when(size % 6 == 2, F.lit("Sobre (o autor)"))
        .when(size % 6 == 3, "REFERÊNCIAS")
        .otherwise(line)
    )
    is_heading = size < fixed.SHORT_TEXT_BELOW
    return lines.select(
        "doc_id",
        "line_no",
        is_heading.alias("is_heading"),
        F.when(is_heading, heading).otherwise(F.concat(F.lit("“"), line, F.lit('" '))).alias("text"),
    )


def metadata_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build metadata of one dataset per order, with faults of every kind."""
    order = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), F.floor(order / F.when(order % 19 == 0, 1).otherwise(2))).alias("dataset"),
        F.when(order % 11 == 0, 2).otherwise(3).alias("schema_version"),
        F.when(order % 7 == 0, "XYZ").otherwise(F.left(F.sha2(order.cast("string"), 256), F.lit(16))).alias("dataset_version"),
        F.col("o_orderdate").cast("date").cast("string").alias("source_fetched_at"),
        F.lit("3").alias("pipeline_version"),
        F.lit("1").alias("parser_version"),
        F.when(order % 13 == 0, "  ").otherwise(F.concat(F.lit("run-"), order)).alias("run_id"),
        F.when(order % 17 == 0, "invalid").otherwise(F.sha2(order.cast("string"), 256)).alias("manifest_sha256"),
        F.when(order % 23 != 0, F.col("o_orderstatus")).alias("source_commit"),
    )
    return rows
