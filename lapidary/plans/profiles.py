"""Entity profiles and influence edges from claims.

``claims``: qid, pid, pos, rank, vtype, ref_id, time, precision;
``labels`` and ``descriptions``: qid, lang, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.functions.dates import partial_date
from lapidary.operators.latest import first_per_key

_DATES = [fixed.BIRTH_DATE, fixed.DEATH_DATE]


def usable(claims: DataFrame) -> DataFrame:
    return claims.filter(F.coalesce("rank", F.lit("")) != "deprecated")


def best_claims(claims: DataFrame) -> DataFrame:
    """The first preferred claim of each entity and property, else the first usable one."""
    order = F.struct((F.coalesce("rank", F.lit("")) != "preferred").alias("lesser"), "pos")
    value = F.struct("pos", "rank", "vtype", "ref_id", "time", "precision")
    return usable(claims).groupBy("qid", "pid").agg(F.min_by(value, order).alias("best")).select("qid", "pid", "best.*")


def references(claims: DataFrame) -> DataFrame:
    return usable(claims).filter(F.col("vtype") == "wikibase-entityid")


def referenced_ids(claims: DataFrame) -> DataFrame:
    """Distinct ids that profiles need a label for."""
    return references(claims).filter(F.col("pid").isin(*fixed.LABELLED_PROPERTIES)).select("ref_id").distinct()


def chosen_texts(texts: DataFrame) -> DataFrame:
    """One text per id: the first language of the fallback list that the id has; empty texts are dropped."""
    wanted = texts.filter(F.col("lang").isin(*fixed.LABEL_LANGUAGES))
    place = F.array_position(F.array(*[F.lit(lang) for lang in fixed.LABEL_LANGUAGES]), F.col("lang"))
    best = wanted.groupBy("qid").agg(F.min_by("value", F.struct(place.alias("place"), "value")).alias("value"))
    return best.filter(F.coalesce("value", F.lit("")) != "")


def labelled_references(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """References with their label; references without one are dropped."""
    named = chosen_texts(labels).select(F.col("qid").alias("ref_id"), F.col("value").alias("label"))
    return references(claims).select("qid", "pid", "pos", "ref_id").join(named, "ref_id")


def _in_order(pid: str, *fields: Column) -> Column:
    """Values of one property in claim order; as many as the entity's own record held."""
    listed = F.collect_list(F.when(F.col("pid") == pid, F.struct("pos", *fields)))
    return F.array_sort(listed)


def entity_profiles(
    entities: DataFrame, claims: DataFrame, labels: DataFrame, descriptions: DataFrame
) -> DataFrame:
    """One profile per entity (qid, name).

    An entity's claims were read from one record, so its lists are no longer
    than what that record held.
    """
    named = labelled_references(claims, labels).filter(F.col("pid").isin(*fixed.LABELLED_PROPERTIES))
    label = F.col("label")

    def labels_of(pid: str) -> Column:
        return F.transform(_in_order(pid, label), lambda x: x["label"])

    lists = named.groupBy("qid").agg(
        F.min_by("label", F.when(F.col("pid") == fixed.BIRTH_PLACE, F.col("pos"))).alias("local_nascimento"),
        labels_of(fixed.CITIZENSHIP).alias("nacionalidade"),
        labels_of(fixed.OCCUPATION).alias("ocupacoes"),
        labels_of(fixed.MOVEMENT).alias("correntes"),
        labels_of(fixed.EDUCATION).alias("formacao"),
        F.transform(
            _in_order(fixed.NOTABLE_WORKS, label, F.col("ref_id")),
            lambda x: F.struct(x["label"].alias("titulo"), x["ref_id"].alias("qid")),
        ).alias("obras"),
    )
    dated = best_claims(claims.filter(F.col("pid").isin(*_DATES))).filter(F.col("vtype") == "time")
    shown = dated.withColumn("date", partial_date(F.col("time"), F.col("precision")))
    dates = shown.groupBy("qid").agg(
        *[F.max(F.when(F.col("pid") == pid, F.col("date"))).alias(name) for pid, name in zip(_DATES, ("nascimento", "morte"))]
    )
    described = chosen_texts(descriptions).withColumnRenamed("value", "descricao")
    profile = entities.select("qid", F.col("name").alias("nome"))
    for side in (described, dates, lists):
        profile = profile.join(side, "qid", "left")
    source = F.struct(
        F.lit(fixed.ENTITY_SOURCE_NAME).alias("fonte"),
        F.lit(fixed.ENTITY_LICENSE).alias("licenca"),
        entity_url(F.col("qid")).alias("url"),
    )
    empty = {
        name: F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType))
        for name in ("nacionalidade", "ocupacoes", "correntes", "formacao", "obras")
    }
    return profile.withColumns({**empty, "fontes": F.array(source)}).select(
        "qid",
        "nome",
        "descricao",
        "nascimento",
        "morte",
        "local_nascimento",
        "nacionalidade",
        "ocupacoes",
        "correntes",
        "formacao",
        "obras",
        "fontes",
    )


def entity_url(qid: Column) -> Column:
    return F.concat(F.lit(fixed.ENTITY_URL_PREFIX), qid)


def quote_samples(quotes: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    """First ``n`` quotes of every key in source order."""
    if not 0 <= n <= 50:
        raise ValueError("a sample holds 0 to 50 quotes")
    return first_per_key(quotes, [key], [F.asc_nulls_last(c) for c in order], n=n)


def thinker_profiles(
    profiles: DataFrame, pages: DataFrame, quotes: DataFrame, order: list[str], sample: int = 10
) -> DataFrame:
    """Profiles with a sample of quotes; a profile whose page (``qid``) is unavailable carries a note.

    ``quotes``: qid, text, category, work, source_name, source_license, source_url
    and the ``order`` columns. The sample bounds the collected list.
    """
    kept = quote_samples(quotes, "qid", order, sample)
    source = F.struct(
        F.col("source_name").alias("fonte"), F.col("source_license").alias("licenca"), F.col("source_url").alias("url")
    )
    quote = F.struct(
        *order, F.col("text").alias("texto"), F.col("category").alias("categoria"), F.col("work").alias("obra"), source.alias("fonte")
    )
    lists = kept.groupBy("qid").agg(F.array_sort(F.collect_list(quote)).alias("_sample"))
    available = pages.select("qid").distinct().withColumn("_available", F.lit(True))
    joined = profiles.join(available, "qid", "left").join(lists, "qid", "left")
    has_page = F.col("_available").isNotNull()
    shown = F.transform(
        F.when(has_page, F.col("_sample")), lambda q: F.struct(q["texto"], q["categoria"], q["obra"], q["fonte"])
    )
    credit = F.when(
        has_page & F.col("_sample").isNotNull(),
        F.concat("fontes", F.transform(F.slice("_sample", 1, 1), lambda q: q["fonte"])),
    )
    return joined.withColumns(
        {
            "frases": F.coalesce(shown, F.array().cast("array<struct<texto:string,categoria:string,obra:string,fonte:struct<fonte:string,licenca:string,url:string>>>")),
            "fontes": F.coalesce(credit, F.col("fontes")),
            "aviso": F.when(~has_page, fixed.PARTIAL_PROFILE_NOTE),
        }
    ).drop("_available", "_sample")


def influence_graph(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per entity with its direct influences in order, an empty list where it has none.

    An entity's list is as long as its own claims.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "influence_qid", "nome", "url")))
    found = edges.groupBy("qid").agg(listed.alias("_listed"))
    listed = F.transform("_listed", lambda x: F.struct(x["influence_qid"].alias("qid"), x["nome"].alias("nome"), x["url"].alias("url")))
    none = F.array().cast("array<struct<qid:string,nome:string,url:string>>")
    return entities.select("qid", "name").join(found, "qid", "left").select(
        "qid", "name", F.coalesce(listed, none).alias("influenciado_por")
    )


def influence_edges(claims: DataFrame, labels: DataFrame) -> DataFrame:
    """Direct influences of every entity: first mention kept, unlabelled ones dropped."""
    influences = labelled_references(claims.filter(F.col("pid") == fixed.INFLUENCED_BY), labels)
    first = influences.groupBy("qid", "ref_id").agg(F.min("pos").alias("pos"), F.any_value("label").alias("nome"))
    return first.select(
        F.col("qid"),
        F.col("pos"),
        F.col("ref_id").alias("influence_qid"),
        "nome",
        entity_url(F.col("ref_id")).alias("url"),
    )
