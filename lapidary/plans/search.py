"""Token index, posting blocks, text search, name search with beginnings and typos, name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions.tokens import token_list
from lapidary.operators.latest import first_per_key
from lapidary.session import dealt_by_rows, reused

#: Identities of a posting block, about.
BLOCK = 256
#: Tokens beyond this length are compared without typos.
LONGEST_TYPO = 24


def token_index(rows: DataFrame, identity: str, column: str) -> DataFrame:
    """(token, identity) for every distinct token of every text."""
    return rows.select(F.explode(token_list(F.col(column))).alias("token"), identity)


def answering(tokens: DataFrame, identity: str, terms: DataFrame) -> DataFrame:
    """Rows of ``tokens`` (identity, tokens) whose identity holds the rarest term of some query (query_id, token).

    All others can answer no query. Terms are counted in place, and only the identities that hold a rarest one are brought
    together; a query with a term that stands nowhere has no answer.
    """
    found = tokens.select(F.explode("tokens").alias("token"), identity).join(terms.select("token").distinct(), "token", "left_semi")
    sized = terms.join(token_frequencies(found), "token", "left").groupBy("query_id")
    rarest = sized.agg(F.min_by("token", F.struct("texts", "token")).alias("token"), F.bool_and(F.col("texts").isNotNull()).alias("whole"))
    # Written first, so that the joins see their sizes before the texts are dealt.
    first = reused(rarest.filter("whole").select("token").distinct())
    held = reused(found.join(first, "token", "left_semi").select(identity).distinct())
    return tokens.join(held, identity, "left_semi")


def posting_blocks(
    rows: DataFrame,
    identity: str,
    column: str,
    only: DataFrame | None = None,
    block: int = BLOCK,
    queries: DataFrame | None = None,
) -> DataFrame:
    """Posting lists in blocks: token, slice, n, first, last, identities (in order).

    Identities are digests, so their first digits cut the list of a token into even slices. A token has as many digits
    as make its blocks about ``block`` identities long; a token in few texts has one block, with the empty slice. The
    block that would hold an identity is thus known by name, so a look-up is an equal join and skips all others.
    ``only``: a column ``token``; no other tokens are indexed. Each text is taken apart once.
    ``queries``: the terms of queries (query_id, token) that the index is made for; texts that can answer none of them
    (see ``answering``) are left out, so that the postings of frequent tokens are dealt for few texts.
    """
    tokens = reused(rows.select(identity, token_list(F.col(column)).alias("tokens")))
    if queries is not None:
        tokens = reused(answering(tokens, identity, queries))
    postings = tokens.select(F.explode("tokens").alias("token"), F.col(identity).alias("identity"))
    if only is not None:
        postings = postings.join(only.select("token").distinct(), "token", "left_semi")
    sizes = postings.groupBy("token").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > block)
    digits = sizes.select("token", F.ceil(F.log(16.0, F.col("texts") / block)).cast("int").alias("digits"))
    name = F.substring("identity", F.lit(1), F.coalesce("digits", F.lit(0)))
    placed = postings.join(digits, "token", "left").select("token", name.alias("slice"), "identity")
    blocks = placed.groupBy("token", "slice").agg(F.sort_array(F.collect_list("identity")).alias("identities"))
    return blocks.select(
        "token",
        "slice",
        F.size("identities").cast("long").alias("n"),
        F.element_at("identities", 1).alias("first"),
        F.element_at("identities", -1).alias("last"),
        "identities",
    )


def write_index(blocks: DataFrame, path: str) -> None:
    """Sort by token and slice, so that a look-up prunes files and row groups; a frequent token spans many files."""
    columns = ["token", "slice"]
    blocks.repartitionByRange(*columns).sortWithinPartitions(*columns).write.option("compression", "zstd").parquet(path)


def token_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("texts"))


def search_texts(
    queries: DataFrame, rows: DataFrame, identity: str, column: str, index: DataFrame | None = None, tokens: Column | None = None
) -> DataFrame:
    """Texts that hold all tokens of a query, for every query (query_id, query_text).

    Each query looks up its rarest token only; its candidates are then checked
    against the text's token list. Tokens that most texts share are therefore
    never joined unless a query has nothing rarer. With a stored ``index`` only
    the candidates are taken apart; without one the texts are, twice. ``tokens``:
    how to take a text apart, ``token_list`` by default.
    """
    tokens = token_list(F.col(column)) if tokens is None else tokens
    wanted = queries.select("query_id", token_list(F.col("query_text")).alias("query_tokens")).filter(
        F.size("query_tokens") > 0
    )
    terms = wanted.select("query_id", F.explode("query_tokens").alias("token"))
    if index is None:
        index = rows.select(F.explode(tokens).alias("token"), identity)
    used = index.join(terms.select("token").distinct(), "token", "left_semi")
    rarest = (
        terms.join(token_frequencies(used), "token")
        .groupBy("query_id")
        .agg(F.min_by("token", F.struct("texts", "token")).alias("token"))
    )
    candidates = index.join(rarest, "token").select("query_id", identity)
    return (
        candidates.join(rows.select(identity, column), identity)
        .join(wanted, "query_id")
        .filter(F.size(F.array_except("query_tokens", tokens)) == 0)
        .select("query_id", identity)
    )


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(token_list(F.col("query_text"))).alias("token"))


def ranked_terms(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Terms with texts, digits and ``place``, 1 for the rarest of the query; a term that stands nowhere comes first."""
    sizes = blocks.groupBy("token").agg(F.sum("n").alias("texts"), F.max(F.length("slice")).alias("digits"))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("texts"), "token")
    return terms.join(sizes, "token", "left").withColumn("place", F.row_number().over(order))


def rarest_postings(ranked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, identity) of the texts that hold the rarest term of a query; none if a term stands nowhere."""
    rarest = ranked.filter("place = 1 and texts is not null").select("query_id", "token")
    return blocks.join(rarest, "token").select("query_id", F.explode("identities").alias("identity"))


def holding(candidates: DataFrame, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, identity, held): how many of the query's ``terms`` a candidate holds.

    Only blocks that bear the slice of a candidate, and whose first and last identity enclose one, are opened.
    """
    asked = candidates.join(terms.select("query_id", "token", "digits"), "query_id").select(
        "query_id", "identity", "token", F.substring("identity", F.lit(1), F.col("digits")).alias("slice")
    )
    spans = asked.groupBy("token", "slice").agg(F.min("identity").alias("low"), F.max("identity").alias("high"))
    open_blocks = blocks.join(spans, ["token", "slice"]).filter("first <= high and last >= low")
    entries = open_blocks.select("token", F.explode("identities").alias("identity"))
    found = asked.select("query_id", "identity", "token").join(entries, ["token", "identity"])
    return found.groupBy("query_id", "identity").agg(F.count(F.lit(1)).alias("held"))


def search_index(queries: DataFrame, blocks: DataFrame, identity: str) -> DataFrame:
    """Texts that hold all tokens of a query, over posting blocks alone (see ``posting_blocks``), rarest token first.

    The postings of each query's rarest token are its candidates; the next rarest token thins them out, and the others
    are looked up for what is left. No step has more rows than candidates times the terms of a query.
    """
    terms = query_terms(queries)
    used = reused(blocks.join(terms.select("token").distinct(), "token", "left_semi"))
    ranked = reused(ranked_terms(terms, used))
    sizes = ranked.groupBy("query_id").agg(F.max("place").alias("terms"))
    candidates = reused(rarest_postings(ranked, used).join(sizes, "query_id"))
    thinned = holding(candidates, ranked.filter("place = 2"), used).join(sizes, "query_id").drop("held")
    thinned = reused(thinned.unionByName(candidates.filter("terms = 1").select(thinned.columns)))
    rest = holding(thinned.filter("terms > 2"), ranked.filter("place > 2"), used).join(sizes, "query_id")
    whole = rest.filter("held = terms - 2").unionByName(thinned.filter("terms <= 2").withColumn("held", F.lit(0).cast("long")))
    return whole.select("query_id", F.col("identity").alias(identity))


def search_figures(queries: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """Figures of the page of hits of every query, those without a hit included: hits, page_limit, has_more."""
    pages = search_names(queries, names, limit).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = F.coalesce("n", F.lit(0))
    return queries.select("query_id").join(pages, "query_id", "left").select(
        "query_id", hits.alias("hits"), F.lit(limit).alias("page_limit"), (hits == limit).alias("has_more")
    )


def _form(tokens: Column) -> Column:
    """Tokens of a name in one order, as text; tokens hold no blanks."""
    return F.array_join(F.array_sort(tokens), " ")


def search_names(queries: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` names with all tokens of each query, by title and identity.

    ``names``: thinker_qid, thinker_name, wikiquote_title. Returns the hits with
    their ``hit_rank`` and ``has_more``, true when the page is full.
    Names with equal tokens answer the same queries, so queries meet the distinct
    forms, and each form shows its first ``limit`` names. Repeated identities, which
    count by their rows, are searched one by one.
    """
    order = [F.asc_nulls_last("wikiquote_title"), F.asc("thinker_qid")]
    known = names.filter("thinker_qid is not null").select("thinker_qid", "thinker_name", "wikiquote_title")
    copies = F.count(F.lit(1)).over(Window.partitionBy("thinker_qid"))
    counted = dealt_by_rows(known, "thinker_qid").withColumn("copies", copies)
    formed = counted.filter("copies = 1").withColumn("form", _form(token_list(F.col("thinker_name")))).filter("form <> ''")
    shown = reused(first_per_key(formed.drop("copies"), ["form"], order, n=limit))
    repeated = reused(counted.filter("copies > 1").drop("copies"))
    forms = shown.select("form").distinct()
    hits = search_texts(queries, forms, "form", "form", tokens=F.split("form", " ")).join(shown, "form").drop("form")
    hits = hits.unionByName(search_texts(queries, repeated, "thinker_qid", "thinker_name").join(repeated, "thinker_qid").select(hits.columns))
    kept = first_per_key(hits, ["query_id"], order, n=limit)
    # At most ``limit`` rows of a query are left here.
    paged = kept.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("wikiquote_title", "thinker_qid", "thinker_name"))).alias("hits")
    )
    return paged.select(
        "query_id", F.posexplode("hits").alias("hit_rank", "hit"), (F.size("hits") == limit).alias("has_more")
    ).select("query_id", (F.col("hit_rank") + 1).alias("hit_rank"), "hit.*", "has_more")


def resolve_names(queries: DataFrame, names: DataFrame, entities: DataFrame) -> DataFrame:
    """Best title and entity of each vague name; ``entities``: thinker_qid, entity_qid (nullable)."""
    best = reused(search_names(queries, names, limit=1).select("query_id", "wikiquote_title", "thinker_qid"), plain=True)
    found = queries.select("query_id", "query_text").join(best, "query_id", "left")
    # Only entities that were found are sorted and joined.
    asked = entities.select("thinker_qid", "entity_qid").join(best.select("thinker_qid").distinct(), "thinker_qid", "left_semi")
    known = found.join(asked, "thinker_qid", "left")
    status = (
        F.when(F.col("wikiquote_title").isNull(), "not_found")
        .when(F.coalesce("entity_qid", F.lit("")) == "", "no_entity")
        .otherwise("resolved")
    )
    return known.select(
        "query_id", "query_text", status.alias("status"), F.col("wikiquote_title").alias("title"), "entity_qid"
    )


def _deletions(text: str, n: int) -> str:
    """SQL: the distinct texts that are left when up to ``n`` characters of ``text`` go."""
    each = "transform(sequence(1, length({0})), i{1} -> concat(substring({0}, 1, i{1} - 1), substring({0}, i{1} + 1)))"
    made, level = f"array({text})", f"array({text})"
    for k in range(n):
        level = f"flatten(transform({level}, x{k} -> {each.format(f'x{k}', k)}))"
        made = f"concat({made}, {level})"
    return f"array_distinct({made})"


def _typos(token: str) -> str:
    """SQL: edits that a searched token may be away from a term."""
    return f"case when length({token}) between 4 and 7 then 1 when length({token}) between 8 and {LONGEST_TYPO} then 2 else 0 end"


def matching_terms(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, term, penalty): terms that a searched token stands for.

    0 for the term itself, 1 for a term that begins with the token, 1 + d for one that is d edits away, where d is at
    most 1 for tokens of 4 to 7 characters and 2 for 8 to ``LONGEST_TYPO``. Beginnings come from a dictionary of all
    beginnings of the terms, edits from the texts that remain when characters are left out on both sides, both by
    equal joins; the distance is then measured on the pairs that met.
    """
    starts = vocabulary.select("term", F.expr("explode(transform(sequence(1, length(term)), i -> substring(term, 1, i)))").alias("token"))
    begun = tokens.join(starts, "token").select("token", "term", F.when(F.col("token") == F.col("term"), 0).otherwise(1).alias("penalty"))

    def left_out(df: DataFrame, column: str, one: str, two: str) -> DataFrame:
        rest = f"case when {two} then {_deletions(column, 2)} when {one} then {_deletions(column, 1)} else array() end"
        return df.select(column, F.expr(f"explode({rest})").alias("rest"))

    asked = left_out(tokens, "token", f"{_typos('token')} = 1", f"{_typos('token')} = 2")
    # A token of n characters with d typos can stand for terms of n - d to n + d characters.
    terms = left_out(vocabulary, "term", "length(term) between 3 and 5", f"length(term) between 6 and {LONGEST_TYPO + 2}")
    met = asked.join(terms, "rest").select("token", "term").distinct().withColumn("d", F.levenshtein("token", "term"))
    near = met.filter(F.col("d") <= F.expr(_typos("token"))).select("token", "term", F.when(F.col("d") == 0, 0).otherwise(F.col("d") + 1).alias("penalty"))
    return begun.unionByName(near).groupBy("token", "term").agg(F.min("penalty").cast("int").alias("penalty"))


def search_names_partial(queries: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` names for which each token of a query stands for some term, by penalty, title and identity.

    The best term counts for each token. Names with equal tokens have equal penalties, so queries meet the distinct forms,
    and each form shows its first ``limit`` names. Forms are found by the token that stands for the fewest; the other tokens
    are only compared with the terms of these forms, which a candidate carries along. Returns the hits with ``hit_rank`` and
    ``penalty``.
    """
    order = [F.asc_nulls_last("wikiquote_title"), F.asc("thinker_qid")]
    dealt = dealt_by_rows(names.filter("thinker_qid is not null"), "thinker_qid")
    # All tokens of an identity, however many names it has.
    held = dealt.select("thinker_qid", F.explode(token_list(F.col("thinker_name"))).alias("term")).groupBy("thinker_qid")
    formed = dealt.join(held.agg(_form(F.collect_set("term")).alias("form")), "thinker_qid")
    shown = reused(
        first_per_key(formed.select("form", "thinker_qid", "thinker_name", "wikiquote_title"), ["form"], order, n=limit)
    )
    forms = shown.select("form").distinct()
    terms = reused(forms.select("form", F.explode(F.split("form", " ")).alias("term")))
    asked = reused(query_terms(queries))
    known = terms.groupBy("term").agg(F.count(F.lit(1)).alias("forms"))
    matches = reused(matching_terms(asked.select("token").distinct(), known.select("term")))
    sizes = matches.join(known, "term").groupBy("token").agg(F.sum("forms").alias("forms"))
    place = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("forms"), "token")
    ranked = asked.join(sizes, "token", "left").withColumn("place", F.row_number().over(place))
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.collect_set("token").alias("tokens"))
    rarest = ranked.filter("place = 1 and forms is not null").select("query_id", "token").join(wanted, "query_id")
    candidates = rarest.join(matches.select("token", "term"), "token").join(terms, "term").select("query_id", "wanted", "tokens", "form").distinct()
    pairs = (
        candidates.select("query_id", "wanted", "form", F.explode("tokens").alias("token"))
        .select("*", F.explode(F.split("form", " ")).alias("term"))
        .join(matches, ["token", "term"])
    )
    best = pairs.groupBy("query_id", "wanted", "form", "token").agg(F.min("penalty").alias("penalty"))
    hits = best.groupBy("query_id", "wanted", "form").agg(F.count(F.lit(1)).alias("held"), F.sum("penalty").alias("penalty"))
    whole = hits.filter("held = wanted").join(shown, "form")
    rank = Window.partitionBy("query_id").orderBy("penalty", *order)
    return (
        whole.withColumn("hit_rank", F.row_number().over(rank))
        .filter(F.col("hit_rank") <= limit)
        .select("query_id", "hit_rank", "wikiquote_title", "thinker_qid", "thinker_name", "penalty")
    )
