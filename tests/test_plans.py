"""Plans against brute force on small fixtures, with one key holding most rows."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lapidary import session
from lapidary.functions import ids
from lapidary.operators import picks
from lapidary.operators import violations as v
from lapidary.plans import checks, gold, profiles, reports, search, selection, silver
from lapidary.sources import tables

QUOTE = """occurrence_id string, quote_id string, thinker_qid string, thinker_name string, quote_text string,
    original_text string, original_language string, category string, work string, source_url string, source_name string,
    source_license string, translator_name string, translation_license string, translation_url string,
    character_count long, is_daily_eligible boolean"""
REQUEST = "request_id long, on_date string, thinker string, collection string, category string, max_length long"


def sha(value):
    return hashlib.sha256(value.encode()).hexdigest()


def seed(key):
    return int(sha(key)[:16], 16)


@pytest.fixture(scope="module")
def catalogue():
    return {"a": ["N0", "N1"], "b": ["N1", "N2", "N9"]}


@pytest.fixture(scope="module")
def quotes():
    generator = random.Random(3)
    rows = []
    for i in range(3000):
        who = 0 if i % 3 else generator.randint(0, 4)
        category = generator.choice(["verificada", "obra", "atribuida"])
        size = generator.randint(10, 90)
        rows.append(
            (sha(f"o{i}"), sha(f"q{i}"), f"Q{who}", f"N{who}", f"text {i}", None, None, category, None, "https://u", "S",
             "L", None, None, None, size, i % 4 != 0)
        )
    return rows


@pytest.fixture(scope="module")
def frames(spark, quotes, catalogue):
    members = [(slug, slug.upper(), name) for slug, names in catalogue.items() for name in names]
    thinkers = [(f"Q{i}", f"N{i}") for i in range(5)]
    return (
        spark.createDataFrame(quotes, QUOTE).repartition(4),
        spark.createDataFrame(thinkers, "thinker_qid string, thinker_name string"),
        spark.createDataFrame(members, "slug string, title string, thinker_name string"),
    )


@pytest.fixture(scope="module")
def requests():
    generator = random.Random(5)
    options = (
        [None, "N0", "N1", "N2", "N3", "N9", "N77", ""],
        [None, "a", "b", "zzz", ""],
        [None, "verificada", "obra", "atribuida"],
        [None, 0, 12, 30, 60, 1000],
    )
    return [
        (i, f"2026-07-{i % 28 + 1:02d}", *[generator.choice(choices) for choices in options]) for i in range(400)
    ]


def expected_daily(request, quotes, catalogue, version):
    _, on_date, thinker, slug, category, limit = request
    names = {n for members in catalogue.values() for n in members}
    if slug and slug not in catalogue:
        return "unknown_collection", None
    if thinker and thinker not in names:
        return "unknown_thinker", None
    if thinker and slug and thinker not in catalogue[slug]:
        return "not_in_collection", None
    wanted = {thinker} if thinker else set(catalogue[slug]) if slug else names
    rows = sorted(
        q[0]
        for q in quotes
        if q[16] and q[3] in wanted and (category is None or q[7] == category) and (limit is None or q[15] <= limit)
    )
    if not rows:
        return "no_match", None
    key = "|".join([version, on_date, thinker or "", slug or "", category or "", str(limit or "")])
    return "ok", rows[seed(key) % len(rows)]


def test_daily_selection_equals_brute_force(spark, frames, quotes, catalogue, requests):
    facts, thinkers, members = frames
    df = spark.createDataFrame(requests, REQUEST)
    got = selection.daily_selection(df, facts, thinkers, members, "0123456789abcdef")
    found = {r.request_id: (r.status, r.occurrence_id) for r in got.collect()}
    assert found == {r[0]: expected_daily(r, quotes, catalogue, "0123456789abcdef") for r in requests}
    assert {"ok", "no_match", "unknown_collection", "unknown_thinker", "not_in_collection"} == {s for s, _ in found.values()}


def test_collection_samples(spark, frames, quotes, catalogue):
    facts, thinkers, members = frames
    got = selection.collection_samples(members.select("slug").distinct(), "2026-07-13", facts, thinkers, members, "v")
    for row in got.collect():
        assert (row.mode, row.dataset_version, row.dataset_schema) == ("daily", "v", 3)
        assert row.collection_title == row.collection.upper()
        wanted = expected_daily((0, "2026-07-13", None, row.collection, None, None), quotes, catalogue, "v")
        assert (row.status, row.occurrence_id) == wanted


def test_two_stage_selection_equals_brute_force(spark, frames, quotes, catalogue, requests):
    facts, _, members = frames
    df = spark.createDataFrame(requests, REQUEST)
    found = {r.request_id: (r.status, r.occurrence_id) for r in selection.two_stage_selection(df, facts, members).collect()}
    names = {n for listed in catalogue.values() for n in listed}
    for request in requests:
        number, on_date, thinker, slug, category, limit = request
        if slug and slug not in catalogue:
            wanted = ("unknown_collection", None)
        elif thinker and slug and thinker not in catalogue[slug]:
            wanted = ("not_in_collection", None)
        else:
            key = "|".join([on_date, thinker or "", slug or "", category or "", str(limit or "")])
            candidates = {thinker} if thinker else set(catalogue[slug]) if slug else names
            fits = lambda q: (category is None or q[7] == category) and (limit is None or q[15] <= limit)
            able = sorted({q[3] for q in quotes if q[3] in candidates and fits(q)}, key=sha)
            wanted = ("no_match", None)
            if able:
                name = able[seed(key) % len(able)]
                rows = sorted(q[0] for q in quotes if q[3] == name and fits(q))
                wanted = ("ok", rows[seed(f"{key}|quote") % len(rows)])
        assert found[number] == wanted


def test_random_mode_repeats_only_with_a_seed(spark, frames):
    facts, _, members = frames
    df = spark.createDataFrame([(i, "", None, None, None, None) for i in range(200)], REQUEST)

    def draw(random_seed=None):
        rows = selection.two_stage_selection(df, facts, members, mode="random", random_seed=random_seed).collect()
        return {r.request_id: (r.status, r.occurrence_id) for r in rows}

    first = draw(1)
    assert first == draw(1) != draw(2)
    assert draw() != draw()
    by_status = {status for status, _ in first.values()}
    assert by_status == {"ok"}


@pytest.mark.parametrize(("offset", "limit"), [(0, 7), (25, 10), (1900, 300), (5000, 10)])
def test_pages_equal_brute_force(frames, quotes, offset, limit):
    rows = frames[0].select("thinker_qid", "occurrence_id")
    got = {}
    for r in picks.page_of(rows, ["thinker_qid"], "occurrence_id", offset, limit).collect():
        got.setdefault(r.thinker_qid, []).append((r.position, r.occurrence_id, r.total, r.page_count, r.has_more))
    for who in {q[2] for q in quotes}:
        ordered = sorted(q[0] for q in quotes if q[2] == who)
        page = ordered[offset : offset + limit]
        wanted = [(offset + i, o, len(ordered), len(page), offset + limit < len(ordered)) for i, o in enumerate(page)]
        assert sorted(got.get(who, [])) == wanted


def test_pages_with_null_identities_and_null_keys(spark):
    rows = spark.createDataFrame([("a", None), ("a", "00f"), ("a", "fff"), (None, "1"), (None, None)], "k string, i string")
    got = sorted(((r.k or "", r.position, r.i, r.total) for r in picks.page_of(rows, ["k"], "i", 0, 10).collect()))
    assert got == [("", 0, "1", 2), ("", 1, None, 2), ("a", 0, "00f", 3), ("a", 1, "fff", 3), ("a", 2, None, 3)]
    assert [(r.i, r.has_more) for r in picks.page_of(rows, ["k"], "i", 2, 1, digits=1).collect()] == [(None, False)]


def test_figures_of_empty_pages(spark):
    totals = spark.createDataFrame([("a", 0), ("b", 30), ("c", 36)], "k string, total long")
    got = {r.k: (r.total, r.page_count, r.page_offset, r.page_limit, r.has_more) for r in picks.page_figures(totals, 25, 10).collect()}
    assert got == {"a": (0, 0, 25, 10, False), "b": (30, 5, 25, 10, False), "c": (36, 10, 25, 10, True)}


def test_reuse_needs_no_folder(spark, monkeypatch):
    """A query that reads its rows more than once gives the same answer where no shared folder is named."""
    from bindings import registry
    from lapidary import session

    def answer():
        return registry.QUERIES["collection_audit"](spark, "/root/testdata/sf0.001").collect()

    with_folder = answer()
    monkeypatch.setattr(session, "shared_folder", lambda spark: None)
    assert answer() == with_folder
    assert session.reused(spark.range(3)).storageLevel.useDisk


def test_latest_snapshot_wins_and_copies_are_dropped(spark):
    rows = [("Q1", "Ana", "Uma  frase", "obra", None, "https://u", "S", "L", 1, datetime(2026, 1, d % 9 + 1)) for d in range(900)]
    rows += [("Q1", "Ana", "Uma frase", "obra", "Livro", "https://u", "S", "L", 1, datetime(2026, 1, 1))]
    rows += [("Q1", "Ana", None, "obra", "Livro", "https://u", "S", "L", 1, datetime(2026, 1, 1))]
    bronze = spark.createDataFrame(rows, tables.BRONZE_QUOTES).repartition(4)
    out = silver.normalise_quotes(bronze, spark.createDataFrame([], tables.BRONZE_SUPPLEMENTAL)).collect()
    kept = {r.work: r for r in out if r.quote_text is not None}
    assert len(out) == 3 and kept[None].fetched_at == datetime(2026, 1, 9)
    assert kept[None].quote_id == kept["Livro"].quote_id == sha("Q1|Uma frase")
    assert kept[None].occurrence_id == sha(f"{sha('Q1|Uma frase')}|obra||1|https://u")
    assert [r.occurrence_id for r in out if r.quote_text is None] == [None]


def test_null_text_keeps_three_valued_flags(spark):
    schema = "thinker_qid string, quote_id string, quote_text string, category string, work string, character_count long"
    df = spark.createDataFrame([("Q1", None, None, "obra", None, None)], schema)
    row = gold.curate(df, spark.createDataFrame([], tables.SELECTION_SEED)).first()
    assert (row.curation_status, row.quality_reason, row.passes_automatic_rules) == ("accepted", "passed_automatic_rules", None)


def test_reasons_come_in_priority_order(spark):
    schema = "thinker_qid string, quote_id string, quote_text string, category string, work string, character_count long"
    rows = [
        ("Q1", "q1", "...curta", "atribuida", "Frases ATRIBUÍDAS", 9),
        ("Q1", "q2", "x" * 501, "obra", None, 501),
        ("Q1", "q3", "Memorial IV. 8", "atribuida", None, 14),
    ]
    out = {r.quote_id: r for r in gold.curate(spark.createDataFrame(rows, schema), spark.createDataFrame([("Q1", "q2")], tables.SELECTION_SEED)).collect()}
    assert out["q1"].quality_reasons == ["short_text", "attributed_quote", "leading_fragment", "attribution_section"]
    assert out["q2"].quality_reasons == ["long_text"] and out["q2"].editorial_approved and not out["q2"].is_daily_eligible
    assert out["q3"].curation_status == "rejected" and out["q3"].quality_reason == "citation_only"


def test_coverage_reports_gaps(spark, frames):
    facts, thinkers, members = frames
    rows = {r.slug: r for r in reports.collection_coverage(facts, thinkers, members).collect()}
    assert (rows["a"].members, rows["a"].covered_members, rows["a"].uncovered) == (2, 2, [])
    assert (rows["b"].members, rows["b"].covered_members, rows["b"].uncovered) == (3, 2, ["N9"])
    audit = reports.collection_audit(facts, thinkers, members).first()
    assert audit.total_records == 3000 and audit.thinkers == 5 and not audit.fully_covered and audit.duplicate_texts == 0
    nobody = reports.collection_audit(facts.withColumn("is_daily_eligible", F.lit(False)), thinkers, members).first()
    assert (nobody.eligible_quotes, nobody.fewest_per_thinker, nobody.most_per_thinker) == (0, 0, 0)


def test_full_coverage_verdict(spark):
    rows = [
        (f"o{i}{k}", f"q{i}{k}", f"Q{i}", f"N{i}", f"t{i}{k}", None, None, "obra", None, "u", "S", "L", None, None, None, 44, True)
        for i in range(3)
        for k in range(3)
    ]
    facts = spark.createDataFrame(rows, QUOTE)
    thinkers = spark.createDataFrame([(f"Q{i}", f"N{i}") for i in range(3)], "thinker_qid string, thinker_name string")
    members = spark.createDataFrame([("c", "C", f"N{i}") for i in range(3)], "slug string, title string, thinker_name string")
    assert reports.collection_audit(facts, thinkers, members).first().fully_covered
    assert not reports.collection_audit(facts.limit(8), thinkers, members).first().fully_covered


def test_duplicate_texts_fold_case_and_blanks(spark):
    texts = ["Straße  a", "STRASSE A", "strasse a", "outra", "outra ", "só"]
    df = spark.createDataFrame([(t,) for t in texts], "quote_text string")
    assert reports.duplicate_texts(df).first()[0] == 3


def test_generic_violations(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, n int")
    assert v.repeated_keys(df, ["k"]).collect()[0][:] == ("a", 2)
    assert [r[:] for r in v.unaccepted_values(df, "k", ["a"]).collect()] == [("b", 1)]
    assert [r[:] for r in v.null_counts(df, ["k", "n"]).orderBy("column_name").collect()] == [("k", 2), ("n", 0)]
    parent = spark.createDataFrame([("a",)], "id string")
    assert [r[:] for r in v.orphans(df, "k", parent, "id").collect()] == [("b", 1)]
    assert v.null_rows(df, "k").count() == 2


def test_pairs_of_repeated_quotes_are_counted_not_formed(spark):
    rows = [("q", "supplemental")] * 300 + [("q", "wikiquote")] * 400 + [("r", "wikiquote")]
    df = spark.createDataFrame(rows, "quote_id string, source_kind string")
    assert checks.supplemental_repeats(df).collect()[0][:] == ("q", 300, 400, 120_000)


def test_queue_checks_can_be_switched_off(spark, frames):
    facts, thinkers, _ = frames
    queue = spark.createDataFrame([("Q1", "gone", "pending", "complete_and_distinct")], tables.QUEUE_SEED)
    assert checks.queue_missing(queue, facts).count() == 1
    assert checks.queue_missing(queue, facts, enabled=False).count() == 0
    balance = {r[:] for r in checks.queue_balance(queue, thinkers, expected=1, exempt=("Q0",)).collect()}
    assert balance == {("Q2", 0), ("Q3", 0), ("Q4", 0)}


def test_search_equals_brute_force(spark):
    generator = random.Random(11)
    words = ["água", "Agua", "rio", "pedra", "ção", "x1", "STRASSE"]
    texts = [(f"t{i}", " ".join(["comum", *generator.choices(words, k=3)]) + "!") for i in range(400)]
    queries = [("q1", "agua comum"), ("q2", "COMUM"), ("q3", "rio, pedra"), ("q4", "nada rio"), ("q5", "?!"), ("q6", "Çao")]
    rows = spark.createDataFrame(texts, "id string, text string")
    got = search.search_texts(spark.createDataFrame(queries, "query_id string, query_text string"), rows, "id", "text")

    def tokens(text):
        plain = text.lower().translate(str.maketrans("áçã", "aca"))
        return set("".join(c if c.isalnum() else " " for c in plain).split())

    wanted = {(q, t) for q, words in queries for t, text in texts if tokens(words) and tokens(words) <= tokens(text)}
    assert {r[:] for r in got.collect()} == wanted and got.count() == len(wanted)


def test_names_are_found_and_resolved(spark):
    names = spark.createDataFrame(
        [("Q1", "Ana Sá", "Ana Sá"), ("Q2", "Ana Rui", "Ana Rui"), ("Q3", "Zé Ana", "Zé Ana")],
        "thinker_qid string, thinker_name string, wikiquote_title string",
    )
    queries = spark.createDataFrame([("1", "ana"), ("2", "ze"), ("3", "sa ana"), ("4", "x")], "query_id string, query_text string")
    hits = search.search_names(queries, names, limit=2).collect()
    assert sorted((r.query_id, r.hit_rank, r.thinker_qid, r.has_more) for r in hits) == [
        ("1", 1, "Q2", True), ("1", 2, "Q1", True), ("2", 1, "Q3", False), ("3", 1, "Q1", False),
    ]
    known = spark.createDataFrame([("Q1", "E1"), ("Q2", None), ("Q3", "E3")], "thinker_qid string, entity_qid string")
    out = {r.query_id: (r.status, r.title, r.entity_qid) for r in search.resolve_names(queries, names, known).collect()}
    assert out == {
        "1": ("no_entity", "Ana Rui", None),
        "2": ("resolved", "Zé Ana", "E3"),
        "3": ("resolved", "Ana Sá", "E1"),
        "4": ("not_found", None, None),
    }


def test_profiles_and_influences(spark):
    entity = "wikibase-entityid"
    claims = spark.createDataFrame(
        [
            ("Q1", "P569", 0, "normal", "time", None, "+1844-01-01T00:00:00Z", 9),
            ("Q1", "P569", 1, "preferred", "time", None, "+1844-10-15T00:00:00Z", 11),
            ("Q1", "P570", 0, "normal", "string", None, None, None),
            ("Q1", "P19", 0, "deprecated", entity, "L1", None, None),
            ("Q1", "P19", 1, "normal", entity, "L9", None, None),
            ("Q1", "P19", 2, "normal", entity, "L2", None, None),
            ("Q1", "P106", 0, "normal", entity, "L3", None, None),
            ("Q1", "P106", 1, "normal", entity, "L2", None, None),
            ("Q1", "P106", 2, "normal", entity, "L3", None, None),
            ("Q1", "P800", 0, None, entity, "L4", None, None),
            ("Q1", "P737", 0, "normal", entity, "L4", None, None),
            ("Q1", "P737", 1, "normal", entity, "L3", None, None),
            ("Q1", "P737", 2, "normal", entity, "L4", None, None),
            ("Q1", "P737", 3, "normal", entity, "L9", None, None),
        ],
        "qid string, pid string, pos int, rank string, vtype string, ref_id string, time string, precision int",
    )
    labels = spark.createDataFrame(
        [("L1", "pt", "um"), ("L2", "en", "two"), ("L2", "pt", "dois"), ("L3", "en", "three"), ("L4", "pt", "quatro"), ("L9", "de", "neun")],
        "qid string, lang string, value string",
    )
    descriptions = spark.createDataFrame([("Q1", "en", "thinker")], "qid string, lang string, value string")
    entities = spark.createDataFrame([("Q1", "Ana"), ("Q2", "Bia")], "qid string, name string")
    rows = profiles.entity_profiles(entities, claims, labels, descriptions)
    out = {r.qid: r for r in rows.collect()}
    ana, bia = out["Q1"], out["Q2"]
    assert (ana.nascimento.exibicao, ana.morte, ana.local_nascimento, ana.descricao) == ("15/10/1844", None, "dois", "thinker")
    assert (ana.ocupacoes, ana.nacionalidade) == (["three", "dois", "three"], [])
    assert [w.asDict() for w in ana.obras] == [{"titulo": "quatro", "qid": "L4"}]
    assert (ana.fontes[0].fonte, ana.fontes[0].licenca, ana.fontes[0].url) == ("Wikidata", "CC0 1.0", "https://www.wikidata.org/wiki/Q1")
    assert (bia.nascimento, bia.ocupacoes, bia.obras, bia.local_nascimento) == (None, [], [], None)
    assert {r.ref_id for r in profiles.referenced_ids(claims).collect()} == {"L9", "L2", "L3", "L4"}

    edges = profiles.influence_edges(claims, labels).orderBy("pos").collect()
    assert [(r.influence_qid, r.nome, r.url) for r in edges] == [
        ("L4", "quatro", "https://www.wikidata.org/wiki/L4"),
        ("L3", "three", "https://www.wikidata.org/wiki/L3"),
    ]

    quotes = spark.createDataFrame(
        [("Q1", i, f"frase {i}", "obra", "Livro", "Wikiquote", "CC BY-SA 4.0", "https://p") for i in range(30)],
        "qid string, item_no int, text string, category string, work string, source_name string, source_license string, source_url string",
    )
    pages = spark.createDataFrame([("Q1",)], "qid string")
    full = {r.qid: r for r in profiles.thinker_profiles(rows, pages, quotes, ["item_no"], sample=3).collect()}
    assert [q.texto for q in full["Q1"].frases] == ["frase 0", "frase 1", "frase 2"] and full["Q1"].aviso is None
    assert [f.fonte for f in full["Q1"].fontes] == ["Wikidata", "Wikiquote"]
    assert full["Q2"].frases == [] and full["Q2"].aviso.startswith("Frases indisponíveis")
    assert [f.fonte for f in full["Q2"].fontes] == ["Wikidata"]
    none = profiles.thinker_profiles(rows, pages, quotes, ["item_no"], sample=0).filter("qid = 'Q1'").first()
    assert none.frases == [] and none.aviso is None and len(none.fontes) == 1


def test_many_distinct_limits(spark):
    generator = random.Random(3)
    quotes = [
        (f"N{generator.randrange(4)}", generator.choice(["a", "b", None]), generator.choice([None, *range(1, 9000)]), sha(str(i)))
        for i in range(6000)
    ]
    asked = [(i, "all" if i % 3 else "t:N1", generator.choice([None, "a", "b"]), i + 1 if i % 11 else None, sha(f"s{i}")) for i in range(5200)]
    requests = spark.createDataFrame(asked, "request_id long, scope string, category string, max_length long, key string")
    requests = requests.withColumn("seed", ids.seed(F.col("key"))).drop("key")
    members = spark.createDataFrame([("all", f"N{i}") for i in range(3)] + [("t:N1", "N1")], "scope string, thinker_name string")
    rows = spark.createDataFrame(quotes, "thinker_name string, category string, character_count long, occurrence_id string")
    for leaf_rows in (256, 1):
        found = {r.request_id: (r.matches, r.occurrence_id) for r in picks.pick_by_seed(rows, requests, members, leaf_rows).collect()}
        ordered = sorted(quotes, key=lambda q: q[3])
        for number, scope, category, limit, key in asked[::40]:
            names = {"N1"} if scope == "t:N1" else {"N0", "N1", "N2"}
            fits = [
                q[3]
                for q in ordered
                if q[0] in names and (category is None or q[1] == category) and (limit is None or q[2] is not None and q[2] <= limit)
            ]
            assert found.get(number) == ((len(fits), fits[seed(key) % len(fits)]) if fits else None)


def search_rows(n=3000):
    generator = random.Random(12)
    rare = [f"raro{i}" for i in range(60)]
    return [(sha(str(i)), " ".join(["comum", *generator.choices(["rio", "mar", "sol"], k=2), generator.choice(rare)])) for i in range(n)]


def test_posting_blocks_are_even_and_whole(spark):
    texts = search_rows()
    rows = spark.createDataFrame(texts, "id string, text string")
    blocks = search.posting_blocks(rows, "id", "text", block=16).collect()
    lists = {}
    for b in blocks:
        assert b.identities == sorted(b.identities) and (b.first, b.last, b.n) == (b.identities[0], b.identities[-1], len(b.identities))
        assert all(i.startswith(b.slice) for i in b.identities) and b.n <= 16 * 4
        lists.setdefault(b.token, []).extend(b.identities)
    assert sorted(lists["comum"]) == sorted(i for i, _ in texts)
    assert {t: sorted(x) for t, x in lists.items()} == {t: sorted(i for i, text in texts if t in text.split()) for t in lists}


def test_index_search_starts_from_the_rarest_postings(spark):
    texts = search_rows()
    rows = spark.createDataFrame(texts, "id string, text string")
    queries = [("q1", "comum rio raro7"), ("q2", "raro3"), ("q3", "comum nada"), ("q4", "Rio mar comum raro9"), ("q5", "?"), ("q6", "raro1 raro2"), ("q7", "sol rio")]
    asked = spark.createDataFrame(queries, "query_id string, query_text string")
    blocks = search.posting_blocks(rows, "id", "text", block=16)
    got = [r[:] for r in search.search_index(asked, blocks, "id").collect()]
    words = {i: set(text.split()) for i, text in texts}
    wanted = {(q, i) for q, text in queries for i in words if text != "?" and set(text.lower().split()) <= words[i]}
    assert set(got) == wanted and len(got) == len(wanted) and any(q == "q7" for q, _ in wanted)
    # The rows of the first join are the postings of the rarest terms; the look-ups have one row for each of a query's other terms.
    terms = search.query_terms(asked)
    ranked = search.ranked_terms(terms, blocks.join(terms.select("token").distinct(), "token", "left_semi"))
    candidates = search.rarest_postings(ranked, blocks)
    frequency = {t: sum(t in w for w in words.values()) for t in ("raro7", "raro3", "raro9", "raro1", "raro2", "sol", "rio")}
    bound = frequency["raro7"] + frequency["raro3"] + frequency["raro9"] + min(frequency["raro1"], frequency["raro2"]) + min(frequency["sol"], frequency["rio"])
    assert candidates.count() == bound < len(texts)
    held = search.holding(candidates, ranked.filter("place = 2"), blocks)
    assert held.count() <= bound


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_partial_names_equal_brute_force(spark):
    generator = random.Random(8)

    def word():
        return "".join(generator.choices("abcdé", k=generator.randrange(1, 13)))

    vocabulary = [word() for _ in range(120)]
    names = [(f"Q{i}", " ".join(generator.choices(vocabulary, k=generator.randrange(1, 4))), generator.choice([None, f"T{i % 7}"])) for i in range(150)]

    def spoilt(text):
        at = generator.randrange(len(text))
        return generator.choice([text[:3], text[:at] + text[at + 1 :], text[:at] + "x" + text[at:], text[:at] + "x" + text[at + 1 :], text])

    asked = {" ".join(spoilt(w) for w in generator.choices(vocabulary, k=generator.randrange(1, 3))) for _ in range(150)}
    queries = [(q, q) for q in asked]
    got = search.search_names_partial(
        spark.createDataFrame(queries, "query_id string, query_text string"),
        spark.createDataFrame(names, "thinker_qid string, thinker_name string, wikiquote_title string"),
        limit=3,
    )

    def tokens(text):
        return set(text.replace("é", "e").split())

    def penalty(token, term):
        allowed = 1 if 4 <= len(token) <= 7 else 2 if 8 <= len(token) <= 24 else 0
        distance = edits(token, term)
        return 0 if token == term else 1 if term.startswith(token) else distance + 1 if distance <= allowed else None

    wanted = set()
    for query in asked:
        hits = []
        for qid, name, title in names:
            best = [min((p for term in tokens(name) if (p := penalty(t, term)) is not None), default=None) for t in tokens(query)]
            if best and None not in best:
                hits.append((sum(best), title is None, title or "", qid, name))
        wanted |= {(query, n, h[4], h[3], h[0]) for n, h in enumerate(sorted(hits)[:3], 1)}
    assert {(r.query_id, r.hit_rank, r.thinker_name, r.thinker_qid, r.penalty) for r in got.collect()} == wanted and len(wanted) > 150


def test_partial_names_without_terms(spark):
    queries = spark.createDataFrame([("1", ""), ("2", "?"), ("3", "zzz"), ("4", None)], "query_id string, query_text string")
    names = spark.createDataFrame([("Q1", "Ana", "Ana"), ("Q2", None, None)], "thinker_qid string, thinker_name string, wikiquote_title string")
    assert search.search_names_partial(queries, names).count() == 0
    assert search.search_names_partial(queries, names.limit(0)).count() == 0


def test_texts_shared_by_members_count_once(spark):
    generator = random.Random(21)
    rows = [(f"Q{generator.randrange(6)}", generator.random() < 0.8, f"Text {generator.randrange(90)} " + "ab"[i % 2].upper()) for i in range(900)]
    gold_rows = spark.createDataFrame(rows + [("Q9", True, "nobody's")], "thinker_qid string, is_daily_eligible boolean, quote_text string")
    thinkers = spark.createDataFrame([(f"Q{i}", f"N{i}") for i in range(6)], "thinker_qid string, thinker_name string")
    slugs = {"a": [0, 1, 2], "b": [2, 3], "c": [7], "d": [5]}
    members = spark.createDataFrame([(s, f"N{i}") for s, ids_ in slugs.items() for i in ids_], "slug string, thinker_name string")
    wanted = set()
    for slug, numbers in slugs.items():
        mine = [t.lower() for q, e, t in rows if e and int(q[1:]) in numbers]
        wanted.add((slug, len(mine), len(set(mine))))
    assert {r[:] for r in reports.collection_texts(gold_rows, thinkers, members).collect()} == wanted


def test_numbers_of_texts_are_dense(spark):
    texts = spark.range(500).select(F.concat(F.lit("N"), F.col("id") % 3).alias("thinker_name"), F.sha2((F.col("id") % 400).cast("string"), 256).alias("text_key"))
    numbers = {}
    for r in reports.numbered_texts(texts.distinct(), digits=1).collect():
        numbers.setdefault(r.owner, {})[r.text_key] = r.number
    assert sum(map(len, numbers.values())) == 400
    assert all(sorted(n.values()) == list(range(len(n))) for n in numbers.values())


def test_tables_of_requests_are_not_taken_for_small(spark, monkeypatch):
    """Requests compress to a small part of their size; a join must not take them for a table to broadcast."""
    written = []

    def kept(df, **options):
        written.append(session.reused(df, **options))
        return written[-1]

    monkeypatch.setattr(selection, "reused", kept)
    monkeypatch.setattr(picks, "reused", kept)
    n = 40000
    requests = spark.range(n).selectExpr(
        "id as request_id", "'2026-01-01' as on_date", "'N1' as thinker", "cast(null as string) as collection",
        "cast(null as string) as category", "cast(null as long) as max_length",
    )
    rows = [tuple(sha(str(i)) if c == "occurrence_id" else "N1" if c == "thinker_name" else "x" for c in selection._SHOWN) for i in range(40)]
    quotes = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in selection._SHOWN)).withColumn("character_count", F.lit(5).cast("long"))
    members = spark.createDataFrame([("c", "C", "N1")], "slug string, title string, thinker_name string")
    assert selection.two_stage_selection(requests, quotes, members).filter("status = 'ok'").count() == n
    sizes = [int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for df in written if df.count() == n]
    assert len(sizes) == 4 and min(sizes) > 8 * n


def test_names_with_equal_tokens_are_searched_once(spark, monkeypatch):
    """Queries meet distinct forms of names, and no task takes all rows of a file; repeated identities count by rows."""
    rows = [(f"Q{i:04}", ["Ana Sá", "sa  ANA", "Ana Rui"][i % 3], f"T{i % 50:02}") for i in range(3000)] + [("Q0001", "sa  ANA", "T01")] * 2
    schema = "thinker_qid string, thinker_name string, wikiquote_title string"
    names = spark.createDataFrame(rows, schema).coalesce(1)
    queries = spark.createDataFrame([(t, t) for t in ("ana", "sa ana", "rui", "an", "x")], "query_id string, query_text string")
    written, dealt = [], []

    def kept(df, **options):
        written.append(session.reused(df, **options))
        return written[-1]

    def spread(df, key):
        dealt.append(session.dealt_by_rows(df, key, 500))
        return dealt[-1]

    monkeypatch.setattr(search, "reused", kept)
    monkeypatch.setattr(search, "dealt_by_rows", spread)
    exact = {(r.query_id, r.hit_rank): r.thinker_qid for r in search.search_names(queries, names).collect()}
    first = sorted((t, q) for q, _, t in dict.fromkeys(rows))
    plain = [q for t, q in first if q != "Q0001"]
    assert [exact["ana", k] for k in range(1, 6)] == plain[:5] and exact["rui", 1] == next(q for q in plain if int(q[1:]) % 3 == 2)
    assert max(df.count() for df in written) <= 10 and not any(q == "x" for q, _ in exact)
    assert [df.rdd.getNumPartitions() for df in dealt] == [7] and max(dealt[0].groupBy(F.spark_partition_id()).count().toDF("p", "n").toPandas()["n"]) < 1000
    partial = {(r.query_id, r.hit_rank): (r.thinker_qid, r.penalty) for r in search.search_names_partial(queries, names).collect()}
    assert [partial["an", k] for k in range(1, 6)] == [(q, 1) for t, q in first][:5]
    assert max(df.count() for df in written) <= 20
