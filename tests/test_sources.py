from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lapidary import fixed
from lapidary.plans import extraction
from lapidary.sources import entities, pages, supplemental, tables

RULES = pages.PageRules()


def test_sections_items_and_nested_lists():
    html = """<html><body><div class="x mw-parser-output">
      <ul><li>antes da seção</li></ul>
      <p>solto</p>
      <h2>Obra (1947)</h2>
      <ul><li>um <b>dois</b> <span>três<ul><li>fundo</li></ul></span><ul><li>fora</li></ul><dl><dd>fora</dd></dl> fim
          <li>sem fecho &amp; entidade<br>linha</ul>
      <div><div><h3>Sub</h3></div><ul><li>na div do título</li></ul></div>
      <ol><li>numerada</li></ol><ul><div><li>indireta</li></div><li>direta</li></ul>
    </div><div class="mw-parser-output"><ul><li>segunda raiz</li></ul></div></body></html>"""
    assert [(s.strip(), " ".join(t.split())) for s, t in pages.page_items(html, RULES)] == [
        ("(topo)", "antes da seção"),
        ("Obra (1947)", "um dois trêsfundo fim"),
        ("Obra (1947)", "sem fecho & entidadelinha"),
        ("Sub", "direta"),
    ]


def test_page_without_the_root_class():
    assert pages.page_items("<h2>A</h2><ul><li>um</li></ul>", RULES) == [("A", "um")]
    assert pages.page_items("<ul><li>um</li></ul>", RULES) == []
    assert pages.page_items("<html><body><ul><li>um</li></ul></body></html>", RULES) == []
    assert pages.page_items("", RULES) == []


def test_classification_of_sections(spark):
    rows = [
        ("(topo)", "frase do topo"),
        ("Verificadas (2)", '“frase verificada”'),
        (" ATRIBUÍDAS ", "frase atribuída"),
        ("A Peste (1947)", "frase da obra"),
        ("Sobre", "frase sobre o autor"),
        ("Ligações externas (site)", "frase de ligação"),
        ("Cartas", "curta"),
        ("Cartas", '"1234567"'),
    ]
    df = spark.createDataFrame(rows, "section string, item string")
    got = {(r.text, r.category, r.work) for r in extraction.classify_items(df).collect()}
    assert got == {
        ("frase do topo", "verificada", None),
        ("frase verificada", "verificada", None),
        ("frase atribuída", "atribuida", None),
        ("frase da obra", "obra", "A Peste (1947)"),
    }


def test_items_survive_batches_and_null_pages(spark):
    html = "<h2>S</h2><ul>" + "".join(f"<li>item número {i}</li>" for i in range(25_000)) + "</ul>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>x</p>")], "id long, html string")
    items = pages.read_items(df, ["id"], "html")
    assert items.count() == 25_000
    assert items.agg(F.max("item_no"), F.count_distinct("item")).first()[:] == (24_999, 25_000)


def test_carry_sections(spark):
    rows = [(1, 0, False, "a"), (1, 1, True, "H"), (1, 2, False, "b"), (2, 0, False, "c"), (1, 3, True, ""), (1, 4, False, "d")]
    df = spark.createDataFrame(rows, "page int, pos int, is_heading boolean, text string")
    got = extraction.carry_sections(df, ["page"], "pos").filter("not is_heading").collect()
    assert {(r.text, r.section) for r in got} == {("a", "(topo)"), ("b", "H"), ("c", "(topo)"), ("d", "")}


VALID = {
    "thinker_qid": "Q1",
    "thinker_name": "Ana",
    "text": " Texto traduzido, com vírgula ",
    "original_text": "Texte",
    "original_language": "fr",
    "category": "obra",
    "work": "",
    "source_url": "https://example.test/s",
    "source_name": "Edição",
    "source_license": "Public domain",
    "source_revision": "1",
    "translator_name": "Projeto",
    "translation_license": "CC0 1.0",
    "translation_url": "https://example.test/t",
    "reviewed_at": "2026-07-17T12:00:00+02:00",
}


def write_csv(path, rows, header=None, bom=False):
    import csv
    import io

    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header or fixed.SUPPLEMENTAL_FIELDS)
    writer.writerows([row[f] for f in fixed.SUPPLEMENTAL_FIELDS] for row in rows)
    path.write_text(out.getvalue(), encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


@pytest.fixture()
def names(spark):
    return spark.createDataFrame([("Ana",)], "thinker_name string")


@pytest.mark.parametrize("bom", [False, True])
def test_csv_is_read_stripped_and_typed(spark, tmp_path, names, bom):
    second = {**VALID, "text": 'Linha um\nlinha "dois"', "original_text": "", "original_language": "", "translator_name": "",
              "translation_license": "", "translation_url": "", "reviewed_at": "2026-07-17T12:00:00Z", "work": "Obra"}
    path = write_csv(tmp_path / "s.csv", [VALID, second], bom=bom)
    rows = sorted(supplemental.load(spark, path, names).collect(), key=lambda r: r.text, reverse=True)
    assert rows[0].text == "Texto traduzido, com vírgula" and rows[1].text == 'Linha um\nlinha "dois"'
    assert (rows[0].original_text, rows[0].work, rows[0].source_revision) == ("Texte", None, 1)
    assert (rows[1].original_text, rows[1].translator_name, rows[1].work) == (None, None, "Obra")
    assert rows[0].reviewed_at.isoformat() == "2026-07-17T10:00:00"


def test_csv_with_header_only_and_with_wrong_header(spark, tmp_path, names):
    assert supplemental.load(spark, write_csv(tmp_path / "empty.csv", []), names).count() == 0
    wrong = write_csv(tmp_path / "wrong.csv", [], header=[*fixed.SUPPLEMENTAL_FIELDS, "extra"])
    with pytest.raises(supplemental.InvalidSource, match="header"):
        supplemental.load(spark, wrong, names)


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"text": " "}, "missing_field text"),
        ({"text": " ", "thinker_qid": "", "source_name": ""}, "missing_field thinker_qid text source_name"),
        ({"thinker_name": "Outra"}, "unknown_thinker"),
        ({"category": "outra"}, "invalid_category"),
        ({"source_url": "http://example.test"}, "source_url_not_https"),
        ({"source_revision": "1.5"}, "revision_not_integer"),
        ({"source_revision": "0"}, "revision_not_positive"),
        ({"reviewed_at": "17/07/2026"}, "reviewed_at_not_iso"),
        ({"reviewed_at": "2026-13-01T00:00:00Z"}, "reviewed_at_not_iso"),
        ({"reviewed_at": "2026-07-17T12:00:00"}, "reviewed_at_without_zone"),
        ({"reviewed_at": "2026-07-17"}, "reviewed_at_without_zone"),
        ({"original_language": ""}, "incomplete_translation"),
        ({"original_text": ""}, "translation_without_original"),
        ({"translation_url": "http://example.test"}, "translation_url_not_https"),
    ],
)
def test_first_invalid_row_is_reported_by_line(spark, tmp_path, names, change, error):
    path = write_csv(tmp_path / "s.csv", [VALID, {**VALID, "text": "segunda frase", **change}, {**VALID, "text": ""}])
    with pytest.raises(supplemental.InvalidSource, match=f"line 3: {error}"):
        supplemental.load(spark, path, names)


@pytest.mark.parametrize("change", ["reordered", "missing", "additional", "empty"])
def test_every_file_of_a_source_must_have_the_header(spark, tmp_path, names, change):
    folder = tmp_path / "source"
    folder.mkdir()
    fields = list(fixed.SUPPLEMENTAL_FIELDS)
    write_csv(folder / "a.csv", [VALID], bom=True)
    assert supplemental.load(spark, str(folder), names).count() == 1
    if change == "reordered":
        at, to = fields.index("category"), fields.index("work")
        fields[at], fields[to] = fields[to], fields[at]
    header = {"reordered": fields, "missing": fields[:-1], "additional": [*fields, "extra"]}.get(change)
    if header:
        write_csv(folder / "b.csv", [{**VALID, "text": "outra"}], header=header)
    else:
        (folder / "b.csv").write_text("")
    with pytest.raises(supplemental.InvalidSource, match="b.csv" if header else "empty"):
        supplemental.load(spark, str(folder), names)


def test_repeated_quote_is_found_across_many_copies(spark, tmp_path, names):
    path = write_csv(tmp_path / "s.csv", [VALID] * 500 + [{**VALID, "text": "outra frase"}])
    rows = supplemental.validate(supplemental.read_csv(spark, path), names)
    repeated = rows.filter(F.array_contains("errors", "repeated_quote"))
    assert repeated.count() == 499 and repeated.agg(F.min("line_number")).first()[0] == 3


def test_seeds_and_empty_bronze(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("thinker_qid,quote_id\nQ1,abc\n")
    assert tables.read_seed(spark, str(tmp_path / "seed.csv"), tables.SELECTION_SEED).collect()[0][:] == ("Q1", "abc")
    empty = spark.createDataFrame([], tables.BRONZE_THINKERS)
    tables.write_bronze(empty, str(tmp_path / "run"), "thinkers")
    assert tables.read_bronze(spark, str(tmp_path / "run"), "thinkers").count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_bronze(empty, str(tmp_path / "run"), "thinkers")


def test_entity_documents(spark):
    claims = {
        "P737": [
            {"rank": "normal", "mainsnak": {"datavalue": {"type": "wikibase-entityid", "value": {"id": "Q408"}}}},
            {"rank": "deprecated", "mainsnak": {"snaktype": "novalue"}},
        ],
        "P569": [
            {"rank": "preferred", "mainsnak": {"datavalue": {"type": "time", "value": {"time": "+1844-10-15T00:00:00Z", "precision": 11}}}}
        ],
        "P18": [{"rank": "normal", "mainsnak": {"datavalue": {"type": "string", "value": "image.jpg"}}}],
    }
    texts = {"pt": {"language": "pt", "value": "filósofo"}, "en": {"language": "en", "value": "philosopher"}}
    df = spark.createDataFrame([("Q1", json.dumps(claims), json.dumps(texts))], "qid string, claims string, labels string")
    got = {(r.pid, r.pos, r["rank"], r.vtype, r.ref_id, r.time, r.precision) for r in entities.read_claims(df).collect()}
    assert got == {
        ("P737", 0, "normal", "wikibase-entityid", "Q408", None, None),
        ("P737", 1, "deprecated", None, None, None, None),
        ("P569", 0, "preferred", "time", None, "+1844-10-15T00:00:00Z", 11),
        ("P18", 0, "normal", "string", None, None, None),
    }
    assert {r[:] for r in entities.read_texts(df, "labels").collect()} == {("Q1", "pt", "filósofo"), ("Q1", "en", "philosopher")}


def test_one_quoted_file_over_many_splits(spark, tmp_path):
    """Records with breaks, doubled quotes, commas and blank lines, read by many tasks, equal a plain reader's."""
    import csv
    import io
    import random

    draw = random.Random(2)
    pieces = ["a", "ção", '"', '""', ",", "\n", "\n\n", "\r\n", " ", "x" * 40]
    for number, end in enumerate(("\n", "\r\n")):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(fixed.SUPPLEMENTAL_FIELDS)
        rows = [["".join(draw.choices(pieces, k=draw.randrange(6))) + "." for _ in fixed.SUPPLEMENTAL_FIELDS] for _ in range(300)]
        for row in rows:
            writer.writerow(row)
            if draw.random() < 0.1:
                out.write(end)
        path = tmp_path / f"many{number}.csv"
        path.write_bytes(out.getvalue().encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            splits = spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions()
            got = supplemental.read_csv(spark, str(path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert splits > 20
        assert {r.line_number: [r[f] for f in fixed.SUPPLEMENTAL_FIELDS] for r in got} == {n: row for n, row in enumerate(rows, 2)}
