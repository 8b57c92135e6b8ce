"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from bindings import oracle, registry
from bindings.registry import QUERIES
from tools.compare import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(oracle.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row.total == row.accepted + row.review + row.rejected > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_relations_and_identities_are_computed_once(spark, tmp_path, monkeypatch):
    """Tests read relations that are written, and uniqueness before and after deduplication shares one cleaning of the texts."""
    documents = [(i, "A line of a document.\nAnother line " + "x" * (i % 3), "en", f"src{i % 4}") for i in range(60)] * 2
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    talks = [(i, 0, "user", "A line that was spoken.") for i in range(20)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    labels = [(i, i % 2, i % 3 // 2) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    tables = registry._relations(spark, str(tmp_path))
    # A Parquet scan per relation, and nothing else in its plan.
    plans = [df._jdf.queryExecution().optimizedPlan().toString().strip().splitlines() for df in tables.values()]
    assert all(len(lines) == 1 and "Relation" in lines[0] for lines in plans)
    identified = []
    monkeypatch.setattr(registry.silver, "identify", lambda df, was=registry.silver.identify: identified.append(df) or was(df))
    rows = registry.QUERIES["unique_violations"](spark, str(tmp_path)).collect()
    assert len(identified) == 1 and {r.relation for r in rows} == {"bronze"} and max(r.occurrences for r in rows) >= 2


def test_quote_search_indexes_only_texts_that_can_answer(spark, tmp_path, monkeypatch):
    """Postings of frequent tokens are dealt for texts with the rarest term of a query alone, and no hit is lost."""
    lines = [f"comum rio mar raro{i % 50} texto de uma linha" + " sol" * (i % 3 == 0) for i in range(600)]
    documents = [(i, line, "pt", f"src{i % 4}") for i, line in enumerate(lines)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    asked = [(1, "comum rio raro7"), (2, "Mar, comum sol raro9"), (3, "comum nada"), (4, "?"), (5, "raro3"), (6, "rio raro1 raro2"), (7, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    indexed = []
    monkeypatch.setattr(registry.search, "search_index", lambda q, blocks, *a, was=registry.search.search_index: indexed.append(blocks) or was(q, blocks, *a))
    got = [tuple(r) for r in registry.QUERIES["quote_search"](spark, str(tmp_path)).collect()]
    words = {r.occurrence_id: set(re.findall(r"\w+", r.quote_text.lower())) for r in registry._texts(spark, str(tmp_path)).collect()}
    terms = {q: set(text.lower().replace(",", "").split()) for q, text in asked if text not in (None, "?")}
    assert sorted(got) == sorted((q, i) for q, t in terms.items() for i, held in words.items() if t <= held)
    assert {q for q, _ in got} == {1, 2, 5}
    entries = {i for b in indexed[0].collect() for i in b.identities}
    assert entries and all({"raro1", "raro2", "raro3", "raro7", "raro9"} & words[i] for i in entries)
    assert len(entries) <= 5 * 12 < len(words)
