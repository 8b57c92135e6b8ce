from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from lapidary.llm import oracle, queries
from lapidary.llm.common import written
from cases import TEXTS, documents
from tools.compare import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF_DIR), name)
        found.append((name, docs, after))
        docs = after
    return found


def test_each_stage_works_on_what_the_last_one_kept(spark, stages):
    assert [n for n, *_ in stages] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
        assert after.exceptAll(before).count() == 0 and 0 < after.count() <= before.count()
    last = stages[-1][2].collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in stages[-2][2].collect())


def test_near_duplicate_stage_by_brute_force(stages):
    from lapidary.llm.popcount_dedup import simhash

    _, before, after = stages[1]
    left = {r.doc_id: simhash(r.text) & ((1 << 64) - 1) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    least = {i: i for i in left}
    for _ in left:
        now = {i: min(least[j] for j in left if (left[i] ^ left[j]).bit_count() <= 3) for i in left}
        if now == least:
            break
        least = now
    assert kept == {i for i in left if least[i] == i}


def test_run_equals_the_stages_one_by_one(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == Counter(map(tuple, stages[-1][2].collect()))


def test_odd_rows_pass_every_stage(spark):
    for docs in (documents(spark, TEXTS + TEXTS), documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = written(stage(spark, docs, SF_DIR), name)
            assert after.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def test_eleven_queries():
    assert sorted(queries.QUERIES) == sorted(n for n in queries.QUERIES if n.startswith("op"))
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11)) and len(queries.QUERIES) == 10


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_twin(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    cursor = db.execute(oracle.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_query_gives_a_row_for_each_row_of_its_table(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    table = "pages" if "page_id" in df.columns else "documents"
    n = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    assert df.count() == n if not name.startswith("op4_") else 0 < df.count() < n
