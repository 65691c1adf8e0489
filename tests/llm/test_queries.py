"""Every operator's query against its SQL, on given, odd and empty tables."""

import duckdb
import pytest
from compare import differences, duck

from impactrec.llm.oracle import llm_oracle
from impactrec.llm.queries import llm_queries

ORACLE, QUERIES = llm_oracle(), llm_queries()
DOCUMENTS = sorted(set(QUERIES) - {"op5_nearest", "op9_extract", "op12_spelling", "op13_prefix_trie"})


def folder_views(folder):
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "embeddings", "conversations"):
        try:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
        except duckdb.IOException:
            pass
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, folder), duck(folder), ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op2_quality", "op7_licenses", "op12_spelling"])
def test_odd_rows_match_sql(spark, odd, name):
    assert differences(QUERIES[name](spark, odd), folder_views(odd), ORACLE[name]) is None


@pytest.mark.parametrize("name", DOCUMENTS)
def test_every_odd_row_has_a_result(spark, odd, name):
    ids = [r["doc_id"] for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id").collect()]
    rows = QUERIES[name](spark, odd).collect()
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted(ids, key=repr)
    for r in rows:
        if name == "op11_katz":
            assert r["score"] <= 0 and r["base_score"] <= 0
        elif "score" in r:
            assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []
