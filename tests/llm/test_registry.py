"""The pipeline operators' queries are registered, and their SQL agrees with them."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hearthlight.llm import queries

NAMES = [n for n in entry.queries() if n.startswith("op")]


def test_all_are_registered():
    assert [int(n[2:].split("_")[0]) for n in NAMES] == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert {int(n[2:].split("_")[0]) for n in queries.ORACLES} == {2, 4, 5, 11, 12, 13}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, docs, tmp_path, name):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    loose = talk.limit(30).selectExpr("nullif(conv_id % 5, 0) as conv_id", "nullif(turn, 1) as turn", "nullif(role, 'system') as role", "nullif(text, '') as text")
    talk.unionByName(loose).unionByName(loose).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in queries.ORACLES])
def test_queries_run_on_the_small_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES[name](spark, folder)
    table, key = ("pages", "page_id") if name == "op8_url_filter" else ("documents", "doc_id")
    assert rows.select(key).distinct().count() == spark.read.parquet(f"{folder}/{table}.parquet").count()
