import duckdb
import pytest

from jurisloom.llm import base_columns as bc

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(bc.oracle_sql()))
def test_columns_against_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{DIR}/documents.parquet')")
    rel = c.sql(bc.oracle_sql()[name])
    df = bc.queries()[name](spark, DIR)
    assert sorted(rel.columns) == sorted(df.columns)
    got = sorted(map(repr, (tuple(r[x] for x in rel.columns) for r in df.collect())))
    assert got == sorted(map(repr, rel.fetchall()))
