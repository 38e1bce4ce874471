import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = [k for k in entry.oracle_sql() if k != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def level(frame):
    columns = sorted(frame.columns)
    text = frame[columns].astype(object).where(frame[columns].notna(), None).astype(str)
    return columns, sorted(map(tuple, text.values.tolist()))


@pytest.mark.parametrize("name", SQL)
def test_query_against_its_sql(spark, duck, name):
    assert level(entry.queries()[name](spark, SF).toPandas()) == level(duck.sql(entry.oracle_sql()[name]).df())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["near_dup_groups", "vector_groups", "group_id_remap", "flatten_plan", "shortening_plan", "metadata_lexical"])
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0
