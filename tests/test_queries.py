"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in SQL:
        other = duck.sql(SQL[name])
        assert sorted(other.columns) == columns
        assert plain(rows) == plain(other.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
