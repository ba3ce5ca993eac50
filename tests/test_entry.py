import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from strataline import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    clean = lambda v: ("%.6g" % v if not math.isnan(v) else "nan") if isinstance(v, float) else str(v)
    return sorted(tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    a, b = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
