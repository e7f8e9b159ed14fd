"""Every registered query of the plain library against its SQL."""

import math

import duckdb
import pytest

from tests.conftest import SF
from vidcohort.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    c = con.execute(SQL[name])
    names = [d[0] for d in c.description]
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in c.fetchall())
    assert sorted(names) == columns and got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and {r.status for r in rows} <= {"success", "partial", "failed"}
