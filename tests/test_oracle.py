"""Every query that SQL can express, against DuckDB on the same files."""

import datetime
import decimal
import math

import duckdb
import pytest

from canvass import queries as Q

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, db, name):
    frame = Q.queries()[name](spark, SMALL)
    columns = sorted(frame.columns)
    cursor = db.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_rows(spark, name):
    assert Q.queries()[name](spark, SMALL).count() > 0
