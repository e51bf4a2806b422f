"""The queries that SQL can express, against DuckDB on the same files."""

import duckdb
import pytest

from canvass.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((str(r) for r in cursor.fetchall()))
    frame = Q.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in frame.select(*names).collect()) == want
