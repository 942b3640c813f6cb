"""Registered queries of the subpackage that have SQL, against it on the smallest tables."""

import os

import duckdb
import pytest

from lattica.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    plain = lambda rows, names: sorted(str([r[names.index(c)] for c in order]) for r in rows)
    assert plain(df.collect(), df.columns) == plain(cur.fetchall(), columns)
