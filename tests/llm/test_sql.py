"""Corpus queries against their SQL."""

import glob
import os

import duckdb
import pytest

from loomspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, size):
    con = duckdb.connect()
    for f in glob.glob(f"/root/testdata/{size}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = con.execute(queries.ORACLE[name])
    names = [c[0] for c in r.description]
    df = queries.QUERIES[name](spark, f"/root/testdata/{size}")
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, r.fetchall()))
