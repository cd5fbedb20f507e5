"""The subpackage's queries on the smallest tables against their SQL."""

import pathlib

import duckdb
import pytest

from factloom.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    if name in sql.oracle_sql():
        c = duckdb.connect()
        for p in pathlib.Path(SF).glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
        r = c.execute(sql.oracle_sql()[name])
        cols = [d[0] for d in r.description]
        assert sorted(df.columns) == sorted(cols)
        key = sorted(cols)
        assert sorted(tuple(x[k] for k in key) for x in rows) == sorted(tuple(x[cols.index(k)] for k in key) for x in r.fetchall())
