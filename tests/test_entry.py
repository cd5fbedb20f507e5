"""The driver's contract on the smallest tables, the core's SQL included."""

import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as e
from factloom.plans import queries as core

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parent.parent


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_nothing_imports_the_subpackage():
    for path in [*ROOT.glob("factloom/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("factloom.llm" in n for n in names), path


def _plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(core.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    r = c.execute(core.oracle_sql()[name])
    cols, rows = [d[0] for d in r.description], r.fetchall()
    df = core.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    key = lambda row: str(row)
    want = sorted(([_plain(row[cols.index(c)]) for c in sorted(cols)] for row in rows), key=key)
    got = sorted(([_plain(row[c]) for c in sorted(cols)] for row in df.collect()), key=key)
    assert got == want
