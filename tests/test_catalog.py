"""Every registered query against the same query in DuckDB on the smallest test folder."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not found")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLE:
        assert df.count() > 0
        return
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(names, want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
