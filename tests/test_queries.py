"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans import registry
from tools_compare import norm

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracles())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    from pathlib import Path

    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_registry():
    q, o = registry.queries(), registry.oracles()
    assert set(o) <= set(q) and len(q) > 150
    assert len(q) == sum(len(m.QUERIES) for m in registry.MODULES), "no name twice"
    assert set(q) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = duck.execute(registry.oracles()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "target"]
