"""Every query of the library against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tickloom import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in registry.ORACLES:
        result = sql.execute(registry.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())


def test_registry():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.ORACLES) <= set(registry.QUERIES)
