"""Every query with an SQL twin gives its rows at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from brindle.plans import registry

DATA = Path("/root/testdata/sf0.001")
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = Q[name](spark, str(DATA))
    r = duck.execute(SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(names, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_others_give_rows(spark, name):
    assert Q[name](spark, str(DATA)).count() > 0
