"""Every query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tramaline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def cell(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, key):
    got, want = registry.queries()[key](spark, SF).toPandas(), con.execute(registry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("key", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, key):
    assert registry.queries()[key](spark, SF).count() > 0


def test_flagship(spark):
    assert "word" in registry.flagship(spark, SF).columns
