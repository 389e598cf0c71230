"""Every query of the catalogue against its DuckDB SQL on the smallest tables. Two have none: their stems are held against
SQLite in test_more."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(show(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    if name not in SQL:
        assert name.endswith("_stemmed") and got.count() > 0
        return
    want = duck.sql(SQL[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:  # the same integers, whatever width or missing values made of them
        if pd.api.types.is_numeric_dtype(got[c]) and pd.api.types.is_numeric_dtype(want[c]) and not pd.api.types.is_bool_dtype(want[c]):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert canonical(got) == canonical(want)
