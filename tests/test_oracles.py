"""Every registered query with SQL gives the same rows as DuckDB on the same tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import mercantor.queries  # noqa: F401
from mercantor.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def value(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | float | np.integer | np.floating) or type(v).__name__ == "Decimal":
        return round(float(v), 5)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(value, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours.columns, map(tuple, ours.collect())) == rows_of(theirs.columns, theirs.fetchall())
