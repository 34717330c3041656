"""Every registered query against its SQL oracle in DuckDB; queries without one must at least run."""

from __future__ import annotations

import os

import duckdb
import pytest

from fieldloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(5) + 0.0
        df[c] = df[c].map(lambda v: "" if v is None or v != v else f"{v:g}" if isinstance(v, float) else str(v).removesuffix(".0"))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert got.count() > 0 and got.schema == QUERIES[name](spark, sf_dir).schema
        return
    got, want = got.toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    a, b = plain(got), plain(want)
    for c in a.columns:
        near = [x == y or _close(x, y) for x, y in zip(a[c], b[c])]
        assert all(near), (c, [(x, y) for x, y, k in zip(a[c], b[c], near) if not k][:3])


def _close(x, y):
    try:
        return abs(float(x) - float(y)) < 1e-4
    except ValueError:
        return False
