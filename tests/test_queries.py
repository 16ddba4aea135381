"""Every pose query against its SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from limber.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "part", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, equal_nan=True), c
        else:
            assert list(a[c]) == list(b[c]), c


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_against_sql(spark, db, name):
    same(q.queries()[name](spark, SF).toPandas(), db.sql(q.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(q.queries()) == set(q.oracle_sql())
