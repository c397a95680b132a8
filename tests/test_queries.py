"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quaestor.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, int, np.integer)):
        return repr(int(v)) if float(v).is_integer() else repr(float(v))
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted("|".join(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_every_query_names_its_operators():
    assert all(f.__doc__ for f in QUERIES.values() if f.__name__ not in ("costliest_by_company",))
