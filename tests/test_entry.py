"""The library's queries against their SQL twins on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql.types import IntegralType

from quadrat.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    """A connection for each scale; the second is for queries that find nothing at the first."""
    out = {}
    for sf in (SF, "/root/testdata/sf0.01"):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def cell(v):
    if v is None or v is pd.NA or v != v:
        return "~"
    return float(v) if isinstance(v, float) else str(v)


def grouped(df):
    """Rows by what is exact in them; their numbers with a fraction, in order, are compared with a tolerance of the last place."""
    out = {}
    for row in df[sorted(df.columns)].astype(object).itertuples(index=False):
        cells = [cell(v) for v in row]
        out.setdefault(tuple("#" if isinstance(v, float) else v for v in cells), []).append([v for v in cells if isinstance(v, float)])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    for sf, con in duck.items():
        result, want = catalogue.QUERIES[name](spark, sf), con.execute(catalogue.ORACLES[name]).df()
        if len(want):
            break
    got = result.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    for f in result.schema:
        if isinstance(f.dataType, IntegralType):  # whole numbers with nulls
            got[f.name], want[f.name] = got[f.name].astype("Int64"), want[f.name].astype("Int64")
    assert len(want) > 0
    a, b = grouped(got), grouped(want)
    assert {k: len(v) for k, v in a.items()} == {k: len(v) for k, v in b.items()}
    for k in a:
        assert np.allclose(np.array(a[k], float), np.array(b[k], float), rtol=1e-6, atol=1.01e-5), k


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
