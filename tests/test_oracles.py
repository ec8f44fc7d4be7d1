"""Every query with a SQL twin gives the twin's rows at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sitegrid.plans.oracles import ORACLES
from sitegrid.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(p: pd.DataFrame) -> pd.DataFrame:
    p = p[sorted(p.columns)].copy()
    for c in p.columns:
        if pd.api.types.is_numeric_dtype(p[c]) or pd.api.types.is_bool_dtype(p[c]):
            p[c] = pd.to_numeric(p[c]).astype(float)
        else:
            p[c] = p[c].map(lambda v: None if v is None or v != v else str(v)).astype(object)
    return p.sort_values(list(p.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    a, b = normal(QUERIES[name](spark, SF).toPandas()), normal(con.sql(ORACLES[name]).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            assert np.allclose(a[c], b[c], rtol=1e-9, atol=1.1e-6, equal_nan=True), c
        else:
            assert a[c].fillna("~").astype(str).tolist() == b[c].fillna("~").astype(str).tolist(), c


def test_each_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
