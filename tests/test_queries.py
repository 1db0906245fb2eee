"""Every query with SQL against DuckDB on the smallest tables; the others for rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from pointloom.plans import augment_queries, metric_queries, more_queries, road_queries  # noqa: F401
from pointloom.plans.point_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return str([plain(x) for x in v])
        if isinstance(v, float) and v != v or v is None or v is pd.NA:
            return "null"
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "item") and not isinstance(v, str) else str(v)

    return sorted((tuple(map(plain, row)) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
