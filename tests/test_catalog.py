"""Every registered query runs; those with SQL give its rows."""

import duckdb
import pandas as pd
import pytest

from sylvan import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _sorted(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        pd.testing.assert_frame_equal(_sorted(got), _sorted(sql.sql(catalog.oracle_sql()[name]).df()), check_dtype=False, rtol=1e-12)
    else:
        assert len(got.columns)
