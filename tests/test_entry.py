"""Every query of the search engine agrees with DuckDB on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

from docquarry.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df: pd.DataFrame) -> list:
    clean = lambda v: None if v is None or (isinstance(v, float) and v != v) else round(float(v), 5) if isinstance(v, float) else str(v)
    return sorted([tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)
