"""Every catalogue query with SQL gives DuckDB's rows; the others run and hold what they promise."""

import duckdb
import pandas as pd
import pytest

from quillmark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).lower().startswith("float"):
            df[c] = df[c].astype(float).round(6)
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert not got.columns.duplicated().any()
    if name in catalogue.ORACLE_SQL:
        pd.testing.assert_frame_equal(plain(got), plain(duck.execute(catalogue.ORACLE_SQL[name]).df()))
    else:
        assert len(got)
