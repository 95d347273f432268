"""Every registered query against its SQL on the smallest tables, values compared without order."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lumenloom import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def norm(df):
    df = df[sorted(df.columns)].copy()
    show = lambda v: "-" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(list(v)) if hasattr(v, "__iter__") and not isinstance(v, str) else str(v)
    for c in df.columns:
        df[c] = df[c].map(show)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    want = con.execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(norm(got), norm(want), check_dtype=False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{SF}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(f"{path}/{os.path.basename(f)}")
    return str(path)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_on_empty_tables(spark, empty, name):
    registry.queries()[name](spark, empty).collect()
