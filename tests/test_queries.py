"""Every registered core query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gridframe.queries import oracle_sql, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = _sorted(queries()[name](spark, DATA).toPandas())
    assert len(got)
    if name in oracle_sql():
        want = _sorted(duck.sql(oracle_sql()[name]).df())
        assert list(got.columns) == list(want.columns)
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_product_of_every_line(spark, duck):
    got = {r.cell: r.grown for r in queries()["scatter_product_orders"](spark, DATA).collect()}
    want = dict(duck.sql("select l_orderkey, product(exp(l_discount)) from lineitem group by 1").fetchall())
    assert set(want) <= set(got) and all(v == pytest.approx(want.get(k, 1), abs=1e-6) for k, v in got.items())


def test_diagonal_of_wider_vectors(spark, tmp_path):
    rows = [(n, [float(100 * n + k) for k in range(70)]) for n in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["diagonal"](spark, str(tmp_path)).collect()
    assert sorted((r.row, r.v) for r in got) == [(n, 101.0 * n) for n in range(70)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 64
    assert set(e.oracle_sql()) <= set(e.queries())
