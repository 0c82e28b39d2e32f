"""Every registered query against its SQL, on the smallest tables; and on empty tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

Q, O = entry.queries(), entry.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(O))
def test_same_as_sql(spark, sf, duck, name):
    df = Q[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.sql(O[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(f).limit(0).write.parquet(f"{d}/{os.path.basename(f)}")
    # the fixed tables stay
    for n in ("size_limits", "subject_areas"):
        spark.read.parquet(f"{sf}/{n}.parquet").write.mode("overwrite").parquet(f"{d}/{n}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    rows = Q[name](spark, empty).collect()
    assert len(rows) <= 1 or name.endswith("composition")


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0
