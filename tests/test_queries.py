"""Every registered query of the library: it runs, and equals its SQL where there is one."""

import glob
import math
import os

import duckdb
import pytest

from quarrystat.plans.registry import oracle_sql, queries


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.8g}") + 0.0
        return v if v is None or isinstance(v, (int, bool, str)) else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = canon(df.select(*columns).collect())
    if name in oracle_sql():
        r = duck.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})")
        assert got == canon(r.fetchall())
        assert not [t for _, t in df.dtypes if t.startswith("decimal")]
    else:
        assert got


@pytest.mark.parametrize("name", ["process_sequence_bottlenecks", "two_sample_numeric_mann_whitney", "busy_period_segmentation_v2"])
def test_partitions_do_not_matter(spark, sf, name):
    df = queries()[name]
    columns = sorted(df(spark, sf).columns)
    want = canon(df(spark, sf).select(*columns).collect())
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert canon(df(spark, sf).select(*columns).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_filters_reach_the_scan(spark, sf):
    plan = queries()["filter_between_in"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "l_partkey" not in plan
