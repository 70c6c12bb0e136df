"""Quantiles by selection equal those of one sorted buffer."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrystat.plans import plan, selection
from quarrystat.plans.registry import oracle_sql, queries
from quarrystat.plans.selection import quantiles

WANTED = {"q0": ("v", 0.0), "q1": ("v", 0.1), "med": ("v", 0.5), "p95": ("v", 0.95), "top": ("v", 1.0), "w": ("w * 2", 0.5), "none": ("CASE WHEN k = 'a' THEN v END", 0.3)}


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(1)
    rows = []
    draws = {"a": lambda: r.gauss(0, 1), "b": lambda: float(r.randint(0, 3)), "c": lambda: r.choice([1e-300, 1e300, -1e300, 5.0, r.random()]), "d": lambda: 7.0, None: lambda: round(r.random(), 2)}
    for k, draw in draws.items():
        for _ in range(r.randint(150, 400)):
            rows.append((k, None if r.random() < 0.03 else draw(), r.randint(-5, 5)))
    rows += [("e", None, 1), ("e", None, 2), ("f", 3.0, None), ("g", -0.0, 1), ("g", 0.0, 1), ("h", float("nan"), 1), ("h", 1.0, 1), ("h", 2.0, 1)]
    rows += [("i", x, 1) for x in (float("inf"), float("-inf"), 1.0, 2.0, 1e308, -1e308, 5e-324, float("inf"))]
    return spark.createDataFrame(rows, "k string, v double, w int").repartition(4)


@pytest.mark.parametrize("most, bins", [(100_000, 4096), (20, 4), (1, 16)])
def test_quantiles(table, most, bins):
    got = sorted((tuple(r) for r in quantiles(table, ["k"], WANTED, most, bins).collect()), key=lambda r: str(r[0]))
    want = table.groupBy("k").agg(*[F.percentile(F.expr(e).cast("double"), p).alias(n) for n, (e, p) in WANTED.items()]).collect()
    want = sorted((tuple(r) for r in want), key=lambda r: str(r[0]))
    assert [r[0] for r in got] == [r[0] for r in want]
    for a, b in zip(got, want):
        assert [None if x is None else pytest.approx(x, rel=1e-12, nan_ok=True) for x in b[1:]] == list(a[1:]), a[0]


def test_whole_table_and_empty(table):
    got = quantiles(table.where("k = 'a'"), [], {"m": ("v", 0.25)}, most=10).first()["m"]
    assert got == pytest.approx(table.where("k = 'a'").agg(F.percentile("v", 0.25)).first()[0])
    assert quantiles(table.where("false"), ["k"], {"m": ("v", 0.5)}).collect() == []


@pytest.mark.parametrize("whole, accuracy", [(20_000, 10_000), (60, 100), (40, 40)])
def test_by_sketch_and_rank(table, monkeypatch, whole, accuracy):
    monkeypatch.setattr(selection, "WHOLE", whole)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    got = selection.with_quantiles(table, ["k"], WANTED, {"n": "count(*)"}).collect()
    want = {r.k: r for r in table.groupBy("k").agg(F.count("*").alias("n"), *[F.percentile(F.expr(e).cast("double"), p).alias(n) for n, (e, p) in WANTED.items()]).collect()}
    assert len(got) == len(want)
    for r in got:
        assert r.n == want[r.k].n
        for n in WANTED:
            assert r[n] is want[r.k][n] is None or r[n] == pytest.approx(want[r.k][n], rel=1e-12, nan_ok=True), (r.k, n)


def test_plans_keep_no_group_in_a_buffer(spark):
    """All values of a group once went to one buffer of ``percentile``."""
    df = spark.range(100_000).selectExpr("id % 2 AS k", "CAST(xxhash64(id) AS DOUBLE) AS v")
    for keys in ([], ["k"]):
        got = plan._grouped(df, keys, {"a": "round(PCT(v, 0.995), 5)", "b": "max(v) / PCT(v, 0.5)", "n": "count(*)"})
        assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = df.groupBy(*keys).agg(F.round(F.percentile("v", 0.995), 5).alias("a"), (F.max("v") / F.percentile("v", 0.5)).alias("b"), F.count("*").alias("n"))
        assert [tuple(map(pytest.approx, r)) for r in sorted(want.collect())] == [tuple(r) for r in sorted(got.collect())]


@pytest.mark.parametrize("name", ["robust_covariance_outliers", "quantile_regression_duration"])
def test_queries_on_all_line_items_narrow_their_ranges(spark, sf, monkeypatch, name):
    """The limit of all distances, and the prices of a flag, once lay in one task's buffer; the ranges hold a few of the values."""
    monkeypatch.setattr(selection, "WHOLE", 1000)
    monkeypatch.setattr(selection, "ACCURACY", 1000)
    df = queries()[name](spark, sf)
    assert "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) or [tuple(map(pytest.approx, r)) for r in want] == got


def test_rows_are_told_apart_without_a_function(spark):
    """Each row's array of ranges once went through a lambda function, one row at a time outside of compiled code."""
    df = spark.range(30_000).selectExpr("id % 2 AS k", "CAST(xxhash64(id) AS DOUBLE) AS v")
    for keys, wanted in (([], {"a": ("v", 0.9)}), (["k"], {"a": ("v", 0.9), "b": ("v", 0.5)})):
        got = selection.with_quantiles(df, keys, wanted, {"n": "count(*)"})
        plan_ = got._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan_ and ("Generate" in plan_) == (len(wanted) > 1)
        want = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.percentile("v", p).alias(n) for n, (_, p) in wanted.items()])
        assert [tuple(map(pytest.approx, r)) for r in sorted(want.collect())] == [tuple(r) for r in sorted(got.select(want.columns).collect())]
