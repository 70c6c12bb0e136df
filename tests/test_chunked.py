"""Windows cut into hours give what windows over the whole key give."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystat.plans import chunked
from quarrystat.plans.chunked import near_windows, place_in_order, running_sum

FULL = "OVER (PARTITION BY k ORDER BY ts, i{})"


@pytest.mark.parametrize("hours", [1, 40, 4000])
def test_windows(spark, hours):
    r = random.Random(hours)
    rows = [(r.choice("abc"), r.randint(0, hours * 3600), i, r.random() if r.random() > 0.05 else None) for i in range(600)] + [("d", 5, 600, 1.0)]
    df = spark.createDataFrame(rows, "k string, s long, i long, v double").selectExpr("k", "timestamp_seconds(s) AS ts", "i", "v").repartition(5)
    exprs = {"a": f"lag(v) {FULL.format('')}", "b": f"lead(v, 4) {FULL.format('')}", "m": f"avg(v) {FULL.format(' ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING')}", "n": f"count(*) {FULL.format(' ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')}"}
    want = df.selectExpr("*", *[f"{e} AS {n}" for n, e in exprs.items()], f"row_number() {FULL.format('')} AS p", f"sum(v) {FULL.format(' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS t")
    got = running_sum(place_in_order(near_windows(df, "k", ["ts", "i"], 4, exprs), "k", ["ts", "i"], "p"), "k", ["ts", "i"], "t", "v")
    cut = lambda d: {x["i"]: tuple(None if x[c] is None else round(x[c], 9) for c in ("a", "b", "m", "n", "p")) for x in d.collect()}
    assert cut(got) == cut(want)
    sums = {x["i"]: x["t"] for x in want.collect()}
    assert all(abs((x["t"] or 0) - (sums[x["i"]] or 0)) < 1e-9 for x in got.collect())


def test_no_window_holds_a_key(spark, sf):
    """The plan's windows over rows are keyed by hour as well."""
    from quarrystat.plans.registry import queries

    plan = queries()["surface_terrain_position_index"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    rolling = [line for line in plan.split("\n") if "windowexpression" in line.lower() or "Window" in line]
    assert any("_c" in line and "avg" in line for line in rolling)
    assert not any("avg(" in line and "_c" not in line for line in rolling)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, i long, v double")
    assert near_windows(df, "k", ["ts", "i"], 2, {"a": f"lag(v) {FULL.format('')}"}).count() == 0
    assert place_in_order(df, "k", ["ts", "i"], "p").count() == 0 and running_sum(df, "k", ["ts", "i"], "t", "v").agg(F.count("*")).first()[0] == 0


def test_exact_median(spark):
    import statistics

    from quarrystat.plans.halves import exact_median

    r = random.Random(9)
    for n, spread in ((0, 1), (1, 1), (2, 10**12), (7, 10), (500, 3 * 10**6), (501, 10**11)):
        values = [r.randint(0, spread) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "t long").repartition(3)
        got = exact_median(df, "t", "m").first()["m"]
        assert got == (statistics.median(values) if values else None)


def test_tiles(spark, monkeypatch):
    """No task orders a key, which one window once did."""
    monkeypatch.setattr(chunked, "PART", 40)
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 5), i) for i in range(501)] + [("c", 1, 600), ("c", 0, 601)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(3)
    got = chunked.tiles(df, "k", {"q": (5, "v, i"), "p": (3, "i, v")})
    want = df.selectExpr("*", "ntile(5) OVER (PARTITION BY k ORDER BY v, i) AS q", "ntile(3) OVER (PARTITION BY k ORDER BY i, v) AS p")
    assert {x.i: (x.k, x.q, x.p) for x in got.collect()} == {x.i: (x.k, x.q, x.p) for x in want.collect()}
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in line]
    assert windows and all("_part" in line for line in windows)
