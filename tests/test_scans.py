"""Scans equal the recursions, a row after another, for keys of any length."""

import random

import numpy as np
import pytest

from quarrystat.operators import recursions
from quarrystat.plans import scans


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(4)
    rows = []
    for key, n in (("a", 1), ("b", 7), ("c", 400), (None, 9), ("d", 64), ("e", 65)):
        for i in range(n):
            rows.append((key, r.randint(0, 10**6), len(rows), round(r.gauss(0, 1), 3) if r.random() > 0.05 else None))
    df = spark.createDataFrame(rows, "k string, s long, i long, v double").selectExpr("k", "timestamp_seconds(s) AS ts", "i", "v").repartition(5)
    by_key = {}
    for k, s, i, v in sorted(rows, key=lambda x: (x[1], x[2])):
        by_key.setdefault(k, []).append((i, v))
    return df, by_key


@pytest.mark.parametrize("block", [2, 4, 64, 256])
def test_averages_and_sums(series, block):
    df, by_key = series
    got = {r["i"]: r for r in scans.cusum(scans.ewma(df, "k", ["ts", "i"], "v", 0.2, "e", block), "k", ["ts", "i"], "v", 0.5, "up", "down", block).collect()}
    assert len(got) == sum(map(len, by_key.values()))
    for rows in by_key.values():
        e, up, down = 0.0, 0.0, 0.0
        for place, (i, v) in enumerate(rows):
            if v is not None:
                e = v if place == 0 else 0.2 * v + 0.8 * e
                up, down = max(0.0, up + v - 0.5), max(0.0, down - v - 0.5)
            assert np.allclose([got[i]["e"], got[i]["up"], got[i]["down"]], [e, up, down], atol=1e-9)


@pytest.mark.parametrize("block", [3, 256])
def test_kalman(series, block):
    df, by_key = series
    got = {r["i"]: r for r in scans.kalman(df.selectExpr("*", "0.8D AS n", "0.008D AS d"), "k", ["ts", "i"], "v", "n", "d", "m", block).collect()}
    for rows in by_key.values():
        m, p = None, 1.0
        for place, (i, v) in enumerate(rows):
            p += 0.008
            if v is not None:
                g = p / (p + 0.8)
                m, p = v if place == 0 else (m or 0.0) + g * (v - (m or 0.0)), (1 - g) * p
                assert abs(got[i]["m_gain"] - g) < 1e-9
            assert abs(got[i]["m"] - (m or 0.0)) < 1e-9


def test_whole_summary(spark, series):
    """The chart of all recursions equals the plain loops."""
    df, by_key = series
    got = {r["key"]: r for r in recursions.chart(df.where("v IS NOT NULL"), "k", "ts", "i", "v", 16).collect()}
    for key, rows in by_key.items():
        x = np.array([v for _, v in rows if v is not None])
        if key is None or len(x) < 2:
            continue
        up, down = recursions.cusum(x)
        want = [len(x), recursions.ewma(x)[-1], up.max(), down.max(), recursions.page_hinkley(x), recursions.ddm((x > np.median(x)).astype(int)), recursions.kalman(x)[-1]]
        assert np.allclose([got[key][c] for c in ("n", "ewma_last", "cusum_up", "cusum_down", "page_hinkley", "ddm_alarm", "kalman_last")], want, atol=1e-5), key


def test_no_group_holds_a_key(series):
    """Groups of rows are keyed by block as well."""
    df, _ = series
    plan = scans.ewma(df, "k", ["ts", "i"], "v", 0.2, "e")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_i" in line or "_up" in line for line in plan.split("\n") if "collect_list" in line)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, i long, v double")
    assert scans.ewma(df, "k", ["ts", "i"], "v", 0.2, "e").collect() == []


def test_a_chart_numbers_its_rows_once(spark, sf, monkeypatch):
    """Each scan once ordered all rows again, and medians kept a key's values in one buffer."""
    calls, place = [], recursions.place_in_order
    monkeypatch.setattr(recursions, "place_in_order", lambda *a: calls.append(a) or place(*a))
    monkeypatch.setattr(scans, "place_in_order", lambda *a: calls.append(a) or place(*a))
    out = recursions.chart(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "ts", "event_id", "value")
    assert len(calls) == 1 and out.count() == 5
    rows = recursions._standard(spark.range(9).selectExpr("id % 2 AS key", "CAST(id AS DOUBLE) AS x"), "x", "z")
    assert "percentile(" not in rows._jdf.queryExecution().optimizedPlan().toString()
