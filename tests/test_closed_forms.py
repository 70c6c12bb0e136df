"""Closed forms against numpy and plain recursions."""

import numpy as np
import pytest

from quarrystat.operators import buckets, moments


@pytest.fixture(scope="module")
def columns(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount").toPandas()
    return df.to_numpy(dtype=float)


def test_eigenvalues_and_partial_correlations(spark, sf, columns):
    got = moments.three().df(spark, sf).first()
    r = np.corrcoef(columns, rowvar=False)
    assert [got.e1, got.e2, got.e3] == pytest.approx(sorted(np.linalg.eigvalsh(r), reverse=True), abs=1e-6)
    p = np.linalg.inv(r)
    assert got.pxy == pytest.approx(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]), abs=1e-9)


def test_t2_is_the_mahalanobis_distance(spark, sf, columns):
    d = columns - columns.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(d, rowvar=False, ddof=0)), d)
    got = [r.t2 for r in moments.distance.select("t2").df(spark, sf).collect()]
    assert np.allclose(sorted(got), sorted(want))


def test_cusum_equals_the_recursion(spark, sf):
    rows = buckets.cusum.select("event_type", "i", "z", "up", "down").df(spark, sf).collect()
    for kind in {r.event_type for r in rows}:
        up = down = 0.0
        for r in sorted((r for r in rows if r.event_type == kind), key=lambda r: r.i):
            up, down = max(0.0, up + r.z - 0.5), max(0.0, down - r.z - 0.5)
            assert (r.up, r.down) == pytest.approx((up, down), abs=1e-6)


def test_power_equals_the_fft(spark, sf):
    rows = buckets.hours.select("event_type", "i", "n", "mn").df(spark, sf).collect()
    got = {(r.event_type, r.k): r.power for r in buckets.wave(buckets.hours.add(x="n - mn"), "x").df(spark, sf).collect()}
    for kind in {r.event_type for r in rows}:
        x = np.array([r.n for r in sorted((r for r in rows if r.event_type == kind), key=lambda r: r.i)], dtype=float)
        power = np.abs(np.fft.fft(x - x.mean())) ** 2
        for k in range(1, min(33, len(x) // 2)):
            assert got[kind, k] == pytest.approx(power[k], abs=1e-4)
