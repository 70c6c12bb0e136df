"""Stateful streams give what one pass in time order gives, over several micro-batches."""

import numpy as np
import pytest

from quarrystat.operators.panel_models import P2
from quarrystat.streaming import stateful as S


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The event log in three files, in time order."""
    path = tmp_path_factory.mktemp("stream")
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    for i, part in enumerate(np.array_split(rows, 3)):
        part.to_parquet(path / f"{i}.parquet", coerce_timestamps="us")
    return path, rows


def drain(spark, parts, tmp_path, build, mode):
    path, _ = parts
    kinds = spark.read.parquet(str(path)).schema
    found = []
    q = (
        build(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(path)))
        .writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        .foreachBatch(lambda df, i: found.append([r.asDict() for r in df.collect()])).start()
    )
    q.awaitTermination(180)
    return found


def test_control(spark, parts, tmp_path):
    batches = drain(spark, parts, tmp_path, lambda s: S.online_control(s, "ts", "event_type", "value"), "update")
    assert sum(bool(b) for b in batches) >= 3
    last = {r["key"]: r for b in batches for r in b}
    for kind, rows in parts[1].groupby("event_type"):
        chart = S.Control()
        for x in rows["value"]:
            chart.add(float(x))
        assert np.allclose([last[kind][c] for c in ("n", "mean", "ewma", "cusum_up", "cusum_down", "alarms")], [chart.n, chart.mean, chart.ewma, chart.up, chart.down, chart.alarms])
        assert last[kind]["sd"] == pytest.approx(rows["value"].std(ddof=0))


def test_conformal(spark, parts, tmp_path):
    batches = drain(spark, parts, tmp_path, lambda s: S.online_conformal(s, "ts", "event_type", "value"), "append")
    got = sorted((r["key"], r["x"]) for b in batches for r in b)
    want = []
    for kind, rows in parts[1].groupby("event_type"):
        errors, recent = [], []
        want += [(kind, float(x)) for x in rows["value"] if S.conformal_alarms(errors, float(x), recent, 5, 10, 0.1)]
    assert got == sorted(want) and want


def test_quantiles_and_sums(spark, parts, tmp_path):
    batches = drain(spark, parts, tmp_path, lambda s: S.online_quantiles(s, "ts", "event_type", "value", 0.9), "update")
    last = {r["key"]: r["estimate"] for b in batches for r in b}
    for kind, rows in parts[1].groupby("event_type"):
        sketch = P2(0.9)
        for x in rows["value"]:
            sketch.add(float(x))
        assert last[kind] == pytest.approx(sketch.value())
    sums = drain(spark, parts, tmp_path / "b", lambda s: S.running_sums(s, ["event_type"], "value"), "update")
    last = {r["event_type"]: (r["n"], r["total"]) for b in sums for r in b}
    for kind, rows in parts[1].groupby("event_type"):
        assert last[kind] == (len(rows), pytest.approx(rows["value"].sum()))


def test_a_shift_raises_alarms():
    chart = S.Control()
    r = np.random.default_rng(1)
    before = [chart.add(x) for x in r.normal(0, 1, 60)]
    after = [chart.add(x) for x in r.normal(4, 1, 10)]
    assert sum(before) <= 1 and any(after)


