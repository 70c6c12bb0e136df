"""Busy periods of streams, and upserts that survive replays and half-done batches."""

import random

import numpy as np
import pandas as pd
import pytest

from quarrystat.streaming import busy
from quarrystat.streaming.upsert import Upserts


def plain_periods(rows, gap):
    """Busy periods of (key, start s, end s, weight, label) by a walk in order of starts."""
    out = []
    for key in sorted({r[0] for r in rows}):
        now = None
        for _, s, e, w, x in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if now and s <= now[1] + gap:
                now = [now[0], max(now[1], e), now[2] + 1, now[3] + w, max(now[4], (w, x))]
            else:
                if now:
                    out.append((key, *now[:3], round(now[3], 6), now[4][1]))
                now = [s, e, 1, w, (w, x)]
        out.append((key, *now[:3], round(now[3], 6), now[4][1]))
    return out


def run_stream(spark, parts, tmp_path, late):
    """Closed periods of files of intervals, a micro-batch each, and one far interval that closes all."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    kinds = "k string, s timestamp, e timestamp, w double, x string"
    parts = [*parts, [("~", 4 * 10**9, 4 * 10**9, 0.0, "")]]
    for i, rows in enumerate(parts):
        pdf = pd.DataFrame(rows, columns=["k", "s", "e", "w", "x"])
        for c in ("s", "e"):
            pdf[c] = pd.to_datetime(pdf[c], unit="s").astype("datetime64[us]")
        pdf.to_parquet(folder / f"{i:03}.parquet")
        import os

        os.utime(folder / f"{i:03}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(folder))
    found = []
    q = (
        busy.busy_periods(stream, "k", "s", "e", "w", "x", 60.0, late).writeStream.outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, i: found.extend(df.selectExpr("key", "unix_seconds(start)", "unix_seconds(end)", "n", "round(total, 6)", "top").collect())).start()
    )
    assert q.awaitTermination(150)
    return sorted(tuple(r) for r in found if r[0] != "~")


def test_busy_periods_of_shuffled_batches(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for i in range(120):
        s = r.randint(1, 6000)
        rows.append((r.choice("ab"), s, s + r.choice([0, 10, 40, 200]), round(r.random(), 3), f"l{i % 7}"))
    r.shuffle(rows)
    assert run_stream(spark, [rows[i::3] for i in range(3)], tmp_path, "3 hours") == sorted(plain_periods(rows, 60))


def test_late_interval_joins_two_periods(spark, tmp_path):
    parts = [[("a", 9000, 9010, 1.0, "x"), ("a", 9200, 9210, 2.0, "y")], [("a", 9060, 9150, 0.5, "z"), ("a", 10000, 10000, 1.0, "w")]]
    assert run_stream(spark, parts, tmp_path, "10 minutes") == [("a", 9000, 9210, 3, 3.5, "y"), ("a", 10000, 10000, 1, 1.0, "w")]


def test_busy_periods_of_the_log(spark, sf, tmp_path):
    """The same periods as the batch query finds in the event log."""
    from quarrystat.operators.queueing import PLANS, long_wait

    log = long_wait.where("over > 0").df(spark, sf).selectExpr("CAST(user_id AS STRING) AS k", "prev_t", "t", "wait", "event_type").toPandas()
    rows = [(k, int(s), int(e), float(w), x) for k, s, e, w, x in log.itertuples(index=False)]
    users = sorted({r[0] for r in rows})[:10]
    rows = [r for r in rows if r[0] in users]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = busy.merged([[s, e, 1, w, w, x] for k, s, e, w, x in rows if k == users[0]], 60_000_000)
    want = PLANS["busy_period_segmentation_v2"].df(spark, sf).where(f"CAST(user_id AS STRING) = '{users[0]}'").collect()
    assert sorted((p[2], round(p[3] / 3600, 6), round((p[1] - p[0]) / 3600e6, 6)) for p in found) == sorted((r["n"], r["hours"], r["span_h"]) for r in want)


TOTALS = {"n": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}


@pytest.fixture
def batches(spark):
    r = random.Random(6)
    parts = [[(r.choice("abcdefgh"), r.randint(0, 3), float(r.randint(-5, 9))) for _ in range(n)] for n in (40, 7, 0, 25)]
    parts[1] = [("z", 1, 2.0), (None, 1, 3.0)]
    return [spark.createDataFrame(p, "k string, m int, v double") for p in parts], parts


def totals(parts):
    out = {}
    for k, m, v in (x for p in parts for x in p):
        out.setdefault((k, m), []).append(v)
    return sorted(((k, m, len(v), sum(v), min(v), max(v)) for (k, m), v in out.items()), key=str)


def read(spark, table):
    return sorted((tuple(r[c] for c in ("k", "m", "n", "total", "low", "high")) for r in table.table(spark).collect()), key=str)


def test_upserts_and_replays(spark, batches, tmp_path):
    frames, parts = batches
    table = Upserts(str(tmp_path / "t"), ["k", "m"], TOTALS, buckets=8)
    assert table.table(spark) is None
    for i, df in enumerate(frames):
        table.apply(df, i)
        table.apply(df, i)  # a replayed batch changes nothing
        assert read(spark, table) == totals(parts[: i + 1])
    # a batch writes the buckets that it touches, no others
    before, after = table.versions(spark, 1), table.versions(spark, 2)
    touched = {b for b in after if after[b] == 1}
    assert 1 <= len(touched) <= 2 and all(after[b] == before[b] for b in before if b not in touched)
    table.vacuum(spark)
    assert read(spark, table) == totals(parts)


def test_batch_that_died(spark, batches, tmp_path):
    """A batch that stops after its data are written and before its commit is done again from the same versions."""
    frames, parts = batches
    table = Upserts(str(tmp_path / "t"), ["k", "m"], TOTALS, buckets=8)
    table.apply(frames[0], 0)
    commit, table._commit = table._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("died"))
    for _ in range(2):
        with pytest.raises(RuntimeError):
            table.apply(frames[1], 1)
    assert read(spark, table) == totals(parts[:1]) and table.commits(spark) == [0]
    table._commit = commit
    table.apply(frames[1], 1)
    assert read(spark, table) == totals(parts[:2])


def test_upserts_of_a_stream(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").toPandas()
    for i, part in enumerate(np.array_split(rows, 3)):
        (tmp_path / "in").mkdir(exist_ok=True)
        part.to_parquet(tmp_path / "in" / f"{i}.parquet", coerce_timestamps="us")
    kinds = spark.read.parquet(str(tmp_path / "in")).schema
    table = Upserts(str(tmp_path / "t"), ["event_type"], {"n": ("count", "event_id"), "total": ("sum", "value")}, buckets=4)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert table.start(stream, str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    want = {k: (len(g), round(g["value"].sum(), 4)) for k, g in rows.groupby("event_type")}
    assert {r["event_type"]: (r["n"], round(r["total"], 4)) for r in table.table(spark).collect()} == want
