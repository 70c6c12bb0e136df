"""Busy periods of a stream of intervals: merged while they overlap or lie within a gap, closed by event-time timers.

A session window closes by the gaps between starts; a busy period by the gap to the latest end so far, and a late interval may
join two periods that are still open. A key's state is its open periods, sorted; a period is emitted once no interval that the
watermark still lets in can reach it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PERIODS = "key string, start timestamp, end timestamp, n long, total double, top string"


def merged(periods: list[list], gap: int) -> list[list]:
    """Periods [start, end, n, total, largest, its label] in microseconds, joined where one starts at most ``gap`` after another's end."""
    out: list[list] = []
    for p in sorted(periods, key=lambda p: (p[0], p[1])):
        if out and p[0] <= out[-1][1] + gap:
            last = out[-1]
            last[1], last[2], last[3] = max(last[1], p[1]), last[2] + p[2], last[3] + p[3]
            last[4:] = max(last[4:], p[4:])
        else:
            out.append(list(p))
    return out


class BusyPeriods(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "periods string")

    def _load(self) -> list[list]:
        return json.loads(self.open.get()[0]) if self.open.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self._load()
        before = {p[1] for p in known}
        for pdf in rows:
            known += [[int(s), int(e), 1, float(w), float(w), str(x)] for s, e, w, x in zip(pdf["s"], pdf["e"], pdf["weight"], pdf["label"])]
        known = merged(known, self.gap)
        for p in known:
            if p[1] not in before:
                self.handle.registerTimer((p[1] + self.gap) // 1000 + 1)
        self.open.update((json.dumps(known),))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = self._load()
        done = [p for p in known if p[1] + self.gap < passed]
        left = [p for p in known if p[1] + self.gap >= passed]
        if left:
            self.open.update((json.dumps(left),))
        else:
            self.open.clear()
        if done:
            made = pd.DataFrame([(str(key[0]), p[0], p[1], p[2], p[3], p[5]) for p in done], columns=["key", "start", "end", "n", "total", "top"])
            for c in ("start", "end"):
                made[c] = pd.to_datetime(made[c], unit="us")
            yield made

    def close(self) -> None:
        pass


def busy_periods(stream: DataFrame, key: str, start: str, end: str, weight: str, label: str, gap_seconds: float = 60.0, late: str = "2 hours") -> DataFrame:
    """One row for each closed busy period (append mode): its key, bounds, intervals, their total weight and the label of the
    largest. Intervals without a key, a bound or a weight, or that end before they start, are left out; one whose start is past the
    watermark is dropped by Spark. Needs the RocksDB state store."""
    stamp = lambda c: F.col(c).cast("timestamp")
    rows = stream.select(
        F.col(key).cast("string").alias("key"), stamp(start).alias("at"), F.unix_micros(stamp(start)).alias("s"), F.unix_micros(stamp(end)).alias("e"),
        F.col(weight).cast("double").alias("weight"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"),
    )
    rows = rows.where("key IS NOT NULL AND s IS NOT NULL AND e >= s AND weight IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(BusyPeriods(int(gap_seconds * 1_000_000)), PERIODS, "Append", "EventTime")
