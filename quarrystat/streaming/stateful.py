"""Online recursions with state by key: EWMA, CUSUM, conformal alarms and P² quantiles, and running sums.

State is a few numbers a key, whatever the number of its rows. Rows of one micro-batch are taken in time order; rows later than
the watermark are dropped by Spark before they come here. A restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CONTROL = "key string, n long, mean double, sd double, ewma double, cusum_up double, cusum_down double, alarms long"


class Control:
    """Welford's mean and deviation; EWMA and CUSUM of values against those of the rows before, after ``warm`` rows."""

    def __init__(self, lam: float = 0.2, k: float = 0.5, h: float = 5.0, warm: int = 30):
        self.lam, self.k, self.h, self.warm = lam, k, h, warm
        self.n, self.mean, self.m2, self.ewma, self.up, self.down, self.alarms = 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0

    def add(self, x: float) -> bool:
        sd, hit = (self.m2 / self.n) ** 0.5 if self.n else 0.0, False
        if self.n >= self.warm and sd > 0:
            z = (x - self.mean) / sd
            self.up, self.down = max(0.0, self.up + z - self.k), max(0.0, self.down - z - self.k)
            if hit := max(self.up, self.down) > self.h:
                self.alarms += 1
                self.up = self.down = 0.0
        self.ewma = x if self.n == 0 else self.lam * x + (1 - self.lam) * self.ewma
        self.n += 1
        d = x - self.mean
        self.mean += d / self.n
        self.m2 += d * (x - self.mean)
        return hit

    def state(self) -> tuple:
        return self.n, self.mean, self.m2, self.ewma, self.up, self.down, self.alarms

    def load(self, state: tuple) -> None:
        self.n, self.mean, self.m2, self.ewma, self.up, self.down, self.alarms = state

    def row(self) -> tuple:
        return self.n, self.mean, (self.m2 / self.n) ** 0.5 if self.n else None, self.ewma, self.up, self.down, self.alarms


def _rows(stream: DataFrame, time: str, key: str, value: str, late: str) -> DataFrame:
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(value).cast("double").alias("x"))
    return rows.where("key IS NOT NULL AND at IS NOT NULL AND x IS NOT NULL").withWatermark("at", late)


def online_control(stream: DataFrame, time: str, key: str, value: str, late: str = "2 hours", **params) -> DataFrame:
    """One row for each key that a micro-batch touches: its charts after the batch. Update mode."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chart = Control(**params)
        if state.exists:
            chart.load(state.get)
        for x in pd.concat(list(frames)).sort_values("at", kind="stable")["x"]:
            chart.add(float(x))
        state.update(chart.state())
        yield pd.DataFrame([(key[0], *chart.row())], columns=[c.split()[0] for c in CONTROL.split(", ")])

    kinds = "n long, mean double, m2 double, ewma double, up double, down double, alarms long"
    return _rows(stream, time, key, value, late).groupBy("key").applyInPandasWithState(run, CONTROL, kinds, "update", GroupStateTimeout.NoTimeout)


def conformal_alarms(errors: list[float], x: float, recent: list[float], window: int, calibrate: int, alpha: float) -> bool:
    """Take x in: whether its distance from the mean of the last ``window`` values exceeds the (1 − alpha) quantile of the last
    ``calibrate`` such distances. Both lists are kept at their lengths."""
    hit = False
    if len(recent) == window:
        e = abs(x - float(np.mean(recent)))
        hit = len(errors) == calibrate and e > float(np.quantile(errors, 1 - alpha))
        errors.append(e)
        del errors[:-calibrate]
    recent.append(x)
    del recent[:-window]
    return hit


def online_conformal(stream: DataFrame, time: str, key: str, value: str, late: str = "2 hours", window: int = 5, calibrate: int = 10, alpha: float = 0.1) -> DataFrame:
    """A row (key, at, x) for each alarm. Append mode."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, recent = json.loads(state.get[0]) if state.exists else ([], [])
        found = []
        for at, x in pd.concat(list(frames)).sort_values("at", kind="stable")[["at", "x"]].itertuples(index=False):
            if conformal_alarms(errors, float(x), recent, window, calibrate, alpha):
                found.append((key[0], at, float(x)))
        state.update((json.dumps([errors, recent]),))
        yield pd.DataFrame(found, columns=["key", "at", "x"])

    return _rows(stream, time, key, value, late).groupBy("key").applyInPandasWithState(run, "key string, at timestamp, x double", "state string", "append", GroupStateTimeout.NoTimeout)


def online_quantiles(stream: DataFrame, time: str, key: str, value: str, p: float = 0.9, late: str = "2 hours") -> DataFrame:
    """The P² estimate of one quantile by key after each micro-batch. Update mode."""
    from quarrystat.operators.panel_models import P2

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sketch = P2(p)
        if state.exists:
            sketch.__dict__.update(json.loads(state.get[0]))
        for x in pd.concat(list(frames)).sort_values("at", kind="stable")["x"]:
            sketch.add(float(x))
        state.update((json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in sketch.__dict__.items()}),))
        yield pd.DataFrame([(key[0], sketch.value())], columns=["key", "estimate"])

    return _rows(stream, time, key, value, late).groupBy("key").applyInPandasWithState(run, "key string, estimate double", "state string", "update", GroupStateTimeout.NoTimeout)


def running_sums(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums and numbers of rows by key over all batches: the upsert of a batch is the update-mode row of its keys."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
