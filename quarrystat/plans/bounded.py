"""Operators over small summaries of large tables.

Sequential, spectral, matrix and graph algorithms need all of their input at once. Here that input is never a table's rows:
Spark first reduces the table to a summary whose size the rows don't set, and a numpy function then sees the summary.

- ``series``: for each key the means and counts of time buckets (at most as many as the time range holds),
- ``panel``: the matrix of time buckets by keys,
- ``network``: distinct (source, target) pairs of a key graph with their weights,
- ``moments``: counts, sums and products of numeric columns, exact over all rows.

Each operator is a function of a DataFrame with roles as parameters and gives the columns of its schema behind the key,
``n`` and ``status``: 'ok', or 'na' with nulls where there is less input than the operator's minimum or it has no result.
Rows with null time, key or value don't count. An empty table gives no rows for ``series`` and one 'na' row for the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    schema: str
    minimum: int
    body: Callable
    params: dict = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]


OPERATORS: dict[str, Operator] = {}


def operator(kind: str, name: str, schema: str, minimum: int = 8, **params):
    """Decorator: ``body(summary…, **params)`` gives a dict, a list of dicts, or None where there is no result."""

    def add(body: Callable) -> Callable:
        if name in OPERATORS:
            raise ValueError(f"{name} is defined twice")
        OPERATORS[name] = Operator(name, kind, schema, minimum, body, params)
        return body

    return add


def _rows(op: Operator, n: int, call: Callable[[], object], lead: dict) -> pd.DataFrame:
    found = call() if n >= op.minimum else None
    found = [found] if isinstance(found, dict) else list(found or [])
    status = "ok" if found else "na"
    names = op.columns()
    rows = [lead | {"n": n, "status": status} | {c: r.get(c) for c in names} for r in found or [{}]]
    out = pd.DataFrame(rows, columns=[*lead, "n", "status", *names])
    for c, kind in (p.split(" ", 1) for p in op.schema.split(", ")):
        if kind == "double":
            # numbers that don't exist are null, and zero has one sign
            out[c] = [None if v is None or not np.isfinite(v) else round(float(v), 9) + 0.0 for v in out[c]]
            out[c] = out[c].astype("float64")
        elif kind == "boolean":
            out[c] = pd.array([None if v is None else bool(v) for v in out[c]], dtype="boolean")
        elif kind == "long":
            out[c] = pd.array([None if v is None else int(v) for v in out[c]], dtype="Int64")
    return out


def cells(df: DataFrame, time: str, key: str, value: str, bucket: str) -> DataFrame:
    """Rows (k, b, s, n): sum and number of a key's values in each time bucket; ``b`` counts buckets since the epoch."""
    seconds = {"minute": 60, "hour": 3600, "day": 86400}[bucket]
    x = F.col(value).cast("double")
    rows = df.select(F.col(key).cast("string").alias("k"), F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000)).alias("b"), x.alias("x"))
    rows = rows.where("k IS NOT NULL AND b IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    return rows.groupBy("k", "b").agg(F.sum("x").alias("s"), F.count("*").alias("n"))


def run_series(op: Operator, df: DataFrame, time: str, key: str, value: str, bucket: str = "hour", **params) -> DataFrame:
    """The operator on each key's series: ``body(y, c)``, y means of the buckets that have rows, c counts of all buckets."""
    params = op.params | params

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        y = (pdf["s"] / pdf["n"]).to_numpy(float)
        b = pdf["b"].to_numpy(np.int64)
        c = np.zeros(int(b[-1] - b[0]) + 1)
        c[b - b[0]] = pdf["n"]
        return _rows(op, len(y), lambda: op.body(y, c, **params), {"key": pdf["k"].iloc[0]})

    return cells(df, time, key, value, bucket).groupBy("k").applyInPandas(one, f"key string, n long, status string, {op.schema}")


def _alone(df: DataFrame, empty: str, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``one`` on all rows of a summary together; an empty summary still gives a call."""
    mark = df.sparkSession.range(1).selectExpr(f"named_struct({empty}) AS r").select("r.*")
    both = df.withColumn("_real", F.lit(True)).unionByName(mark.withColumn("_real", F.lit(False)))
    return both.groupBy(F.lit(1).alias("_one")).applyInPandas(lambda pdf: one(pdf[pdf["_real"]]), schema)


def run_panel(op: Operator, df: DataFrame, time: str, key: str, value: str, bucket: str = "hour", **params) -> DataFrame:
    """The operator on the matrix of buckets by keys: ``body(x, c, keys)``, x means (a missing cell is its key's mean), c counts."""
    params = op.params | params

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(pdf["k"].unique())
        at = np.sort(pdf["b"].unique())
        x, c = np.full((len(at), len(keys)), np.nan), np.zeros((len(at), len(keys)))
        i, j = np.searchsorted(at, pdf["b"]), np.searchsorted(np.array(keys, dtype=object), pdf["k"]) if len(pdf) else ([], [])
        if len(pdf):
            x[i, j], c[i, j] = pdf["s"] / pdf["n"], pdf["n"]
            x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
        return _rows(op, len(at), lambda: op.body(x, c, keys, **params), {})

    empty = "'k', '', 'b', 0L, 's', 0D, 'n', 0L"
    return _alone(cells(df, time, key, value, bucket), empty, one, f"n long, status string, {op.schema}")


def run_network(op: Operator, edges: DataFrame, source: str, target: str, weight: str, **params) -> DataFrame:
    """The operator on a weighted directed graph: ``body(names, w)`` with the matrix of summed weights.

    The key graph must be small (activities, hosts, nations): its matrix has nodes squared cells."""
    params = op.params | params
    pairs = edges.select(F.col(source).cast("string").alias("u"), F.col(target).cast("string").alias("v"), F.col(weight).cast("double").alias("w"))
    pairs = pairs.where("u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL").groupBy("u", "v").agg(F.sum("w").alias("w"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["u"], *pdf["v"]})
        w = np.zeros((len(names), len(names)))
        at = {x: i for i, x in enumerate(names)}
        for u, v, x in zip(pdf["u"], pdf["v"], pdf["w"]):
            w[at[u], at[v]] = x
        return _rows(op, len(names), lambda: op.body(names, w, **params), {})

    return _alone(pairs, "'u', '', 'v', '', 'w', 0D", one, f"n long, status string, {op.schema}")


def moment_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, means, products): number, means and centred co-moments of ``columns`` over all rows without nulls in them."""
    x = [F.col(c).cast("double") for c in columns]
    whole = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]).dropna()
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    aggregates = [F.coalesce(F.covar_pop(f"x{i}", f"x{j}"), F.lit(0.0)) for i, j in pairs]
    return whole.agg(
        F.count("*").alias("n"), F.array(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)) for i in range(len(x))]).alias("means"), F.array(*aggregates).alias("products")
    )


def run_moments(op: Operator, df: DataFrame, columns: list[str], **params) -> DataFrame:
    """The operator on exact moments: ``body(n, mean, cov, columns)``."""
    params = op.params | params
    p = len(columns)

    def one(batches):
        for pdf in batches:
            for n, means, products in zip(pdf["n"], pdf["means"], pdf["products"]):
                cov = np.zeros((p, p))
                cov[np.triu_indices(p)] = products
                cov = cov + np.triu(cov, 1).T
                yield _rows(op, int(n), lambda: op.body(int(n), np.array(means), cov, columns, **params), {})  # noqa: B023

    return moment_row(df, columns).mapInPandas(one, f"n long, status string, {op.schema}")


def apply(name: str, df: DataFrame, **roles) -> DataFrame:
    """Run an operator by name; roles and parameters by keyword."""
    op = OPERATORS[name]
    return {"series": run_series, "panel": run_panel, "network": run_network, "moments": run_moments}[op.kind](op, df, **roles)
