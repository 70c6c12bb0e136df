"""Recursions along the rows of a key: EWMA, CUSUM, Page-Hinkley, DDM, scalar Kalman.

``chart`` and the charts below it run over all rows as scans (``plans/scans.py``), so that no task holds a key; the plain loops
above them are what a single series gives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystat.plans import scans
from quarrystat.plans.chunked import near_windows, place_in_order, running_sum
from quarrystat.plans.registry import register
from quarrystat.plans.selection import with_quantiles


def ewma(x: np.ndarray, alpha: float = 0.2) -> np.ndarray:
    out, s = np.empty(len(x)), 0.0
    for i, v in enumerate(x):
        s = v if i == 0 else alpha * v + (1 - alpha) * s
        out[i] = s
    return out


def cusum(x: np.ndarray, slack: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower sums of the standardised series."""
    z = (x - np.median(x)) / (1.4826 * np.median(np.abs(x - np.median(x))) or 1.0)
    up, down, a, b = np.empty(len(x)), np.empty(len(x)), 0.0, 0.0
    for i, v in enumerate(z):
        a, b = max(0.0, a + v - slack), max(0.0, b - v - slack)
        up[i], down[i] = a, b
    return up, down


def page_hinkley(x: np.ndarray, delta: float = 0.005) -> float:
    """Largest rise of the cumulative deviation above its running minimum."""
    s, low, best, mean = 0.0, 0.0, 0.0, 0.0
    for i, v in enumerate(x, 1):
        mean += (v - mean) / i
        s += v - mean - delta
        low = min(low, s)
        best = max(best, s - low)
    return best


def ddm(errors: np.ndarray, least: int = 30) -> int:
    """Index of the first drift alarm of a 0/1 error stream, or -1."""
    p, best, spread = 0.0, float("inf"), float("inf")
    for i, e in enumerate(errors, 1):
        p += (e - p) / i
        s = (p * (1 - p) / i) ** 0.5
        if i >= least:
            if p + s < best + spread:
                best, spread = p, s
            if p + s > best + 3 * spread:
                return i - 1
    return -1


def kalman(x: np.ndarray, q: float = 0.01) -> np.ndarray:
    """Local-level filter with observation variance from the series."""
    r, m, p = float(np.var(x)) or 1.0, float(x[0]), 1.0
    out = np.empty(len(x))
    for i, v in enumerate(x):
        p += q * r
        g = p / (p + r)
        m, p = m + g * (v - m), (1 - g) * p
        out[i] = m
    return out


def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts", "event_id"])
    x = pdf["value"].to_numpy(dtype=float)
    up, down = cusum(x)
    e = (x > np.median(x)).astype(int)
    row = {
        "event_type": pdf["event_type"].iloc[0], "n": len(x), "ewma_last": ewma(x)[-1], "cusum_up": up.max(), "cusum_down": down.max(),
        "page_hinkley": page_hinkley(x), "ddm_alarm": ddm(e), "kalman_last": kalman(x)[-1],
    }
    return pd.DataFrame([row])


def _standard(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the value less its key's median in units of 1.4826 MAD (null where that is 0)."""
    at = with_quantiles(rows, ["key"], {"_med": (value, 0.5)}, {})
    near = lambda a, b: a.join(b.withColumnRenamed("key", "_k"), a["key"].eqNullSafe(F.col("_k"))).drop("_k")
    rows = near(rows, at)
    scale = with_quantiles(rows, ["key"], {"_mad": (f"abs({value} - _med)", 0.5)}, {})
    return near(rows, scale).withColumn(name, (F.col(value) - F.col("_med")) / F.nullif(1.4826 * F.col("_mad"), F.lit(0.0))).drop("_mad").withColumnRenamed("_med", "med")


def _rows(df: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("x"))
    return rows.where("t IS NOT NULL AND x IS NOT NULL")


def chart(df: DataFrame, key: str, time: str, tie: str, value: str, block: int = 256) -> DataFrame:
    """One row a key: its rows, last EWMA, highest cumulative sums up and down, Page-Hinkley's largest rise, the place of DDM's first
    alarm on values above the median (-1: none) and the filter's last level. A constant key's values stay as they are."""
    order = ["t", "tie"]
    rows = _standard(_rows(df, key, time, tie, value), "x", "z").withColumn("z", F.coalesce("z", F.col("x") - F.col("med")))
    noise = rows.groupBy(F.col("key").alias("_k")).agg(F.coalesce(F.nullif(F.var_pop("x"), F.lit(0.0)), F.lit(1.0)).alias("noise"))
    rows = rows.join(noise, rows["key"].eqNullSafe(noise["_k"])).drop("_k")
    rows = place_in_order(rows, "key", order, "place")
    rows = running_sum(running_sum(rows, "key", order, "sum_x", "x"), "key", order, "sum_e", "CAST(x > med AS INT)")
    p = F.col("sum_e") / F.col("place")
    rows = rows.withColumn("p", p).withColumn("s", F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("place")))
    x, z, n, d = F.col("x"), F.col("z"), F.col("noise"), 0.01 * F.col("noise")
    first = F.col("place") == 1
    sums = {"up": z - 0.5, "down": -z - 0.5, "rise": x - F.col("sum_x") / F.col("place") - 0.005}
    far = scans.double(float("inf"))
    told = F.struct(
        F.struct(F.when(first, 0.0).otherwise(0.8).alias("a"), F.when(first, x).otherwise(0.2 * x).alias("b")).alias("mean"),
        F.struct(*[c for k, v in sums.items() for c in (v.alias(f"c_{k}"), scans.double(0).alias(f"f_{k}"))]).alias("sums"),
        F.struct(*[F.when(F.col("place") >= 30, c).otherwise(far).alias(k) for k, c in (("level", F.col("p") + F.col("s")), ("p", F.col("p")), ("s", F.col("s")))]).alias("best"),
        F.struct(n.alias("p"), (n * d).alias("q"), scans.double(1).alias("r"), (d + n).alias("s")).alias("var"),
    )
    every = scans.together(mean=scans.affine(), sums=scans.max_plus(*sums), best=scans.lowest("level", "p", "s"), var=scans.moebius())
    rows = scans.scan_rows(rows, "key", order, lambda _: told, every, "now", block, "place")
    gain = F.col("now.var.v") / F.col("noise")
    step = F.when(first, F.struct(scans.double(0).alias("a"), x.alias("b"))).otherwise(F.struct((1 - gain).alias("a"), (gain * x).alias("b")))
    rows = scans.scan_rows(rows, "key", order, lambda _: step, scans.affine(), "level", block, "place")
    alarm = (F.col("place") >= 30) & (F.col("p") + F.col("s") > F.col("now.best.p") + 3 * F.col("now.best.s"))
    return rows.groupBy("key").agg(
        F.count("*").alias("n"), F.max_by("now.mean.x", "place").alias("ewma_last"), F.max("now.sums.up").alias("cusum_up"), F.max("now.sums.down").alias("cusum_down"),
        F.max("now.sums.rise").alias("page_hinkley"), F.coalesce(F.min(F.when(alarm, F.col("place") - 1)), F.lit(-1)).cast("long").alias("ddm_alarm"), F.max_by("level.x", "place").alias("kalman_last"),
    )


#: Rows with their place, standardised value, running means and cumulative sums.
_STANDARD = """
e AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT event_type, quantile_cont(x, 0.5) AS med, CASE WHEN var_pop(x) = 0 THEN 1 ELSE var_pop(x) END AS v FROM e GROUP BY event_type),
m AS (SELECT event_type, 1.4826 * quantile_cont(abs(x - med), 0.5) AS sd FROM e JOIN s USING (event_type) GROUP BY event_type),
r AS (SELECT e.event_type, x, i, med, v, CASE WHEN sd = 0 THEN NULL ELSE (x - med) / sd END AS z FROM e JOIN s USING (event_type) JOIN m USING (event_type)),
c AS (SELECT *, sum(z - 0.5) OVER w AS cu, sum(-z - 0.5) OVER w AS cd FROM r WINDOW w AS (PARTITION BY event_type ORDER BY i))"""


@register("control_chart_recursions", f"""
WITH RECURSIVE {_STANDARD},
q AS (SELECT *, avg(x) OVER w AS mean, avg((x > med)::INT) OVER w AS p FROM c WINDOW w AS (PARTITION BY event_type ORDER BY i)),
h AS (SELECT *, sum(x - mean - 0.005) OVER w AS ph, sqrt(p * (1 - p) / i) AS sp FROM q WINDOW w AS (PARTITION BY event_type ORDER BY i)),
u AS (SELECT *, cu - least(0, min(cu) OVER w) AS up, cd - least(0, min(cd) OVER w) AS down, ph - least(0, min(ph) OVER w) AS rise,
             arg_min(p, p + sp) FILTER (i >= 30) OVER w AS bp, arg_min(sp, p + sp) FILTER (i >= 30) OVER w AS bs, max(i) OVER (PARTITION BY event_type) AS n
      FROM h WINDOW w AS (PARTITION BY event_type ORDER BY i)),
k AS (SELECT event_type, i, x AS level, (1 + 0.01 * v) * v / (1 + 1.01 * v) AS var FROM r WHERE i = 1
      UNION ALL SELECT r.event_type, r.i, level + (var + 0.01 * v) / (var + 1.01 * v) * (x - level), (var + 0.01 * v) * v / (var + 1.01 * v)
      FROM k JOIN r ON r.event_type = k.event_type AND r.i = k.i + 1)
SELECT event_type, count(*) AS n, round(sum(x * power(0.8, n - u.i) * CASE WHEN u.i = 1 THEN 1 ELSE 0.2 END), 5) AS ewma_last, round(max(up), 5) AS cusum_up, round(max(down), 5) AS cusum_down,
       round(max(rise), 5) AS page_hinkley, coalesce(min(u.i - 1) FILTER (u.i >= 30 AND p + sp > bp + 3 * bs), -1)::BIGINT AS ddm_alarm, round(any_value(last.level), 5) AS kalman_last
FROM u JOIN (SELECT event_type, arg_max(level, i) AS level FROM k GROUP BY event_type) last USING (event_type) GROUP BY event_type""")
def _recursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chart(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "event_id", "value")
    shown = ("ewma_last", "cusum_up", "cusum_down", "page_hinkley", "kalman_last")
    return out.select(F.col("key").alias("event_type"), "n", *[F.round(c, 5).alias(c) for c in shown], "ddm_alarm")


def cusum_rows(df: DataFrame, key: str, time: str, tie: str, value: str, residual: int | None = None) -> DataFrame:
    """All rows with cumulative sums up and down of robustly standardised values, or of what a value is above the mean of the
    ``residual`` rows before it; rows with fewer before them are left out."""
    rows = _rows(df, key, time, tie, value)
    if residual:
        rows = place_in_order(rows, "key", ["t", "tie"], "place")
        rows = near_windows(rows, "key", ["t", "tie"], residual, {"before": f"avg(x) OVER (PARTITION BY key ORDER BY t, tie ROWS BETWEEN {residual} PRECEDING AND 1 PRECEDING)"})
        rows = rows.where(F.col("place") > residual).select("key", "t", "tie", (F.col("x") - F.col("before")).alias("x"))
    return scans.cusum(_standard(rows, "x", "z").where("z IS NOT NULL"), "key", ["t", "tie"], "z", 0.5, "up", "down")


@register("control_chart_cusum", f"""
WITH {_STANDARD},
u AS (SELECT event_type, greatest(cu - least(0, min(cu) OVER w), cd - least(0, min(cd) OVER w)) AS top FROM c WHERE z IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY i))
SELECT event_type, count(*) FILTER (top > 5.0) AS alarms, round(max(top), 5) AS worst FROM u GROUP BY event_type""")
def _cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided sums over all rows against 5."""
    rows = cusum_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "event_id", "value")
    top = F.greatest("up", "down")
    return rows.groupBy(F.col("key").alias("event_type")).agg(F.count_if(top > 5.0).alias("alarms"), F.round(F.max(top), 5).alias("worst"))


@register("cusum_on_model_residuals_v1", """
WITH p AS (SELECT event_type, value, row_number() OVER w AS i, avg(value) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS b
           FROM events WHERE value IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
e AS (SELECT event_type, i, value - b AS x FROM p WHERE i > 12),
s AS (SELECT event_type, quantile_cont(x, 0.5) AS med FROM e GROUP BY event_type),
m AS (SELECT event_type, 1.4826 * quantile_cont(abs(x - med), 0.5) AS sd FROM e JOIN s USING (event_type) GROUP BY event_type),
c AS (SELECT event_type, i, sum((x - med) / sd - 0.5) OVER (PARTITION BY event_type ORDER BY i) AS cu FROM e JOIN s USING (event_type) JOIN m USING (event_type) WHERE sd > 0),
u AS (SELECT event_type, cu - least(0, min(cu) OVER (PARTITION BY event_type ORDER BY i)) AS up FROM c)
SELECT event_type, round(max(up), 5) AS worst, count(*) FILTER (up > 5.0) AS alarms FROM u GROUP BY event_type""")
def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper sums over all rows of what a value is above the twelve before it."""
    rows = cusum_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "event_id", "value", 12)
    return rows.groupBy(F.col("key").alias("event_type")).agg(F.round(F.max("up"), 5).alias("worst"), F.count_if(F.col("up") > 5.0).alias("alarms"))


def ewma_chart(df: DataFrame, key: str, time: str, tie: str, value: str, lam: float = 0.2, width: float = 3.0, least: int = 30) -> DataFrame:
    """Last EWMA of each key against mean ± width · σ · sqrt(λ / (2 − λ)).

    A value's weight falls with its place from the end: beyond the last few hundred rows it is under 1e-17 of the whole. So only
    the rows after a time that a quantile sketch bounds are ordered; the first row's larger weight counts where it is among them.
    """
    from math import log

    reach = int(-40 / log(1 - lam)) + 1
    rows = df.select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("x")).where("key IS NOT NULL AND t IS NOT NULL AND x IS NOT NULL")
    us = F.unix_micros(F.col("t").cast("timestamp"))
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.percentile_approx(us, [0.0, 0.5, 0.9, 0.99, 0.999], 10000).alias("cuts"))
    spare = F.filter(F.arrays_zip(F.lit([1.0, 0.5, 0.1, 0.01, 0.001]).alias("left"), "cuts"), lambda z: F.col("n") * z["left"] >= 2 * reach + F.col("n") / 5000)
    sums = sums.withColumn("cut", F.coalesce(F.try_element_at(spare, F.lit(-1))["cuts"], F.element_at("cuts", 1)))
    last = rows.join(F.broadcast(sums), "key").where(us >= F.col("cut"))
    ranked = last.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.col("t").desc(), F.col("tie").desc()))).where(F.col("k") <= reach)
    weight = F.pow(F.lit(1 - lam), F.col("k") - 1) * F.when(F.col("k") == F.col("n"), F.lit(1.0)).otherwise(F.lit(lam))
    out = ranked.groupBy("key", "n", "mean", "sd").agg(F.sum(F.col("x") * weight).alias("ewma"))
    limit = width * F.col("sd") * (lam / (2 - lam)) ** 0.5
    status = F.when(F.col("n") >= least, F.lit("ok")).otherwise(F.lit("na"))
    return out.select("key", "n", F.round("ewma", 6).alias("ewma"), F.round(limit, 6).alias("threshold"), (F.abs(F.col("ewma") - F.col("mean")) > limit).alias("alarm"), status.alias("status"))


@register(
    "control_chart_ewma",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k,
                         count(*) OVER (PARTITION BY event_type) AS n FROM events),
       e AS (SELECT event_type AS key, n, avg(value) AS m, stddev_pop(value) AS sd,
                    sum(value * power(0.8, k - 1) * CASE WHEN k = n THEN 1 ELSE 0.2 END) AS e FROM s GROUP BY ALL)
       SELECT key, n, round(e, 6) AS ewma, round(3 * sd * sqrt(0.2 / 1.8), 6) AS threshold, abs(e - m) > 3 * sd * sqrt(0.2 / 1.8) AS alarm,
              CASE WHEN n >= 30 THEN 'ok' ELSE 'na' END AS status FROM e""",
)
def _ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ewma_chart(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "event_id", "value")
