"""Readers and normalisation run on written copies of the test tables, and the last scores, as functions with SQL apart."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.functions.guard import NotAllowed, guarded_sql
from quarrystat.operators.sequences import role_scores, sql_pack
from quarrystat.plans.halves import early_half
from quarrystat.plans.registry import register
from quarrystat.plans.scratch import scratch_dir
from quarrystat.sources.readers import normalise, read_any


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark, tag: str) -> str:
    return f"{scratch_dir(spark)}/quarrystat/{tag}-{uuid.uuid4().hex}"


@register("ingest_tabular", "SELECT n_nationkey::INT AS n_nationkey, n_name, n_regionkey::INT AS n_regionkey FROM nation")
def _tabular(spark, sf_dir):
    """The nations through a CSV file and back, types inferred."""
    path = _path(spark, "csv")
    _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.options(header=True).csv(path)
    return read_any(spark, path, "csv")


@register("ingest_sql_dump_v1", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name AS r_name FROM region")
def _dump(spark, sf_dir):
    """The regions through a dump of one CREATE TABLE and one INSERT a row."""
    path = _path(spark, "dump")
    quoted = F.replace("r_name", F.lit("'"), F.lit("''"))
    rows = _read(spark, sf_dir, "region").select(F.format_string("INSERT INTO region VALUES (%s,'%s');", F.col("r_regionkey").cast("string"), quoted).alias("value"))
    spark.createDataFrame([("CREATE TABLE region (r_regionkey INT, r_name TEXT);",)], "value string").unionByName(rows).coalesce(1).write.text(path)
    return read_any(spark, path, "sql")


@register("transform_normalize_mixed", """
SELECT c_custkey, nullif(lower(regexp_replace(trim('  ' || c_name || ' X'), '\\s+', ' ', 'g')), '') AS name, (c_custkey % 10000)::DOUBLE AS code, lower(c_mktsegment) AS segment FROM customer""")
def _normalised(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit("  X")).alias("name"), F.format_number(F.col("c_custkey") % 10000, 0).alias("code"), F.upper("c_mktsegment").alias("segment"))
    return normalise(rows)


@register("llm_text2sql_local_generate_v1")
def _generated(spark, sf_dir):
    """Without a local model the generator's fallback: the deterministic pack of the table, each statement checked by the guard and
    by planning it."""
    _read(spark, sf_dir, "events").createOrReplaceTempView("quarrystat_events")
    pack = sql_pack(role_scores(spark.table("quarrystat_events")).select("column", "dtype"), "quarrystat_events").collect()
    rows = []
    for r in pack:
        try:
            guarded_sql(spark, r["sql"])._jdf.queryExecution().optimizedPlan()
            rows.append((r["intent"], r["sql"], "fallback", True))
        except NotAllowed:
            rows.append((r["intent"], r["sql"], "fallback", False))
    return spark.createDataFrame(rows, "intent string, sql string, source string, valid boolean")


def embedding_drift(df: DataFrame, case: list[str], time: str, tie: str, activity: str, dimensions: int = 2) -> DataFrame:
    """How far each activity moves between spectral embeddings of the early and the late half's transitions. Activities squared
    bound what one task sees; signs and rotations are taken out by the best orthogonal fit."""
    rows = early_half(df, [time, tie])
    own = Window.partitionBy(*case, "early").orderBy(time, tie)
    moves = rows.select("early", F.col(activity).cast("string").alias("u"), F.lead(F.col(activity).cast("string")).over(own).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    counts = moves.groupBy("early", "u", "v").agg(F.count("*").alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["u"], *pdf["v"]})
        at, d = {x: i for i, x in enumerate(names)}, min(dimensions, max(1, len(names) - 1))
        place = []
        for side in (1, 0):
            a = np.zeros((len(names), len(names)))
            for u, v, n in pdf.loc[pdf["early"] == side, ["u", "v", "n"]].itertuples(index=False):
                a[at[u], at[v]] += n
                a[at[v], at[u]] += n
            s = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
            w, e = np.linalg.eigh(s[:, None] * a * s[None, :])
            order = np.argsort(-np.abs(w), kind="stable")[:d]
            place.append(e[:, order] * np.sqrt(np.abs(w[order])))
        u, _, t = np.linalg.svd(place[1].T @ place[0])
        gap = np.linalg.norm(place[1] @ u @ t - place[0], axis=1)
        return pd.DataFrame({"node": names, "displacement": np.round(gap, 9)})

    return counts.groupBy(F.lit(1).alias("_one")).applyInPandas(one, "node string, displacement double")


@register("node2vec_graph_embedding_drift_v1")
def _drift(spark, sf_dir):
    return embedding_drift(_read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type")


def rasch(df: DataFrame, step: str, host: str, value: str, rounds: int = 3) -> DataFrame:
    """Steps' and hosts' shares of the variance of log values: in turn the mean residual of each step given its hosts and of each
    host given its steps. Rows become cells of step and host once; each round joins small tables of effects."""
    x = F.log1p(F.col(value).cast("double"))
    cells = df.where((F.col(value) >= 0) & F.col(step).isNotNull() & F.col(host).isNotNull()).groupBy(F.col(step).alias("s"), F.col(host).alias("h")).agg(F.count("*").alias("n"), F.sum(x).alias("x"))
    steps, hosts = cells.groupBy("s").agg(F.lit(0.0).alias("a")), cells.groupBy("h").agg((F.sum("x") / F.sum("n") * 0).alias("b"))
    total = cells.agg((F.sum("x") / F.sum("n")).alias("m"))
    rows = cells.crossJoin(F.broadcast(total)).select("s", "h", "n", (F.col("x") - F.col("n") * F.col("m")).alias("r"))
    for _ in range(rounds):
        steps = rows.join(hosts, "h").groupBy("s").agg((F.sum(F.col("r") - F.col("n") * F.col("b")) / F.sum("n")).alias("a"))
        hosts = rows.join(steps, "s").groupBy("h").agg((F.sum(F.col("r") - F.col("n") * F.col("a")) / F.sum("n")).alias("b"))
    v = lambda t, c, name: t.agg(F.count("*").alias(f"{name}s"), F.round(F.var_pop(c), 9).alias(f"{name}_var"))
    return v(steps, "a", "step").crossJoin(v(hosts, "b", "host"))


@register("rasch_step_host_scale_v1", """
WITH r AS (SELECT event_type AS s, user_id AS h, ln(1 + value) - (SELECT avg(ln(1 + value)) FROM events) AS r FROM events),
a1 AS (SELECT s, avg(r) AS a FROM r GROUP BY s), b1 AS (SELECT h, avg(r - a) AS b FROM r JOIN a1 USING (s) GROUP BY h),
a2 AS (SELECT s, avg(r - b) AS a FROM r JOIN b1 USING (h) GROUP BY s), b2 AS (SELECT h, avg(r - a) AS b FROM r JOIN a2 USING (s) GROUP BY h),
a3 AS (SELECT s, avg(r - b) AS a FROM r JOIN b2 USING (h) GROUP BY s), b3 AS (SELECT h, avg(r - a) AS b FROM r JOIN a3 USING (s) GROUP BY h)
SELECT (SELECT count(*) FROM a3) AS steps, (SELECT round(var_pop(a), 9) FROM a3) AS step_var, (SELECT count(*) FROM b3) AS hosts, (SELECT round(var_pop(b), 9) FROM b3) AS host_var""")
def _rasch(spark, sf_dir):
    return rasch(_read(spark, sf_dir, "events"), "event_type", "user_id", "value")


def truthfulness(df: DataFrame, priority: str, value: str) -> DataFrame:
    """Spearman's correlation of two columns of few distinct values, and the share of rows that rank higher by priority than by
    value; ranks come from counts of the distinct values."""
    cells = df.where(F.col(priority).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(priority).alias("p"), F.col(value).alias("v")).agg(F.count("*").alias("n"))

    def rank(c: str) -> DataFrame:
        upto = F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        return cells.groupBy(c).agg(F.sum("n").alias("n")).select(c, (upto - (F.col("n") - 1) / 2).alias(f"r{c}"))

    both = cells.join(rank("p"), "p").join(rank("v"), "v")
    s = lambda e: F.sum(F.col("n") * e)
    x, y = F.col("rp"), F.col("rv")
    told = both.agg(F.sum("n").alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"), s((x > y).cast("double")).alias("over"))
    n = F.col("n")
    cov, vx, vy = (F.col(a) / n - F.col(b) / n * F.col(c) / n for a, b, c in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    return told.select("n", F.round(cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0)), 6).alias("rank_correlation"), F.round(F.col("over") / n, 9).alias("overbid_fraction"))


@register("vickrey_priority_truth_v1", """
WITH r AS (SELECT rank() OVER (ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_orderpriority) - 1) / 2 AS x, rank() OVER (ORDER BY floor(o_totalprice / 5000)) + (count(*) OVER (PARTITION BY floor(o_totalprice / 5000)) - 1) / 2 AS y FROM orders)
SELECT count(*) AS n, round(corr(x, y), 6) AS rank_correlation, round(avg((x > y)::INT), 9) AS overbid_fraction FROM r""")
def _vickrey(spark, sf_dir):
    return truthfulness(_read(spark, sf_dir, "orders").withColumn("v", F.floor(F.col("o_totalprice") / 5000)), "o_orderpriority", "v")


def transfers(df: DataFrame, entity: str, value: str, least: int = 30) -> DataFrame:
    """For each entity the one whose mean, spread and 90th percentile are nearest of those with a lower mean: whose settings it
    could take over, and what that would save a row. Entities of one column, compared after rows became one line each."""
    kpi = df.where(F.col(value).isNotNull()).groupBy(F.col(entity).cast("string").alias("entity")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.percentile(value, 0.9).alias("q"))
    kpi = kpi.where(F.col("n") >= least)
    other = kpi.select(F.col("entity").alias("source"), F.col("m").alias("m2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    scale = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.greatest(F.abs(a), F.lit(1e-12))
    pairs = kpi.join(other, F.col("m2") < F.col("m")).withColumn("d", F.round(scale("m", "m2") + scale("s", "s2") + scale("q", "q2"), 9))
    best = F.min(F.struct("d", "source", F.round(F.col("m") - F.col("m2"), 6).alias("saving")))
    return pairs.groupBy("entity").agg(best.alias("b")).select("entity", "b.source", F.col("b.d").alias("distance"), "b.saving")


@register("cross_entity_transfer_v1", """
WITH k AS (SELECT event_type AS entity, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.9) AS q FROM events GROUP BY 1 HAVING count(*) >= 30),
p AS (SELECT a.entity, b.entity AS source, round(abs(a.m - b.m) / abs(a.m) + abs(a.s - b.s) / abs(a.s) + abs(a.q - b.q) / abs(a.q), 9) AS distance, round(a.m - b.m, 6) AS saving FROM k a JOIN k b ON b.m < a.m)
SELECT entity, source, distance, saving FROM p QUALIFY row_number() OVER (PARTITION BY entity ORDER BY distance, source) = 1""")
def _transfer(spark, sf_dir):
    return transfers(_read(spark, sf_dir, "events"), "event_type", "value")
