"""Queries that bind the operators of ``plans.bounded`` to the test tables: the event log for series and panels, order lines
for moments, and for networks the flow of order lines through segment, priority, status, return flag and line status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.operators import covariance, network, panel, panel_models, series  # noqa: F401
from quarrystat.plans.bounded import OPERATORS, apply
from quarrystat.plans.registry import register

EVENTS = {"time": "ts", "key": "event_type", "value": "value"}
COLUMNS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber"]
STEPS = ["c_mktsegment", "o_orderpriority", "o_orderstatus", "l_returnflag", "l_linestatus"]


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (u, v, w) between the values of consecutive steps, weighted by order lines; one shuffle of a few hundred rows
    after the join, as the combinations of all steps are counted first."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = lines.groupBy(*STEPS).agg(F.count("*").alias("w"))
    name = lambda c: F.concat(F.lit(c.split("_")[1] + "="), F.col(c))
    pairs = F.explode(F.array(*[F.struct(name(a).alias("u"), name(b).alias("v")) for a, b in zip(STEPS, STEPS[1:])]))
    return counts.select(pairs.alias("e"), "w").groupBy("e.u", "e.v").agg(F.sum("w").alias("w"))


def _query(name: str, kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if kind == "network":
            return apply(name, flow_edges(spark, sf_dir), source="u", target="v", weight="w")
        if kind == "moments":
            return apply(name, spark.read.parquet(f"{sf_dir}/lineitem.parquet"), columns=COLUMNS)
        return apply(name, spark.read.parquet(f"{sf_dir}/events.parquet"), **EVENTS)

    return run


for _name, _op in OPERATORS.items():
    register(_name)(_query(_name, _op.kind))
