"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one pre-aggregated minimum by node and one join on the node; every round is written to the shared folder.
Nodes with very many neighbours only add rows to an aggregation and to a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    rows = near.join(low, "u")
    if large:
        out = rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of ``edges`` (u, v longs): component is the smallest node reachable.

    Null ends and loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    while True:
        after = materialize(_star(_star(now, True), False), "edges")
        changed = after.exceptAll(now).limit(1).count() or now.exceptAll(after).limit(1).count()
        now = after
        if not changed:
            break
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )
