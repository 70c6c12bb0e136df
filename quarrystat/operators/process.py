"""Process mining over an event log: case = user_id, activity = event_type, time = ts, tie-break event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystat.plans.registry import register


def bigrams(log: DataFrame, case: str, activity: str, order: list[str]) -> DataFrame:
    """Counts of directly-follows pairs (a, b) within a case."""
    nxt = F.lead(activity).over(Window.partitionBy(case).orderBy(*order))
    pairs = log.select(F.col(activity).alias("a"), nxt.alias("b")).where("b IS NOT NULL")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


@register(
    "sequence_bigrams",
    """SELECT a, b, count(*) AS n FROM (
         SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
       WHERE b IS NOT NULL GROUP BY a, b""",
)
def _sequence_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigrams(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", ["ts", "event_id"])
