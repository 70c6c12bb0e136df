"""Early and late half of a table in time order, without sorting it: the reference's split at row int(n / 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(counts: DataFrame, level: str) -> DataFrame:
    """The bucket that holds row ``target`` of a small table of counts (level, n, base, target), with the rows before it."""
    upto = F.sum("n").over(Window.orderBy(level).rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
    return counts.withColumn("upto", upto).where("upto - n < target AND target <= upto").select(F.col(level).alias(f"_{level}"), (F.col("upto") - F.col("n")).alias("base"), "target")


def early_half(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with a column early: 1 for the first int(n / 2) rows by ``order`` (a timestamp or microseconds, then ties), else 0.

    Rows are counted by hour, those of the one hour in which the middle lies by second, and only the rows of that second are
    ordered; all three results are single rows that are broadcast. Rows without a time don't count and are late. Rows that
    equal the middle one in all of ``order`` are early together.
    """
    time = order[0]
    us = F.unix_micros(time) if dict(df.dtypes)[time] == "timestamp" else F.unix_micros(F.col(time).cast("timestamp")) if dict(df.dtypes)[time] in ("date", "timestamp_ntz") else F.col(time).cast("long")
    rows = df.select(us.alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(order[1:])]).where("_t IS NOT NULL")
    keys = ["_t", *[f"_k{i}" for i in range(len(order) - 1)]]
    hour, second = F.floor(F.col("_t") / 3_600_000_000), F.floor(F.col("_t") / 1_000_000)
    hours = rows.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    half = hours.agg(F.floor(F.sum("n") / 2).alias("target"))
    at = _pick(hours.crossJoin(F.broadcast(half)).withColumn("base", F.lit(0)), "hour")
    inside = rows.join(F.broadcast(at), hour == F.col("_hour"))
    at = _pick(inside.groupBy(second.alias("second"), "base", "target").agg(F.count("*").alias("n")), "second")
    place = F.row_number().over(Window.orderBy(*keys)) + F.col("base")
    middle = rows.join(F.broadcast(at), second == F.col("_second")).withColumn("_place", place).where("_place = target").select(F.struct(*keys).alias("_middle"))
    own = F.struct(us.alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(order[1:])])
    flag: Column = F.when(us.isNotNull() & (own <= F.col("_middle")), F.lit(1)).otherwise(F.lit(0))
    return df.join(F.broadcast(middle), F.lit(True), "left").withColumn("early", flag).drop("_middle")


def exact_median(df: DataFrame, time: str, name: str) -> DataFrame:
    """One row: the exact median of a column of microseconds, the mean of the two middle values where their number is even.

    Found like the middle of ``early_half``: by counts of hours, then of seconds, then among the rows of one or two seconds."""
    rows = df.select(F.col(time).cast("long").alias("_t")).where("_t IS NOT NULL")

    def pick(counts: DataFrame, level: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("target").orderBy(level).rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
        found = counts.withColumn("upto", upto).where("upto - n < target AND target <= upto")
        return found.select(F.col(level).alias(f"_{level}"), (F.col("upto") - F.col("n")).alias("base"), "target")

    hour, second = F.floor(F.col("_t") / 3_600_000_000), F.floor(F.col("_t") / 1_000_000)
    hours = rows.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    n = hours.agg(F.sum("n").alias("all"))
    both = n.select(F.explode(F.array_distinct(F.array(F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1))).alias("target"))
    at = pick(hours.crossJoin(F.broadcast(both)).withColumn("base", F.lit(0)), "hour")
    inside = rows.join(F.broadcast(at), hour == F.col("_hour")).groupBy(second.alias("second"), "base", "target").agg(F.count("*").alias("n"))
    at = pick(inside, "second")
    near = rows.join(F.broadcast(at), second == F.col("_second"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("_t")) + F.col("base")
    return near.withColumn("_place", place).where("_place = target").agg(F.avg("_t").alias(name))
