"""Windows along a key's time order without one task a key: rows are cut into hours, and an hour borrows the rows next to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.plans.scratch import materialize


def _hour(df: DataFrame, time: str) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 3_600_000_000)


def _borrowed(own: DataFrame, key: str, order: list[str], reach: int, ahead: bool) -> DataFrame:
    """For each (key, _c) the ``reach`` rows before it (after it if ``ahead``), as rows of that _c.

    Each hour's ``reach`` rows nearest its end are numbered along the key; the rows before an hour are the numbers just below
    its own. What is numbered is at most ``reach`` rows an hour and key."""
    far = [F.col(c).asc() if ahead else F.col(c).desc() for c in order]
    ends = own.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_c").orderBy(*far))).where(F.col("_r") <= reach).drop("_r")
    ends = ends.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    places = ends.groupBy(key, "_c").agg(F.min("_at").alias("low"), F.max("_at").alias("high"))
    span = F.sequence(F.col("high") + 1, F.col("high") + reach) if ahead else F.sequence(F.col("low") - reach, F.col("low") - 1)
    wanted = places.select(key, F.col("_c").alias("_to"), F.explode(span).alias("_at")).where("_at >= 1")
    return ends.join(wanted, [key, "_at"]).withColumn("_c", F.col("_to")).drop("_at", "_to")


def near_windows(df: DataFrame, key: str, order: list[str], reach: int, columns: dict[str, str]) -> DataFrame:
    """``df`` with window columns that look at most ``reach`` rows back or ahead: SQL expressions over
    ``PARTITION BY key ORDER BY order``. Rows without a key or time get nulls' windows of their own."""
    own = df.withColumn("_c", _hour(df, order[0]))
    whole = own.withColumn("_own", F.lit(True))
    for ahead in (False, True):
        whole = whole.unionByName(_borrowed(own, key, order, reach, ahead).withColumn("_own", F.lit(False)).select(*whole.columns))
    part = f"PARTITION BY {key} ORDER BY"
    made = whole.selectExpr("*", *[f"{e.replace(part, f'PARTITION BY {key}, _c ORDER BY')} AS {n}" for n, e in columns.items()])
    return made.where("_own").drop("_c", "_own")


def place_in_order(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place from 1 along its key: the rows of earlier hours, from one count an hour, and its place in its own."""
    own = df.withColumn("_c", _hour(df, order[0]))
    counts = own.groupBy(key, "_c").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = own.withColumn(name, F.row_number().over(Window.partitionBy(key, "_c").orderBy(*order)))
    offsets = counts.select(F.col(key).alias("_k"), F.col("_c").alias("_d"), before.alias("_b"))
    both = placed.join(offsets, placed[key].eqNullSafe(offsets["_k"]) & placed["_c"].eqNullSafe(offsets["_d"]))
    return both.withColumn(name, (F.col(name) + F.col("_b")).cast("long")).drop("_c", "_k", "_d", "_b")


#: Rows of one part of a table that is sorted as a whole.
PART = 500_000


def tiles(df: DataFrame, key: str, columns: dict[str, tuple[int, str]]) -> DataFrame:
    """``df`` with ``ntile(n) OVER (PARTITION BY key ORDER BY order)`` for each name -> (n, order); ``order`` has no ties.

    The table is cut into sorted parts of some ``PART`` rows by key and order; a row's place is its place in its part and the
    rows of its key in earlier parts. So no task orders a key."""
    parts = df.count() // PART + 1
    for name, (n, order) in columns.items():
        by = order.split(", ")
        cut = materialize(df.repartitionByRange(parts, key, *by).withColumn("_part", F.spark_partition_id()), "parts")
        counts = cut.groupBy(key, "_part").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(F.col(key).alias("_k"), F.col("_part").alias("_q"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("_all"))
        inside = cut.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*by)))
        both = inside.join(F.broadcast(counts), inside[key].eqNullSafe(counts["_k"]) & (inside["_part"] == counts["_q"]))
        size, more, at = F.expr(f"_all DIV {n}"), F.expr(f"_all % {n}"), F.col("_i") + F.col("_before") - 1
        large = more * (size + 1)  # rows of the first tiles, which have one more
        tile = F.when(at < large, F.floor(at / (size + 1))).otherwise(more + F.floor((at - large) / F.greatest(size, F.lit(1)))) + 1
        df = both.withColumn(name, tile.cast("int")).drop("_part", "_i", "_k", "_q", "_before", "_all")
    return df


def running_sum(df: DataFrame, key: str, order: list[str], name: str, value: str) -> DataFrame:
    """``df`` with the sum of a SQL expression from the key's first row to the row itself: sums of earlier hours, and within its own."""
    own = df.withColumn("_c", _hour(df, order[0])).withColumn("_v", F.expr(value))
    sums = own.groupBy(key, "_c").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("_v").over(Window.partitionBy(key, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    offsets = sums.select(F.col(key).alias("_k"), F.col("_c").alias("_d"), before.alias("_b"))
    summed = own.withColumn(name, inside)
    both = summed.join(offsets, summed[key].eqNullSafe(offsets["_k"]) & summed["_c"].eqNullSafe(offsets["_d"]))
    total = F.coalesce(F.col(name) + F.col("_b"), F.col(name), F.col("_b"))  # null until the first value
    return both.withColumn(name, total).drop("_c", "_v", "_k", "_d", "_b")
