"""Exact quantiles of groups by selection: histograms narrow each rank's range of values, no buffer holds a group's values.

All groups and quantiles go together. A pass counts the rows of each range in ``bins`` equal parts, keeps the part that holds the
rank and goes on between that part's own lowest and highest value. Once a range has at most ``most`` rows, or one value, its
distinct values are counted and the rank is read off. Values that spread evenly need one or two passes for any number of rows;
each outlier scale takes one more.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.plans.scratch import materialize

#: The largest number; beyond it are the infinities and NaN, parts of their own.
LARGEST = 1.7976931348623157e308


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], most: int = 100_000, bins: int = 4096) -> DataFrame:
    """One row for each group of ``keys`` with the linearly interpolated quantiles ``wanted``, name -> (SQL expression, p).

    Nulls don't count; a group without values has null quantiles; groups of a null key are groups; NaN is the largest value.
    """
    exprs = sorted({e for e, _ in wanted.values()})
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.expr(e).cast("double").alias("v")) for i, e in enumerate(exprs)])).alias("x")
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = materialize(df.select(key.alias("k"), values).select("k", "x.c", "x.v"), "values")
    some = rows.where("v IS NOT NULL")
    sizes = some.groupBy("k", "c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    told = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(exprs.index(e)).alias("c"), F.lit(float(p)).alias("p")) for name, (e, p) in wanted.items()])).alias("w")
    asked = sizes.select("*", told).where("c = w.c").select("k", "c", "n", "lo", "hi", "w.name", (F.col("w.p") * (F.col("n") - 1)).alias("at"))
    rank = F.explode(F.array_distinct(F.array(F.floor("at") + 1, F.ceil("at") + 1))).alias("rank")
    asked = materialize(asked, "asked")
    open_ = asked.select("k", "c", "lo", "hi", F.col("n").alias("left"), rank).distinct().withColumn("base", F.lit(0).cast("long"))
    open_ = materialize(open_, "ranks")
    done = None
    wide = (F.col("left") > most) & (F.col("lo") < F.col("hi"))
    on = ["k", "c"]
    while open_.where(wide).limit(1).count():
        ready = open_.where(~wide)
        done = ready if done is None else done.unionByName(ready)
        ranges = open_.where(wide).select("k", "c", "lo", "hi").distinct()
        inside = some.join(ranges, on).where("v BETWEEN lo AND hi")
        # halves first, so that wide ranges don't overflow; a part is a range of values, as rounding keeps their order
        low, high = F.greatest("lo", F.lit(-LARGEST)), F.least("hi", F.lit(LARGEST))
        width = F.greatest(high / 2 - low / 2, F.lit(5e-324))
        part = F.least(F.floor((F.col("v") / 2 - low / 2) / width * bins), F.lit(bins - 1))
        part = F.when(F.isnan("v"), F.lit(bins + 1)).when(F.col("v") > LARGEST, F.lit(bins)).when(F.col("v") < -LARGEST, F.lit(-1)).otherwise(part).cast("int")
        counts = inside.groupBy("k", "c", "lo", "hi", part.alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("m").over(Window.partitionBy("k", "c", "lo", "hi").orderBy("part"))
        counts = counts.withColumn("upto", upto)
        found = open_.where(wide).join(counts, ["k", "c", "lo", "hi"]).where("rank - base > upto - m AND rank - base <= upto")
        open_ = materialize(found.select("k", "c", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("m").alias("left"), "rank", (F.col("base") + F.col("upto") - F.col("m")).alias("base")), "ranks")
    done = open_ if done is None else done.unionByName(open_)
    ranges = done.select("k", "c", "lo", "hi").distinct()
    counts = some.join(ranges, on).where("v BETWEEN lo AND hi").groupBy("k", "c", "lo", "hi", "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("k", "c", "lo", "hi").orderBy("v"))
    read = done.join(counts.withColumn("upto", upto), ["k", "c", "lo", "hi"]).where("rank - base > upto - m AND rank - base <= upto").select("k", "c", "rank", "v")
    low = read.select("k", "c", F.col("rank").alias("r1"), F.col("v").alias("v1"))
    high = read.select("k", "c", F.col("rank").alias("r2"), F.col("v").alias("v2"))
    both = asked.withColumn("r1", F.floor("at") + 1).withColumn("r2", F.ceil("at") + 1).join(low, ["k", "c", "r1"]).join(high, ["k", "c", "r2"])
    value = F.when(F.col("v1") == F.col("v2"), F.col("v1")).otherwise((F.col("r2") - 1 - F.col("at")) * F.col("v1") + (F.col("at") - F.col("r1") + 1) * F.col("v2"))
    made = both.groupBy("k").agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in wanted])
    groups = rows.select("k").distinct()
    return groups.join(made, "k", "left").select(*[F.col(f"k.{k}").alias(k) for k in keys], *wanted)


#: Groups of more rows than WHOLE are narrowed to ten ranks in ACCURACY around each wanted one; a sketch errs by one. WHOLE must be
#: some ACCURACY or more, so that the range holds ten ranks.
WHOLE, ACCURACY = 20_000, 10_000


def with_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], plain: dict[str, str]) -> DataFrame:
    """``df.groupBy(keys)`` with aggregates ``plain`` (name -> SQL expression) and the exact quantiles ``wanted``, name -> (SQL expression, p).

    One pass takes the aggregates and a quantile sketch that bounds each rank's value from below and above; the next counts the
    values below and, one by one, those between: some thousandths of a group, or all of a small one. Nulls don't count.
    """
    value = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    exprs = sorted({e for e, _ in wanted.values()})
    slack = 10 / ACCURACY
    ends = {n: [max(0.0, p - slack), min(1.0, p + slack)] for n, (_, p) in wanted.items()}
    sketches = [F.percentile_approx(value(e), ends[n], ACCURACY).alias(f"_s_{n}") for n, (e, _) in wanted.items()]
    counts = [F.count(value(e)).alias(f"_n{i}") for i, e in enumerate(exprs)]
    base = materialize(df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in plain.items()], *counts, *sketches), "sketches")

    def bound(name: str, end: int) -> Column:
        """An end of the range, or null for all values; a little wider, as a value made anew may differ in its last digits."""
        lo, hi = (F.col(f"b._s_{name}")[i] for i in (0, 1))
        wide = (F.abs(lo) + F.abs(hi)) * 1e-12
        moved = F.nanvl(lo - wide, lo) if end == 0 else F.nanvl(hi + wide, hi)
        p = wanted[name][1]
        open_ = p <= slack if end == 0 else p >= 1 - slack
        return F.when((F.col(f"b._n{exprs.index(wanted[name][0])}") > WHOLE) & F.lit(not open_), moved)

    same = lambda a, b: functools.reduce(lambda x, y: x & y, [a(k).eqNullSafe(b(k)) for k in keys])
    held = F.struct(*[F.col(f"`{c}`") for c in base.columns if c in keys or c.startswith(("_n", "_s_"))]).alias("b")
    rows = df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[value(e).alias(f"_v{i}") for i, e in enumerate(exprs)])
    if keys:
        rows = rows.join(base.select(held), same(lambda k: F.col(f"_k_{k}"), lambda k: F.col(f"b.{k}")))
    else:
        rows = rows.crossJoin(F.broadcast(base.select(held)))
    told = []
    for i, (n, (e, _)) in enumerate(wanted.items()):
        v, lo, hi = F.col(f"_v{exprs.index(e)}"), bound(n, 0), bound(n, 1)
        below, above = F.coalesce(v < lo, F.lit(False)), F.coalesce(v > hi, F.lit(False))
        told.append(F.when(v.isNotNull() & ~above, F.struct(F.lit(i).alias("q"), F.when(~below, v).alias("v"))))
    # nulls are dropped after the array is taken apart: a filter of arrays calls a function for each row
    one = told[0] if len(told) == 1 else F.explode(F.array(*told))
    cells = rows.select(*[F.col(f"_k_{k}") for k in keys], one.alias("x")).where("x IS NOT NULL")
    cells = cells.groupBy(*[f"_k_{k}" for k in keys], F.col("x.q").alias("_q"), F.col("x.v").alias("_v")).agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*[f"_k_{k}" for k in keys], "_q").orderBy(F.col("_v").asc_nulls_first()))
    cells = cells.withColumn("_upto", upto)
    if keys:
        cells = cells.join(base.select(held), same(lambda k: F.col(f"_k_{k}"), lambda k: F.col(f"b.{k}")))
    else:
        cells = cells.crossJoin(F.broadcast(base.select(held)))
    found, made = [], []
    for i, (n, (e, p)) in enumerate(wanted.items()):
        at = F.lit(float(p)) * (F.col(f"b._n{exprs.index(e)}") - 1)
        mine = F.col("_q") == i
        reached = lambda rank: F.min(F.when(mine & (F.col("_upto") >= rank), F.struct("_upto", "_v")))  # noqa: E731, B023
        found += [reached(F.floor(at) + 1).alias(f"_a_{n}"), reached(F.ceil(at) + 1).alias(f"_b_{n}"), F.max(F.when(mine, at)).alias(f"_at_{n}")]
        a, b, place = F.col(f"_a_{n}._v"), F.col(f"_b_{n}._v"), F.col(f"_at_{n}")
        r1, r2 = F.floor(place) + 1, F.ceil(place) + 1
        missed = place.isNotNull() & (a.isNull() | b.isNull())
        between = F.when(a == b, a).otherwise((r2 - 1 - place) * a + (place - r1 + 1) * b)
        made.append(F.when(missed, F.raise_error(F.lit(f"the sketch misses the rank of {n}")).cast("double")).otherwise(between).alias(n))
    read = cells.groupBy(*[f"_k_{k}" for k in keys]).agg(*found).select(*[f"_k_{k}" for k in keys], *made)
    own = base.select(*[F.col(k).alias(k) for k in keys], *plain)
    if keys:
        return own.join(read, same(lambda k: own[k], lambda k: F.col(f"_k_{k}")), "left").drop(*[f"_k_{k}" for k in keys])
    return own.join(F.broadcast(read), F.lit(True), "left")
