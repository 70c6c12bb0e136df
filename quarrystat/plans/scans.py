"""Recursions along a key's rows as scans with an associative operator, without one task a key.

A row is a function from state to state (x -> a x + b for averages and filters, x -> max(f, x + c) for cumulative sums), and such
functions compose without knowing the state. Rows are cut into blocks by their place; each block is composed into one function,
blocks of blocks likewise, as many levels as the longest key needs; states are then carried down again, and the rows of a block
run from the block's own start. No group holds more than ``block`` entries on any level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.plans.chunked import place_in_order
from quarrystat.plans.scratch import materialize


@dataclass(frozen=True)
class Scan:
    """``start``: state before the first row. ``unit``: function that changes nothing. ``compose(a, b)``: first a, then b.
    ``apply(state, f)``: the state after f. Functions and states are structs, whose fields keep their types."""

    start: Column
    unit: Column
    compose: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]


def double(x: float) -> Column:
    return F.lit(float(x))


def affine() -> Scan:
    """State x; functions (a, b): x -> a x + b."""
    return Scan(
        F.struct(double(0).alias("x")),
        F.struct(double(1).alias("a"), double(0).alias("b")),
        lambda f, g: F.struct((f["a"] * g["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b")),
        lambda s, f: F.struct((f["a"] * s["x"] + f["b"]).alias("x")),
    )


def max_plus(*names: str) -> Scan:
    """States ``names``; for each a function (c, f): x -> max(f, x + c), fields c_name and f_name."""
    pair = lambda f, g, n: [(f[f"c_{n}"] + g[f"c_{n}"]).alias(f"c_{n}"), F.greatest(g[f"f_{n}"], f[f"f_{n}"] + g[f"c_{n}"]).alias(f"f_{n}")]
    return Scan(
        F.struct(*[double(0).alias(n) for n in names]),
        F.struct(*[c for n in names for c in (double(0).alias(f"c_{n}"), double(float("-inf")).alias(f"f_{n}"))]),
        lambda f, g: F.struct(*[c for n in names for c in pair(f, g, n)]),
        lambda s, f: F.struct(*[F.greatest(f[f"f_{n}"], s[n] + f[f"c_{n}"]).alias(n) for n in names]),
    )


def moebius() -> Scan:
    """State v; functions (p, q, r, s): v -> (p v + q) / (r v + s), scaled by their largest entry."""

    def compose(f: Column, g: Column) -> Column:
        made = {"p": g["p"] * f["p"] + g["q"] * f["r"], "q": g["p"] * f["q"] + g["q"] * f["s"], "r": g["r"] * f["p"] + g["s"] * f["r"], "s": g["r"] * f["q"] + g["s"] * f["s"]}
        top = F.greatest(*[F.abs(c) for c in made.values()])
        return F.struct(*[(c / top).alias(n) for n, c in made.items()])

    return Scan(
        F.struct(double(1).alias("v")),
        F.struct(*[double(x).alias(n) for n, x in zip("pqrs", (1, 0, 0, 1))]),
        compose,
        lambda s, f: F.struct(((f["p"] * s["v"] + f["q"]) / (f["r"] * s["v"] + f["s"])).alias("v")),
    )


def lowest(*names: str) -> Scan:
    """State ``names``, the fields of the row whose first one is lowest so far; functions are such rows."""
    take = lambda f, g: F.when(g[names[0]] < f[names[0]], g).otherwise(f)
    none = F.struct(*[double(float("inf")).alias(n) for n in names])
    return Scan(none, none, take, take)


def together(**parts: Scan) -> Scan:
    """Several scans at once; states and functions are structs of theirs."""
    each = lambda pick: F.struct(*[pick(n, s).alias(n) for n, s in parts.items()])
    return Scan(
        each(lambda _, s: s.start), each(lambda _, s: s.unit), lambda f, g: each(lambda n, s: s.compose(f[n], g[n])), lambda x, f: each(lambda n, s: s.apply(x[n], f[n]))
    )


def _run(entries: Column, start: Column, scan: Scan, after: bool) -> Column:
    """Array of entries with ``state``: the state before each, or after it."""
    zero = F.struct(start.alias("s"), F.transform(F.slice(entries, 1, 0), lambda e: F.struct(e.alias("row"), start.alias("state"))).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        new = scan.apply(acc["s"], e["f"])
        return F.struct(new.alias("s"), F.concat(acc["out"], F.array(F.struct(e.alias("row"), (new if after else acc["s"]).alias("state")))).alias("out"))

    return F.aggregate(entries, zero, step, lambda acc: acc["out"])


def _carried(blocks: DataFrame, scan: Scan, size: int, levels: int) -> DataFrame:
    """State before each block of (_key, _i, f): rows (_key, _i, state)."""
    entry = F.struct(F.col("_i").alias("i"), F.col("f").alias("f"))
    groups = blocks.groupBy("_key", F.floor(F.col("_i") / size).alias("_up")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    if levels <= 1:
        started = groups.withColumn("start", scan.start)
    else:
        whole = F.aggregate("entries", scan.unit, lambda acc, e: scan.compose(acc, e["f"]))
        above = _carried(groups.select("_key", F.col("_up").alias("_i"), whole.alias("f")), scan, size, levels - 1)
        above = above.select(F.col("_key").alias("_k"), F.col("_i").alias("_j"), F.col("state").alias("start"))
        started = groups.join(above, groups["_key"].eqNullSafe(above["_k"]) & (groups["_up"] == above["_j"])).select("_key", "_up", "entries", "start")
    out = started.select("_key", F.explode(_run(F.col("entries"), F.col("start"), scan, False)).alias("e"))
    return out.select("_key", F.col("e.row.i").alias("_i"), F.col("e.state").alias("state"))


def scan_rows(df: DataFrame, key: str, order: list[str], element: Callable[[Column], Column], scan: Scan, name: str, block: int = 256, place: str | None = None) -> DataFrame:
    """``df`` with a struct ``name``: the state after each row, along ``key`` in the order of ``order`` (a time, then ties).

    ``element(place)`` gives a row's function from its columns and its place from 1 on; null functions change nothing. ``place``:
    the column that holds the places already.
    """
    placed = df.withColumn("_p", F.col(place)) if place else place_in_order(df, key, order, "_p")
    f = F.coalesce(element(F.col("_p")), scan.unit)
    entry = F.struct(F.col("_p").alias("i"), f.alias("f"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"))
    blocks = placed.groupBy(F.col(key).alias("_key"), F.floor((F.col("_p") - 1) / block).alias("_i")).agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["i"] - b["i"]).cast("int")).alias("entries"))
    blocks = materialize(blocks, "blocks")
    longest = blocks.agg(F.max("_i")).first()[0] or 0
    levels = 1
    while block**levels <= longest:
        levels += 1
    whole = F.aggregate("entries", scan.unit, lambda acc, e: scan.compose(acc, e["f"]))
    starts = _carried(blocks.select("_key", "_i", whole.alias("f")), scan, block, levels)
    starts = starts.select(F.col("_key").alias("_k"), F.col("_i").alias("_j"), F.col("state").alias("start"))
    both = blocks.join(starts, blocks["_key"].eqNullSafe(starts["_k"]) & (blocks["_i"] == starts["_j"]))
    out = both.select(F.explode(_run(F.col("entries"), F.col("start"), scan, True)).alias("e"))
    return out.select("e.row.own.*", F.col("e.state").alias(name))


def ewma(df: DataFrame, key: str, order: list[str], value: str, alpha: float, name: str, block: int = 256) -> DataFrame:
    """Exponentially weighted average after each row, which starts at the first row's value."""
    v = F.col(value).cast("double")
    f = lambda place: F.when(v.isNotNull(), F.struct(F.when(place == 1, 0.0).otherwise(1 - alpha).alias("a"), F.when(place == 1, v).otherwise(alpha * v).alias("b")))
    out = scan_rows(df, key, order, f, affine(), "_state", block)
    return out.withColumn(name, F.col("_state.x")).drop("_state")


def cusum(df: DataFrame, key: str, order: list[str], value: str, slack: float, up: str, down: str, block: int = 256) -> DataFrame:
    """Upper and lower cumulative sums of a standardised value after each row, which never fall below zero."""
    v = F.col(value).cast("double")
    move = lambda c, n: [c.alias(f"c_{n}"), double(0).alias(f"f_{n}")]
    f = lambda _: F.when(v.isNotNull(), F.struct(*move(v - slack, "up"), *move(-v - slack, "down")))
    out = scan_rows(df, key, order, f, max_plus("up", "down"), "_state", block)
    return out.withColumn(up, F.col("_state.up")).withColumn(down, F.col("_state.down")).drop("_state")


def kalman(df: DataFrame, key: str, order: list[str], value: str, noise: str, drift: str, name: str, block: int = 256) -> DataFrame:
    """Local-level filter after each row: ``name`` is the level, ``name``_gain its gain. ``noise`` and ``drift`` are columns, the
    variances of an observation and of a step. The level starts at the first value with variance 1.

    The variance does not depend on the values: v -> (v + d) n / (v + d + n), a fraction of linear terms; with its gains the
    level is an affine recursion. A null value is a step without an observation.
    """
    v, n, d = (F.col(c).cast("double") for c in (value, noise, drift))
    with_value = F.struct(n.alias("p"), (n * d).alias("q"), double(1).alias("r"), (d + n).alias("s"))
    without = F.struct(double(1).alias("p"), d.alias("q"), double(0).alias("r"), double(1).alias("s"))
    out = scan_rows(df, key, order, lambda _: F.when(v.isNotNull(), with_value).otherwise(without), moebius(), "_var", block)
    # the gain is the variance after the row over the noise
    out = out.withColumn(f"{name}_gain", F.when(v.isNotNull(), F.col("_var.v") / n).otherwise(double(0))).drop("_var")
    g = F.col(f"{name}_gain")
    f = lambda place: F.when(v.isNotNull(), F.when(place == 1, F.struct(double(0).alias("a"), v.alias("b"))).otherwise(F.struct((1 - g).alias("a"), (g * v).alias("b"))))
    out = scan_rows(out, key, order, f, affine(), "_level", block)
    return out.withColumn(name, F.col("_level.x")).drop("_level")
