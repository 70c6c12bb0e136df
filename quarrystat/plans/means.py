"""Exact means of groups: the same for any order of rows, so that equal means are equal numbers.

A sum of doubles differs in its last digits by the order of rows, which differs from one reading of a shuffle to the next. Here each
number is taken apart into whole numbers of 18 bits within a block of 16 binary exponents, and whole numbers add up without rounding.
A group's sums, at most some 130 rows for all exponents, meet in one row, whose mean is rounded once.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary exponents of a block, bits of a part after the point, and number of these: 54 bits, where doubles have 52 after their first.
BLOCK, BITS, PARTS = 16, 18, 3


def _mean(blocks):
    n, odd = sum(b.n for b in blocks), [b.odd for b in blocks if b.odd is not None]
    if odd or not n:
        return sum(odd) if odd else None
    return float(sum(Fraction(s) * Fraction(2) ** (BLOCK * b.block - BITS * i) for b in blocks for i, s in enumerate(b.sums)) / n)


def exact_mean(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """``df.groupBy(keys)`` with the mean ``name`` of a SQL expression. Nulls don't count; a group without numbers has a null mean;
    infinities and NaN go as in a sum. A group may have 2 ** 45 rows in a block."""
    v = F.col("_v")
    finite = F.abs(v) < float("inf")
    # a logarithm may err at a block's border, for which there are two bits to spare
    block = F.coalesce(F.floor(F.log2(F.when(finite, F.abs(v))) / BLOCK), F.lit(0).cast("long"))
    rows = df.select(*keys, F.expr(value).cast("double").alias("_v")).select(*keys, "_v", block.alias("_block"))
    # half of the power twice, as the least doubles need one that is beyond the largest
    half = F.pow(F.lit(2.0), F.col("_block") * (-BLOCK // 2))
    rows = rows.select(*keys, "_block", "_v", F.when(finite, v * half * half).alias("_x"))
    unit = float(1 << BITS)
    parts = [F.col("_x"), *[F.col("_x") * unit**i % unit for i in range(1, PARTS + 1)]]
    sums = F.array(*[F.coalesce(F.sum(p.cast("long")), F.lit(0).cast("long")) for p in parts])
    blocks = rows.groupBy(*keys, "_block").agg(F.count("_v").alias("n"), F.sum(F.when(~finite, v)).alias("odd"), sums.alias("sums"))
    held = blocks.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_block").alias("block"), "n", "odd", "sums")).alias("_blocks"))
    return held.select(*keys, F.udf(_mean, "double")("_blocks").alias(name))
