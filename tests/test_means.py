"""Means of groups don't hang on the order of rows."""

import random
from fractions import Fraction

import pytest

from quarrystat.plans.means import exact_mean
from quarrystat.plans.registry import queries


def test_exact_means(spark):
    r = random.Random(1)
    draws = {
        "near": lambda: round(r.gauss(0, 50), 2),
        "wide": lambda: r.choice([-1, 1]) * r.random() * 2.0 ** r.randint(-1074, 1000),
        "borders": lambda: r.choice([-1, 1]) * 2.0 ** (16 * r.randint(-60, 60)) * r.choice([1.0, 1 - 2**-53, 1 + 2**-52, 2 - 2**-52]),
        "least": lambda: 5e-324 * r.randint(-9, 9),
        "most": lambda: r.choice([1.7976931348623157e308, 1e308]),
        None: lambda: float(r.randint(-3, 3)),
    }
    rows = [(k, None if r.random() < 0.05 else draw()) for k, draw in draws.items() for _ in range(500)]
    odd = [("none", None), ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("inf", 3.0), ("inf", None), ("both", float("inf")), ("both", -float("inf")), ("both", 1.0)]
    df = spark.createDataFrame(rows + odd, "k string, v double").repartition(5)
    got = {x.k: x.m for x in exact_mean(df, ["k"], "m", "v").collect()}
    assert set(got) == {*draws, "none", "nan", "inf", "both"}
    for k in draws:
        own = [Fraction(v) for x, v in rows if x == k and v is not None]
        assert got[k] == float(sum(own) / len(own)), k
    assert got["none"] is None and got["inf"] == float("inf") and got["nan"] != got["nan"] and got["both"] != got["both"]
    assert exact_mean(df.where("false"), ["k"], "m", "v").collect() == []


def test_groups_of_equal_means_win_nothing(spark, tmp_path):
    """The means of a and b, equal numbers in another order, once differed in their last digits, and a won over b or b over a."""
    r = random.Random(2)
    values = [round(r.expovariate(0.02), 2) for _ in range(4000)]
    rows = [("a", v) for v in values] + [("b", v) for v in sorted(values)] + [("c", v) for v in sorted(values, reverse=True)] + [("low", -1.0), ("none", None)]
    df = spark.createDataFrame(rows, "event_type string, value double").selectExpr("*", "TIMESTAMP_NTZ'2024-01-01' AS ts")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(x) for x in queries()["condorcet_host_ranking_v1"](spark, str(tmp_path)).collect()]
    assert got == [("low", 3)]


@pytest.mark.parametrize("parts", [1, 7])
def test_no_group_wins_over_itself(spark, tmp_path, parts):
    """Both sides of the comparison once added up doubles in their own order of partial sums."""
    df = spark.range(20_000).selectExpr("concat('t', id % 5) AS event_type", "round(rand(3) * 100, 2) + id % 5 AS value", "TIMESTAMP_NTZ'2024-01-01' AS ts")
    df.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    plan = queries()["condorcet_host_ranking_v1"](spark, str(tmp_path))
    assert sorted(map(tuple, plan.collect())) == [(f"t{i}", 4 - i) for i in range(4)]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "avg(" not in text and "sum(value" not in text
