"""Versioned tables: only the files that a read asks for."""

import pytest
from pyspark.sql import functions as F

from quarrystat.sources.versions import Versions, matching


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = Versions(str(tmp_path_factory.mktemp("versions")), size=10)
    for v, n in (("a", 35), ("b", 12), ("c", 1)):
        out.write(spark.range(n).select((F.lit(n) - F.col("id")).alias("x"), F.concat(F.lit(v), F.col("id").cast("string")).alias("s")), v, ["x"])
    return out


def files(df):
    return sorted(f.split("/version=")[1].rsplit("/", 1)[0] for f in df.inputFiles())


def test_versions_and_ranges(spark, store):
    assert store.read(spark).groupBy("version").count().orderBy("version").collect() == [("a", 35), ("b", 12), ("c", 1)]
    got = store.read(spark, "a", 8, 21, ["x"])
    assert [(r["row_index"], r["x"]) for r in got.orderBy("row_index").collect()] == [(i, i + 1) for i in range(8, 22)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "rows" in plan.split("PartitionFilters")[1].split("\n")[0] and "s:" not in plan.split("ReadSchema")[1].split("\n")[0]
    scanned = got.select(F.input_file_name().alias("f")).distinct().collect()
    assert sorted(r["f"].split("/version=")[1].rsplit("/", 1)[0] for r in scanned) == ["a/rows=0", "a/rows=1", "a/rows=2"]
    assert store.read(spark, "a", 30).count() == 5 and store.read(spark, "none").count() == 0


def test_write_again(spark, store):
    store.write(spark.range(3).select(F.col("id").alias("x"), F.lit("q").alias("s")), "c", ["x"])
    assert store.read(spark, "c").count() == 3 and store.read(spark, "a").count() == 35
    store.write(spark.range(1).select(F.col("id").alias("x"), F.lit("q").alias("s")), "c", ["x"])
    assert store.read(spark, "c").count() == 1


def test_scope_prunes_while_it_runs(spark, store):
    scope = spark.createDataFrame([("b", "left"), ("c", "right"), ("z", "none")], "version string, side string")
    got = store.scoped(scope.where("side <> 'none'"))
    assert got.groupBy("side").count().orderBy("side").collect() == [("left", 12), ("right", 1)]
    assert "dynamicpruning" in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_matching(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "x")], "n int, s string, t string")
    ids = lambda when: [r["n"] for r in matching(df, when).orderBy("n").collect()]
    assert ids({}) == [1, 2, 3] and ids({"n": 2}) == [2] and ids({"n": "2", "s": "b"}) == [2] and ids({"n_in": [1, "3"]}) == [1, 3]
    assert ids({"s": None}) == [3] and ids({"t": ""}) == [] and ids({"missing": "x"}) == [] and ids({"missing": None}) == [1, 2, 3]
    assert ids({"s_in": [" a ", None]}) == [1, 3] and ids({"s": ["a", "b"]}) == [1, 2] and ids({"s": []}) == [] and ids({"missing_in": [""]}) == [1, 2, 3]
