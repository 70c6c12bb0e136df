"""What a round of an iterative operator writes and takes again."""

import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from quarrystat.operators import graph, models
from tests.test_cores import peel

PATH = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 22), (20, 22), (22, 23), (5, 5)]


def watch(monkeypatch, module):
    seen, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, tag: seen.append((tag, out := write(df, tag))) or out)
    return seen


def test_k_core_rounds_write_nodes(spark, monkeypatch):
    """A round once wrote all edges that were left."""
    seen = watch(monkeypatch, graph)
    got = {r.node for r in graph.k_core(spark.createDataFrame(PATH, "src long, dst long"), 2).collect()}
    assert got == {20, 21, 22}
    assert len([1 for tag, df in seen if tag == "core" and df.columns == ["node", "d"]]) > 6


@pytest.mark.parametrize("few", [0, 200_000])
def test_only_weak_nodes_get_new_bounds(spark, monkeypatch, few):
    """A round once took the bounds of all nodes from all edges."""
    monkeypatch.setattr(graph, "FEW", few)
    seen = watch(monkeypatch, graph)
    edges = [e for e in PATH if e[0] != e[1]]
    got = {r.node: r.core for r in graph.core_numbers(spark.createDataFrame(PATH, "src long, dst long")).collect()}
    assert got == peel(edges)
    taken = [df.where("taken").count() for tag, df in seen if tag == "moved"]
    assert taken[0] == len(got) and max(taken[1:]) <= 3


def test_boosting_on_cells_is_boosting_on_rows(spark, sf, monkeypatch):
    """Trees once held every row; distinct feature values with weights give the same ones."""
    seen = watch(monkeypatch, models)
    got = {r.feature: r.importance for r in models._boosting(spark, sf).collect()}
    want = GBTRegressor(maxIter=8, maxDepth=3, seed=1).fit(models.numbers(spark, sf)).featureImportances.toArray()
    assert [got[f] for f in models.FEATURES] == pytest.approx(list(want), rel=1e-6)
    cells = dict(seen)["cells"]
    assert cells.count() == spark.read.parquet(f"{sf}/lineitem.parquet").select(*models.FEATURES).distinct().count()


def test_topics_count_words_once(spark, sf, monkeypatch):
    """Each iteration once split the texts anew."""
    seen = watch(monkeypatch, models)
    assert models._topics(spark, sf).count() == 5
    assert dict(seen)["counts"].count() == spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").count()


def test_double_residuals_of_cells_are_those_of_rows(spark, sf, monkeypatch):
    """Forests once held every row; trees on distinct feature values and their sums give the same effect."""
    monkeypatch.setattr(models, "_poisson", lambda key: F.lit(1))
    monkeypatch.setattr(models, "TREES", 3)
    seen = watch(monkeypatch, models)
    got = models._double(spark, sf).first()
    cells = dict(seen)["cells"]
    rows = models.numbers(spark, sf).withColumn("treat", (F.col("l_returnflag") == "R").cast("double"))
    assert cells.count() == 4 * rows.select(*models.FEATURES, F.col("part") % 2).distinct().count()
    parts = []
    for fold in (0, 1):
        part = rows.where(f"part % 2 = {fold}")
        for c in ("label", "treat"):
            for i in range(3):
                one = RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", maxDepth=4, seed=i, labelCol=c, predictionCol=f"{c}{i}")
                part = one.fit(rows.where(f"part % 2 <> {fold}")).transform(part)
        parts.append(part.selectExpr("label - (label0 + label1 + label2) / 3 AS y", "treat - (treat0 + treat1 + treat2) / 3 AS t"))
    want = parts[0].unionByName(parts[1]).selectExpr("sum(t * y) / sum(t * t) AS ate", "count(*) AS n").first()
    assert got.ate == pytest.approx(want.ate, rel=1e-6) and got.n == want.n == rows.count()


def test_bootstrap_draws(spark):
    """Rows are taken as often as Poisson says, for each tree anew."""
    w = spark.range(20000).select(*[models._poisson(F.xxhash64(F.lit(i), "id")).alias(f"w{i}") for i in (0, 1)])
    got = w.selectExpr("avg(w0) a", "var_pop(w0) v", "avg(CAST(w0 = 0 AS INT)) z", "corr(w0, w1) c").first()
    assert got.a == pytest.approx(1, abs=0.03) and got.v == pytest.approx(1, abs=0.05) and got.z == pytest.approx(0.36788, abs=0.015) and abs(got.c) < 0.03


def test_k_core_tasks_hold_some_pairs(spark, monkeypatch):
    """Pairs were once dealt to as many tasks as the session has, so a task grew with the graph."""
    monkeypatch.setattr(graph, "TASK", 500)
    edges = spark.range(4000).select((F.col("id") % 400).alias("src"), (F.col("id") + 400).alias("dst")).repartition(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    both = graph.undirected(edges)
    sizes = [r["count"] for r in both.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 1000
    assert graph.k_core(edges.unionByName(spark.createDataFrame([(5, 6), (6, 7), (5, 7)], "src long, dst long")), 2).count() == 3


def test_equal_nodes_have_equal_ranks(spark):
    """Sums of doubles once differed in their last digits by the order of rows, so the highest of equal nodes were a matter of chance."""
    # 40 copies: one node with an edge from each of 30 others, of which number s has s edges
    edges = [(c * 10_000 + 100 * s, -(c * 10_000 + (100 * s + i if i else 1))) for c in range(1, 41) for s in range(1, 31) for i in range(s)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    main = {-(c * 10_000 + 1) for c in range(1, 41)}
    got = {r.node: r.rank for r in graph.pagerank(df).collect()}
    assert len({got[x] for x in main}) == 1 and sum(got.values()) == pytest.approx(1)
    # joined rounds: the same with an edge to each source
    more = df.unionByName(df.where("src % 10000 > 0").select((F.col("src") + 10_000_000).alias("src"), F.col("src").alias("dst")).distinct())
    got = {r.node: r.rank for r in graph.pagerank(more).collect()}
    assert len({got[x] for x in main}) == 1 and sum(got.values()) == pytest.approx(1)
