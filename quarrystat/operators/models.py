"""Fitted models on pyspark.ml. Seeds are fixed and splits are made by a hash of the row's keys."""

from __future__ import annotations

import itertools
import math
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from quarrystat.operators.graph import _supply, core_numbers, pagerank
from quarrystat.operators.topics import indexed, lda, vocabulary
from quarrystat.plans.registry import register
from quarrystat.plans.scratch import materialize

FEATURES = ["l_quantity", "l_discount", "l_tax"]
#: Words of a topic model at most; the driver holds them.
VOCABULARY = 1 << 18
#: Trees of each forest of the double residuals.
TREES = 8


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with features, label (price) and part, a hash bucket of 0 to 9."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", *FEATURES, F.col("l_extendedprice").alias("label"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(10)))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector of standardised event counts and mean value for each user."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    wide = log.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).na.fill(0.0)
    raw = VectorAssembler(inputCols=["n", "m", "s"], outputCol="raw").transform(wide)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw)


@register("cluster_analysis_auto")
def _auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertia and silhouette for 2 to 5 clusters."""
    rows, found = materialize(profiles(spark, sf_dir).select("features"), "profiles"), []  # four fits read it
    for k in range(2, 6):
        model = KMeans(k=k, seed=1).fit(rows)
        found.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(rows)))))
    return spark.createDataFrame(found, "k long, inertia double, silhouette double")


@register("information_bottleneck_v1")
def _bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of cluster and label over k."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    rows, out = materialize(rows, "vectors"), None
    for k in (2, 4, 8):
        cells = KMeans(k=k, seed=1).fit(rows).transform(rows).groupBy("prediction", "label").agg(F.count("*").alias("n"))
        every, c, w = F.sum("n").over(Window.partitionBy()), F.sum("n").over(Window.partitionBy("prediction")), F.sum("n").over(Window.partitionBy("label"))
        one = cells.select((F.col("n") / every * F.log(F.col("n") * every / (c * w))).alias("x")).agg(F.lit(k).cast("long").alias("k"), F.round(F.sum("x"), 6).alias("mi"))
        out = one if out is None else out.unionByName(one)
    return out


@register("hmm_latent_state_sequences")
def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four states by k-means of value and gap, with transition counts within users."""
    log, w = spark.read.parquet(f"{sf_dir}/events.parquet"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = log.withColumn("gap", F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1e6, F.lit(0.0)))
    rows = VectorAssembler(inputCols=["value", "gap"], outputCol="raw").transform(rows.select("user_id", "ts", "event_id", "value", "gap"))
    rows = StandardScaler(inputCol="raw", outputCol="features").fit(rows).transform(rows)
    out = KMeans(k=4, seed=1).fit(rows).transform(rows).withColumn("nxt", F.lead("prediction").over(w))
    return out.where("nxt IS NOT NULL").groupBy("prediction", "nxt").agg(F.count("*").alias("n"))


@register("gradient_boosting_importance_v1")
def _boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances by trees on the distinct feature values, weighted by their rows, with their mean label: gains of squared error
    depend on a value's rows by their number and mean alone."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = rows.groupBy(*FEATURES).agg(F.avg("l_extendedprice").alias("label"), F.count("l_extendedprice").cast("double").alias("weight"))
    cells = materialize(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cells), "cells")
    model = GBTRegressor(maxIter=8, maxDepth=3, seed=1, weightCol="weight").fit(cells)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(FEATURES, model.featureImportances.toArray())], "feature string, importance double")


@register("elastic_net_regularized_glm_v1")
def _elastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = LinearRegression(regParam=1.0, elasticNetParam=0.5).fit(numbers(spark, sf_dir))
    return spark.createDataFrame([(float(model.summary.r2), float(sum(c == 0 for c in model.coefficients)) / len(FEATURES))], "r2 double, sparsity double")


@register("poisson_regression_rate_drivers_v1")
def _poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order on its mean quantity and discount; the error is the mean squared one."""
    rows = numbers(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").cast("double").alias("label"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    rows = VectorAssembler(inputCols=["q", "d"], outputCol="features").transform(rows)
    model = GeneralizedLinearRegression(family="poisson", link="log", maxIter=10).fit(rows)
    mse = model.transform(rows).agg(F.avg(F.pow(F.col("prediction") - F.col("label"), 2))).first()[0]
    return spark.createDataFrame([("intercept", float(model.intercept)), ("quantity", float(model.coefficients[0])), ("discount", float(model.coefficients[1])), ("mse", float(mse or 0.0))], "term string, value double")


@register("conformal_prediction_interval_v1")
def _conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split conformal 90 per cent interval: fit on six tenths, calibrate on two, cover the rest."""
    rows = numbers(spark, sf_dir)
    out = RandomForestRegressor(numTrees=10, maxDepth=5, seed=1).fit(rows.where("part < 6")).transform(rows.where("part >= 6"))
    out = out.withColumn("e", F.abs(F.col("label") - F.col("prediction")))
    width = out.where("part < 8").agg(F.percentile("e", F.lit(0.9)).alias("width"))
    return out.where("part >= 8").crossJoin(F.broadcast(width)).agg(F.avg((F.col("e") <= F.col("width")).cast("double")).alias("coverage"), F.max("width").alias("half_width"), F.count("*").alias("n"))


def _poisson(key: Column) -> Column:
    """Number of times that a bootstrap takes a row, Poisson of mean 1, by a hash of ``key``."""
    u, least, chance, out = F.shiftrightunsigned(key, 11) / float(1 << 53), 0.0, math.exp(-1), None
    for n in range(19):
        least, chance = least + chance, chance / (n + 1)
        out = F.when(u < least, n) if out is None else out.when(u < least, n)
    return out.otherwise(19)


def forest_cells(rows: DataFrame, trees: int) -> DataFrame:
    """Distinct feature values by ``fold`` and ``tree``, with mean ``label`` and ``treat`` of the ``n`` rows that the tree's bootstrap
    takes; tree -1 has each row once, and ``both`` is the covariance of label and treat in the cell."""
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(-1), F.lit(trees - 1))))
    key = F.xxhash64("tree", "l_orderkey", "l_linenumber", "l_returnflag", "label", *FEATURES)
    drawn = drawn.withColumn("w", F.when(F.col("tree") < 0, 1).otherwise(_poisson(key)))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    cells = drawn.groupBy(*FEATURES, "fold", "tree").agg(F.sum("w").alias("n"), mean("label"), mean("treat"), F.covar_pop("label", "treat").alias("both"))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cells.where("n > 0"))


@register("double_ml_ate_v1")
def _double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of returned lines on price, with both residualised out of fold by random forests.

    Each tree's bootstrap draws rows and is added up by distinct feature values: a tree depends on rows by their number and mean
    alone, and so do the sums of residuals, but for the covariance within a cell. Rows without a price or flag don't count."""
    rows = numbers(spark, sf_dir).drop("features").withColumn("treat", (F.col("l_returnflag") == "R").cast("double"))
    rows = rows.where("label IS NOT NULL AND treat IS NOT NULL").withColumn("fold", F.col("part") % 2)
    cells = materialize(forest_cells(rows, TREES), "cells")

    def fit(job: tuple[int, int, str]) -> RandomForestRegressionModel:
        fold, tree, label = job
        one = RandomForestRegressor(numTrees=1, bootstrap=False, featureSubsetStrategy="onethird", maxDepth=4, seed=tree, weightCol="n", labelCol=label, predictionCol=f"{label}{tree}")
        return one.fit(cells.where(f"tree = {tree} AND fold <> {fold}"))

    jobs = list(itertools.product((0, 1), range(TREES), ("label", "treat")))
    with ThreadPool(TREES) as pool:
        models = pool.map(inheritable_thread_target(spark)(fit), jobs)
    parts = []
    for fold in (0, 1):
        part = cells.where(f"tree = -1 AND fold = {fold}")
        for job, model in zip(jobs, models):
            part = model.transform(part) if job[0] == fold else part
        parts.append(part)
    left = {c: F.col(c) - sum(F.col(f"{c}{i}") for i in range(TREES)) / TREES for c in ("label", "treat")}
    top, bottom = F.col("both") + left["label"] * left["treat"], F.col("treat") * (1 - F.col("treat")) + left["treat"] * left["treat"]
    return parts[0].unionByName(parts[1]).agg((F.sum(F.col("n") * top) / F.sum(F.col("n") * bottom)).alias("ate"), F.sum("n").alias("n"))


@register("factor_analysis_auto")
def _loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(r := numbers(spark, sf_dir)).transform(r)
    pc = PCA(k=2, inputCol="scaled", outputCol="pc").fit(rows).pc.toArray()
    return spark.createDataFrame([(n, k, abs(float(pc[i, k]))) for i, n in enumerate(FEATURES) for k in range(2)], "feature string, component long, loading double")


@register("topic_model_lda")
def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading terms of five topics over whole texts: each iteration reads every document, with its 262,144 commonest words at most."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("text")
    terms = vocabulary(texts, VOCABULARY)
    weights = lda(materialize(indexed(texts, terms), "counts"), len(terms), k=5, rounds=5, seed=1)  # five rounds read it
    found = [(k, " ".join(terms[int(i)].as_py() for i in np.argsort(-weights[:, k], kind="stable")[:6])) for k in range(5)]
    return spark.createDataFrame(found, "topic int, terms string")


#: Sets of up to SHORT items meet by common subsets, of which a set has SUBSETS at most for a partner's size; longer ones by one item.
SHORT, SUBSETS = 14, 64
#: Rows of one task that compares sets.
MEETING = 50_000


def _subsets(order: list[str]) -> list[tuple[int, int, str]]:
    """Sizes (a <= b, one of them this set's) and a subset that this set shares with each near set of the other size, for all such sizes.

    Near sets of a and b items have c = 7 (a + b) / 17 (rounded up) in common, so the first k of these lie among the first a - c + k
    of one and b - c + k of the other, for any k up to c; k is as large as SUBSETS allows, at best c: then each meeting is a near pair.
    """
    n, out = len(order), []
    for m in range(-(-7 * n // 10), min(10 * n // 7, SHORT) + 1):
        c = -(-7 * (n + m) // 17)
        k = next((k for k in range(c, 1, -1) if math.comb(max(n, m) - c + k, k) <= SUBSETS), 1)
        out += [(min(n, m), max(n, m), "\x1f".join(some)) for some in itertools.combinations(order[: n - c + k], k)]
    return out


def near_sets(sets: DataFrame) -> DataFrame:
    """All pairs of ``sets`` (key, items, id, copies; distinct keys) at Jaccard distance of at most 0.3, and each set with copies with itself.

    Short sets that are near share a subset (see ``_subsets``). A pair with a long one shares an item among the rarest 3/10 n + 1
    (rounded down) of each, n being its size.
    """
    items = sets.select("key", "items", F.size("items").alias("n"), F.explode("items").alias("item"))
    rare = items.groupBy("item").agg(F.count("*").alias("f"))
    ranked = items.join(rare, "item").groupBy("key").agg(F.first("items").alias("items"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "item"))).alias("order"))
    ranked = materialize(ranked.select("key", "items", "n", F.col("order.item").alias("order")), "ranked")
    ranked = ranked.repartition(ranked.count() // MEETING + 1, "key")
    subsets = F.udf(lambda order: _subsets(order), "array<struct<a:int,b:int,item:string>>")
    short = ranked.where(F.col("n") <= SHORT).select("key", "items", "n", F.explode(subsets("order")).alias("o")).select("key", "items", "n", "o.*")
    rarest = F.explode(F.slice("order", F.lit(1), F.expr("CAST(3 * n DIV 10 + 1 AS INT)"))).alias("item")
    long_ = ranked.where(10 * F.col("n") > 7 * SHORT).select("key", "items", "n", F.lit(0).alias("a"), F.lit(0).alias("b"), rarest)
    prefix = materialize(short.unionByName(long_), "prefix")
    parts = prefix.count() // MEETING + 1
    left = prefix.where("a IN (0, n)").repartition(parts, "a", "b", "item").alias("x")
    right = prefix.where("b IN (0, n)").repartition(parts, "a", "b", "item").alias("y")
    once = F.when(F.col("x.a") == F.col("x.b"), F.col("x.key") < F.col("y.key")).otherwise(F.lit(True))
    sizes = (F.col("x.a") > 0) | ((10 * F.least("x.n", "y.n") >= 7 * F.greatest("x.n", "y.n")) & (F.greatest("x.n", "y.n") > SHORT))
    pairs = left.join(right, (F.col("x.item") == F.col("y.item")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")) & once & sizes)
    both = F.size(F.array_intersect("x.items", "y.items"))
    pairs = pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"), both.alias("both"), (F.col("x.n") + F.col("y.n") - both).alias("either")).where("10 * both >= 7 * either").distinct()
    named = lambda c: sets.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"), F.col("copies").alias(f"{c}_copies"))
    pairs = pairs.select("a", "b", F.round(1 - F.col("both") / F.col("either"), 6).alias("distance"))
    same = sets.where("copies > 1").select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(same).join(named("a"), "a").join(named("b"), "b")


@register("param_near_duplicate_minhash_v1")
def _minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct parameter sets at Jaccard distance of at most 0.3, all of them; equal sets are one class first.

    A class has the number of its copies and the id (user and day) of its first; one of several copies is paired with itself.
    """
    log = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set(F.concat_ws("=", "event_type", F.floor(F.col("value") / 50)))).alias("items"))
    sets = log.groupBy("items").agg(F.min(F.struct("user_id", "day")).alias("id"), F.count("*").alias("copies"))
    return near_sets(materialize(sets.select("items", F.array_join("items", ",").alias("key"), F.concat_ws("/", "id.user_id", "id.day").alias("id"), "copies"), "sets"))


@register("graph_pagerank_hotspots_v1")
def _hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest ranks, which hold ``share`` together."""
    top = pagerank(_supply(spark, sf_dir)).orderBy(F.col("rank").desc(), "node").limit(10)
    return top.select("node", F.round("rank", 9).alias("rank"), F.round(F.sum("rank").over(Window.partitionBy()), 9).alias("share"))


@register("kshell_decomposition_v1")
def _shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shell k with its size, the nodes of the k-core and the highest core number."""
    shells = core_numbers(_supply(spark, sf_dir)).groupBy(F.col("core").alias("k")).agg(F.count("*").alias("shell"))
    down = Window.orderBy(F.col("k").desc())
    return shells.select("k", "shell", F.sum("shell").over(down).alias("nodes"), F.max("k").over(Window.partitionBy()).alias("max_core"))
