"""Operators on pyspark.ml: clusters, components, patterns, regressions. Seeds and orders are fixed."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.functions.vectors import knn
from quarrystat.plans.registry import register


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(rows).select("features", "label")


@register("cluster_kmeans")
def _kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return KMeans(k=8, seed=1).fit(rows).transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@register("cluster_gaussian_mixture")
def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    return GaussianMixture(k=3, seed=1, maxIter=20).fit(rows).transform(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@register("pca_components")
def _pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(r := _numbers(spark, sf_dir)).transform(r)
    out = PCA(k=2, inputCol="scaled", outputCol="pc").fit(rows).transform(rows).select(vector_to_array("pc").alias("pc"))
    return out.agg(F.round(F.var_pop(F.col("pc")[0]), 6).alias("v1"), F.round(F.var_pop(F.col("pc")[1]), 6).alias("v2"))


@register("frequent_itemsets_fpgrowth")
def _itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.to_date("ts")).agg(F.collect_set("event_type").alias("items"))
    model = FPGrowth(minSupport=0.05, minConfidence=0.1).fit(rows)
    return model.freqItemsets.select(F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


@register("sequential_patterns_prefixspan_v1")
def _prefixspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    rows = log.select(F.transform("s", lambda x: F.array(x["event_type"])).alias("sequence"))
    found = PrefixSpan(minSupport=0.3, maxPatternLength=6).findFrequentSequentialPatterns(rows)
    return found.select(F.array_join(F.transform("sequence", lambda x: x[0]), ">").alias("pattern"), "freq")


@register("regression_linear")
def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = LinearRegression(solver="normal").fit(_numbers(spark, sf_dir))
    rows = [(n, float(round(c, 4))) for n, c in zip(("quantity", "discount", "tax"), model.coefficients)]
    return spark.createDataFrame([*rows, ("r2", float(round(model.summary.r2, 6)))], "term string, value double")


@register("regression_logistic")
def _logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir).withColumn("label", (F.col("label") > 50_000).cast("double"))
    out = LogisticRegression(regParam=0.01).fit(rows).transform(rows)
    return out.agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 4).alias("accuracy"), F.count("*").alias("n"))


@register("regression_random_forest")
def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbers(spark, sf_dir)
    out = RandomForestRegressor(numTrees=10, maxDepth=5, seed=1).fit(rows).transform(rows)
    return out.agg(F.corr("prediction", "label").alias("r"), F.count("*").alias("n"))


@register(
    "vector_knn",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
       d AS (SELECT query_id, vec_id AS item_id, sqrt(list_sum(list_transform(list_zip(q, embedding), lambda x: power(x[1]::DOUBLE - x[2]::DOUBLE, 2)))) AS distance FROM q, embeddings)
       SELECT query_id, item_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM d) WHERE rank <= 5""",
)
def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = knn(rows, rows.where("vec_id % 20 = 0"), 5, "vec_id", "vec_id", "embedding")
    return out.select("query_id", "item_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))
