"""Joins, filters, samples, dates and similarities that the relational primitives lack, as functions of DataFrames, each with
SQL written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.functions.matching import excluded, fuzzy_links, jaccard, robust_scale, sorted_tokens, sparse_cosine, token_sort_ratio
from quarrystat.plans.halves import early_half
from quarrystat.plans.registry import register


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("filter_process_exclusion", """
SELECT event_type, count(*) AS n FROM events WHERE NOT (lower(event_type) = 'view' OR lower(event_type) GLOB 'sign*' OR lower(event_type) LIKE '%rr_r' OR regexp_matches(lower(event_type), '^pur.*e$')) GROUP BY 1""")
def _exclusion(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    return rows.where(~excluded(F.col("event_type"), [" VIEW", "sign*", "%rr_r", "re:^pur.*e$", "re:("])).groupBy("event_type").agg(F.count("*").alias("n"))


def in_windows(df: DataFrame, time: str, windows: DataFrame) -> DataFrame:
    """Rows whose time lies in any of the windows (start, end, inclusive). Windows are expanded to their days, so that the join
    is by day and neither side is broadcast whatever its size; a row in several windows stays once."""
    days = windows.where("start IS NOT NULL AND end IS NOT NULL AND start <= end").withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    rows = df.withColumn("_day", F.to_date(time))
    hit = (rows["_day"] == days["_day"]) & (F.col(time) >= F.col("start")) & (F.col(time) <= F.col("end"))
    return rows.join(days, hit, "left_semi").drop("_day")


@register("interval_join_windows", """
WITH w AS (SELECT o_orderdate AS s, o_orderdate + INTERVAL 36 HOUR AS e FROM orders WHERE o_orderkey % 97 = 0)
SELECT year(l_shipdate)::BIGINT AS y, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE EXISTS (SELECT 1 FROM w WHERE l_shipdate BETWEEN s AND e) GROUP BY 1""")
def _windows(spark, sf_dir):
    windows = _read(spark, sf_dir, "orders").where("o_orderkey % 97 = 0").selectExpr("o_orderdate AS start", "o_orderdate + INTERVAL 36 HOURS AS end")
    rows = in_windows(_read(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity"), "l_shipdate", windows)
    return rows.groupBy(F.year("l_shipdate").cast("long").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str) -> DataFrame:
    """For each left row (key, time, id) the smallest distance in days to any right time of its key; null where it has none.
    One shuffle: both sides in one column, the last right time before and the first after."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    both = left.select(key, us.alias("t"), F.col("id").alias("id"), F.lit(None).cast("long").alias("r")).unionByName(right.select(key, us.alias("t"), F.lit(None).cast("long").alias("id"), us.alias("r")))
    order = Window.partitionBy(key).orderBy("t")
    before = F.max("r").over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("r").over(order.rangeBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("t") - F.col("a"), F.col("b") - F.col("t")) / 86_400_000_000
    return both.withColumn("a", before).withColumn("b", after).where("id IS NOT NULL").select(key, "id", F.round(gap, 6).alias("days"))


@register("nearest_asof_join", """
SELECT o.o_custkey AS k, o.o_orderkey AS id, round(min(abs(epoch_us(o.o_orderdate) - epoch_us(p.o_orderdate))) / 86400000000.0, 6) AS days
FROM orders o LEFT JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderpriority = '1-URGENT' WHERE o.o_orderpriority = '5-LOW' GROUP BY ALL""")
def _nearest(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    low, urgent = orders.where("o_orderpriority = '5-LOW'").withColumnRenamed("o_orderkey", "id"), orders.where("o_orderpriority = '1-URGENT'")
    return nearest(low, urgent, "k", "o_orderdate")


@register("transform_cross_dataset_link_graph_v1", """
WITH n AS (SELECT p_partkey AS id, list_sort(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM part),
l AS (SELECT * FROM n WHERE id % 2 = 0), r AS (SELECT * FROM n WHERE id % 2 = 1),
lt AS (SELECT DISTINCT id, unnest(t) AS w FROM l), rt AS (SELECT DISTINCT id, unnest(t) AS w FROM r),
p AS (SELECT lt.id AS a, rt.id AS b FROM lt JOIN rt ON lt.w = rt.w WHERE length(lt.w) >= 4
      UNION SELECT l.id, r.id FROM l JOIN r ON list_sort(list_distinct(l.t)) = list_sort(list_distinct(r.t)) WHERE len(l.t) > 0),
s AS (SELECT a, b, list_distinct(l.t) AS x, list_distinct(r.t) AS y, array_to_string(l.t, ' ') AS u, array_to_string(r.t, ' ') AS v FROM p JOIN l ON l.id = a JOIN r ON r.id = b),
k AS (SELECT a, b, list_sort(x) = list_sort(y) AS same, floor(100.0 * (1 - levenshtein(u, v)::DOUBLE / greatest(length(u), length(v), 1)))::BIGINT AS ratio, len(list_intersect(x, y)) AS shared, least(len(x), len(y)) AS shorter FROM s),
c AS (SELECT a, b, CASE WHEN same THEN 2 WHEN ratio >= 82 THEN 1 WHEN shared >= 2 AND shared >= 0.6 * shorter THEN 0 END AS kind, CASE WHEN same THEN 100 ELSE ratio END AS score FROM k)
SELECT a AS left_id, b AS right_id, CASE kind WHEN 2 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'tokens' END AS kind, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY kind DESC, score DESC, b) AS rn FROM c WHERE kind IS NOT NULL) WHERE rn = 1""")
def _links(spark, sf_dir):
    part = _read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS name")
    return fuzzy_links(part.where("id % 2 = 0"), part.where("id % 2 = 1"))


def upsert_sums(base: DataFrame, changes: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows of ``base`` with the changes of equal keys added, and new keys: sums combine before the shuffle."""
    return base.select(*keys, *sums).unionByName(changes.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


@register("upsert_aggregate", """
SELECT event_type, ts::DATE AS day, count(*)::BIGINT AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL""")
def _upsert(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("n", F.lit(1).cast("long")).withColumn("v", F.col("value"))
    first = rows.where("event_id % 3 <> 0").groupBy("event_type", "day").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return upsert_sums(first, rows.where("event_id % 3 = 0"), ["event_type", "day"], ["n", "v"]).withColumn("v", F.round("v", 4))


def hash_sample(df: DataFrame, ids: list[str], k: int, seed: int) -> DataFrame:
    """The k rows with the smallest md5 of seed and ids: the same rows for any order or partitioning. Tasks send k rows each."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    return df.withColumn("_h", h).orderBy("_h", *ids).limit(k).drop("_h")


@register("hash_ordered_sample", "SELECT event_id, event_type FROM events ORDER BY md5('42|' || event_id::VARCHAR), event_id LIMIT 500")
def _sample(spark, sf_dir):
    return hash_sample(_read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 500, 42)


@register("intersect_except", """
SELECT 'both' AS side, k FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)
UNION ALL SELECT 'first', k FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)""")
def _sets(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem")
    a, b = rows.where("l_quantity > 49").selectExpr("l_suppkey AS k"), rows.where("l_discount > 0.09").selectExpr("l_suppkey AS k")
    return a.intersect(b).select(F.lit("both").alias("side"), "k").unionByName(a.subtract(b).select(F.lit("first").alias("side"), "k"))


@register("string_distance", """
WITH t AS (SELECT p_partkey, p_name, p_type, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')), ' ') AS a,
           array_to_string(list_sort(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '')), ' ') AS b FROM part)
SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS edits, a AS tokens, floor(100.0 * (1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1)))::BIGINT AS ratio FROM t""")
def _strings(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return part.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("edits"), F.array_join(sorted_tokens(F.col("p_name")), " ").alias("tokens"), token_sort_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


def infer_roll_day(df: DataFrame, time: str, low: int = 2, high: int = 10) -> DataFrame:
    """The day at which accounting months should begin so that their row counts vary least: smallest σ/μ of the cohorts."""
    rows = df.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("d")).agg(F.count("*").alias("n"))
    each = rows.withColumn("day", F.explode(F.sequence(F.lit(low), F.lit(high))))
    months = each.groupBy("day", F.trunc(F.add_months("d", 0) - F.make_interval(days=F.col("day") - 1), "month").alias("m")).agg(F.sum("n").alias("n"))
    told = months.groupBy("day").agg(F.count("*").alias("months"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))
    return told.orderBy(F.round("cv", 12), "day").limit(1).select(F.col("day").cast("long").alias("roll_day"), "months", F.round("cv", 9).alias("cv"))


@register("infer_roll_day", """
WITH d AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT *, unnest(range(2, 11)) AS day FROM d),
m AS (SELECT day, date_trunc('month', d - (day - 1)::INT) AS m, sum(n) AS n FROM e GROUP BY ALL)
SELECT day::BIGINT AS roll_day, count(*) AS months, round(stddev_pop(n) / avg(n), 9) AS cv FROM m GROUP BY day ORDER BY round(stddev_pop(n) / avg(n), 12), day LIMIT 1""")
def _roll(spark, sf_dir):
    return infer_roll_day(_read(spark, sf_dir, "orders"), "o_orderdate")


def infer_close_window(df: DataFrame, time: str, length: int = 17, fallback: tuple[int, int] = (20, 5)) -> DataFrame:
    """Start and end day of the densest run of ``length`` days of the month, running on over its end; the earliest start wins."""
    days = df.where(F.col(time).isNotNull()).groupBy(F.dayofmonth(time).alias("d")).agg(F.count("*").alias("n"))
    starts = df.sparkSession.range(1, 32).select(F.col("id").cast("int").alias("s"))
    inside = F.pmod(F.col("d") - F.col("s"), F.lit(31)) < length
    sums = starts.join(F.broadcast(days), inside).groupBy("s").agg(F.sum("n").alias("rows"))
    best = sums.agg(F.max(F.struct("rows", (-F.col("s")).alias("s"))).alias("b"))
    s = F.coalesce(-F.col("b.s"), F.lit(fallback[0])).cast("long")
    end = F.when(F.col("b.s").isNull(), F.lit(fallback[1])).otherwise(F.pmod(s + length - 2, F.lit(31)) + 1).cast("long")
    return best.select(s.alias("start_day"), end.alias("end_day"), F.coalesce("b.rows", F.lit(0)).alias("rows"))


@register("infer_close_window", """
WITH d AS (SELECT day(l_shipdate) AS d, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1), s AS (SELECT unnest(range(1, 32)) AS s)
SELECT s::BIGINT AS start_day, ((s + 17 - 2) % 31 + 1)::BIGINT AS end_day, sum(n)::BIGINT AS rows FROM s JOIN d ON (d - s + 31) % 31 < 17 GROUP BY s ORDER BY rows DESC, s LIMIT 1""")
def _close(spark, sf_dir):
    return infer_close_window(_read(spark, sf_dir, "lineitem").where("l_quantity > 25"), "l_shipdate")


@register("robust_centre_scale", """
WITH s AS (SELECT count(*) AS n, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, min(o_totalprice) AS lo FROM orders),
k AS (SELECT avg(power((o_totalprice - m) / sd, 3)) AS skew FROM orders, s),
x AS (SELECT CASE WHEN skew > 2 AND lo >= 0 THEN ln(1 + o_totalprice) ELSE o_totalprice END AS x, skew > 2 AND lo >= 0 AS l FROM orders, s, k),
c AS (SELECT count(*) AS n, bool_or(l) AS l, quantile_cont(x, 0.5) AS c FROM x)
SELECT max(c.n) AS n, bool_or(c.l) AS log1p, round(max(c), 9) AS centre, round(1.4826 * quantile_cont(abs(x - c), 0.5), 9) AS scale FROM x, c""")
def _robust(spark, sf_dir):
    return robust_scale(_read(spark, sf_dir, "orders"), "o_totalprice")


def cliffs_delta(df: DataFrame, group: Column, key: str, value: str) -> DataFrame:
    """P(a > b) − P(a < b) of the rows with group true (a) and false (b) by key, from counts of equal values: what a window
    orders is the distinct values of a key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("x")).agg(F.sum(group.cast("long")).alias("a"), F.sum((~group).cast("long")).alias("b"))
    order = Window.partitionBy("key").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("lower", F.coalesce(F.sum("b").over(order), F.lit(0)))
    told = below.groupBy("key").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * (2 * F.col("lower") + F.col("b"))).alias("u2"))
    return told.select("key", "n_a", "n_b", F.round(F.col("u2") / (F.col("n_a") * F.col("n_b")) - 1, 9).alias("delta"))


@register("cliffs_delta", """
WITH r AS (SELECT event_type AS key, value, event_id % 2 = 0 AS g FROM events)
SELECT a.key, (SELECT count(*) FROM r WHERE g AND r.key = a.key) AS n_a, (SELECT count(*) FROM r WHERE NOT g AND r.key = a.key) AS n_b, round(avg(sign(a.value - b.value)), 9) AS delta
FROM r a JOIN r b ON a.key = b.key AND a.g AND NOT b.g GROUP BY a.key""")
def _cliff(spark, sf_dir):
    return cliffs_delta(_read(spark, sf_dir, "events"), F.col("event_id") % 2 == 0, "event_type", "value")


@register("set_similarities", """
WITH s AS (SELECT user_id % 20 AS u, event_type, count(*) AS n FROM events WHERE event_id % 7 = 0 GROUP BY ALL),
p AS (SELECT a.u AS a, b.u AS b, a.event_type, a.n AS x, b.n AS y FROM s a JOIN s b ON a.u < b.u AND a.event_type = b.event_type),
z AS (SELECT u, count(*) AS c, sqrt(sum(n * n)) AS norm FROM s GROUP BY u)
SELECT l.u AS a, r.u AS b, round(count(p.event_type) / (l.c + r.c - count(p.event_type))::DOUBLE, 9) AS jaccard, round(coalesce(sum(x * y), 0) / (l.norm * r.norm), 9) AS cosine
FROM z l JOIN z r ON l.u < r.u LEFT JOIN p ON p.a = l.u AND p.b = r.u GROUP BY l.u, r.u, l.c, r.c, l.norm, r.norm""")
def _similar(spark, sf_dir):
    """Groups of users (twenty) by the events they share."""
    counts = _read(spark, sf_dir, "events").where("event_id % 7 = 0").groupBy((F.col("user_id") % 20).alias("u"), "event_type").agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    a, b = maps.selectExpr("u AS a", "m AS x"), maps.selectExpr("u AS b", "m AS y")
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(jaccard(F.map_keys("x"), F.map_keys("y")), 9).alias("jaccard"), F.round(sparse_cosine(F.col("x"), F.col("y")), 9).alias("cosine"))


def recency_weights(df: DataFrame, time: str, key: str, value: str, half_life: float = 3.0) -> DataFrame:
    """Sums by key with each month weighted by 0.5 ** (months before the last / half_life); months are summed first."""
    months = df.where(F.col(time).isNotNull()).groupBy(F.col(key).alias("key"), F.trunc(time, "month").alias("m")).agg(F.sum(value).alias("s"))
    last = months.agg(F.max("m").alias("last"))
    weight = F.pow(F.lit(0.5), F.round(F.months_between("last", "m")) / half_life)
    return months.crossJoin(F.broadcast(last)).groupBy("key").agg(F.round(F.sum(F.col("s") * weight), 4).alias("score"))


@register("recency_weighted_ranking", """
WITH m AS (SELECT o_orderpriority AS key, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS s FROM orders GROUP BY ALL), l AS (SELECT max(m) AS last FROM m)
SELECT key, round(sum(s * power(0.5, datediff('month', m, last) / 3.0)), 4) AS score FROM m, l GROUP BY key""")
def _recency(spark, sf_dir):
    return recency_weights(_read(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", "o_totalprice")


def without_process(df: DataFrame, time: str, process: str, hours: Column) -> DataFrame:
    """Hours of each accounting month (days up to the fifth belong to the month before), and without each process in turn."""
    month = F.trunc(F.when(F.dayofmonth(time) <= 5, F.add_months(F.to_date(time), -1)).otherwise(F.to_date(time)), "month")
    sums = df.where(F.col(time).isNotNull()).groupBy(month.alias("month"), F.col(process).alias("process")).agg(F.sum(hours).alias("h"))
    totals = sums.groupBy("month").agg(F.sum("h").alias("every"))
    return sums.join(totals, "month").select("month", "process", F.round("every", 4).alias("hours_with"), F.round(F.col("every") - F.col("h"), 4).alias("hours_without"))


@register("process_removal_model", """
WITH r AS (SELECT CASE WHEN day(ts) <= 5 THEN date_trunc('month', ts - INTERVAL 1 MONTH) ELSE date_trunc('month', ts) END::DATE AS month, event_type AS process, sum(value / 3600) AS h FROM events GROUP BY ALL)
SELECT month, process, round(sum(h) OVER (PARTITION BY month), 4) AS hours_with, round(sum(h) OVER (PARTITION BY month) - h, 4) AS hours_without FROM r""")
def _removal(spark, sf_dir):
    return without_process(_read(spark, sf_dir, "events"), "ts", "event_type", F.col("value") / 3600)


@register("half_split_counts", """
WITH o AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn, count(*) OVER () AS n FROM lineitem)
SELECT l_returnflag, sum((rn <= n // 2)::INT)::BIGINT AS early, sum((rn > n // 2)::INT)::BIGINT AS late FROM o GROUP BY 1""")
def _halves(spark, sf_dir):
    rows = early_half(_read(spark, sf_dir, "lineitem"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    return rows.groupBy("l_returnflag").agg(F.sum("early").cast("long").alias("early"), F.sum(1 - F.col("early")).cast("long").alias("late"))
