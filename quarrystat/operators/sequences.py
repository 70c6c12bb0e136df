"""Workflow sequences, parent chains, close-cycle signals, contract timing, roles of columns and plans, as functions with SQL apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.functions.matching import alignment_score, edit_pairs, simhash
from quarrystat.functions.pvalues import normal_sf
from quarrystat.operators.corrected import CASES, ROLES, case_variants
from quarrystat.operators.tested import PHI
from quarrystat.plans.registry import register
from quarrystat.plans.scratch import materialize


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(spark, sf_dir):
    return _read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def coded_variants(df: DataFrame, *roles) -> DataFrame:
    """Distinct variants (variant, code, n): one character for each activity, by its place among the sorted names."""
    counts = case_variants(df, *roles).groupBy("variant").agg(F.count("*").alias("n"))
    names = df.select(F.col(roles[3]).cast("string").alias("a")).where("a IS NOT NULL").distinct().agg(F.array_sort(F.collect_list("a")).alias("names"))
    char = lambda a: F.decode(F.unhex(F.lpad(F.hex(F.array_position("names", a) + 255), 4, F.lit("0"))), "UTF-16BE")
    return counts.crossJoin(F.broadcast(names)).select("variant", "n", F.array_join(F.transform(F.split("variant", ">"), char), "").alias("code"))


def neighbour_pairs(variants: DataFrame, buckets: int = 16) -> DataFrame:
    """Each variant with the next one of its hash bucket in hash order: as many pairs as variants, every variant in some pair."""
    h = F.md5("variant")
    own = Window.partitionBy("bucket").orderBy("h", "variant")
    rows = variants.withColumn("h", h).withColumn("bucket", F.substring(h, 1, 1))
    return rows.select("variant", "code", F.lead("variant").over(own).alias("other"), F.lead("code").over(own).alias("other_code")).where("other IS NOT NULL")


#: Edits up to which two workflows are close.
CLOSE = 1


@register("levenshtein_workflow_dist_v1", f"""
WITH c AS ({CASES.format('', 'events')}), v AS (SELECT DISTINCT variant, array_to_string(list_transform(string_split(variant, '>'), lambda s: s[1]), '') AS code FROM c),
p AS (SELECT code, lead(code) OVER (PARTITION BY md5(variant)[1] ORDER BY md5(variant), variant) AS other FROM v),
d AS (SELECT levenshtein(code, other)::DOUBLE / greatest(length(code), length(other)) AS d FROM p WHERE other IS NOT NULL),
w AS (SELECT DISTINCT code FROM v),
near AS (SELECT a.code AS a, b.code AS b FROM w a JOIN w b ON (length(a.code), a.code) < (length(b.code), b.code) AND levenshtein(a.code, b.code) <= {CLOSE})
SELECT (SELECT count(*) FROM v) AS n_workflows, (SELECT count(*) FROM near) AS close_pairs,
       (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM near UNION ALL SELECT b FROM near)) AS close_workflows, count(*) AS pairs, round(avg(d), 9) AS mean_dist, round(stddev_pop(d), 9) AS std_dist, round(quantile_cont(d, 0.5), 9) AS median_dist FROM d""")
def _edits(spark, sf_dir):
    """Normalised edit distance of workflows (users' days) to their neighbours in hash order, and all pairs within an edit."""
    variants = coded_variants(_days(spark, sf_dir), *ROLES)
    close = edit_pairs(variants, "code", CLOSE).select("a", "b")
    counts = close.agg(F.count("*").alias("close_pairs")).crossJoin(close.select(F.explode(F.array("a", "b")).alias("x")).agg(F.countDistinct("x").alias("close_workflows")))
    d = F.levenshtein("code", "other_code") / F.greatest(F.length("code"), F.length("other_code"))
    told = neighbour_pairs(variants).select(d.alias("d")).agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 9).alias("mean_dist"), F.round(F.stddev_pop("d"), 9).alias("std_dist"), F.round(F.percentile("d", 0.5), 9).alias("median_dist"))
    return told.crossJoin(variants.agg(F.count("*").alias("n_workflows"))).crossJoin(counts)  # rows of aggregates


def local_alignment(a: str, b: str, match: int = 2, miss: int = -1) -> int:
    """Best local alignment score (Smith and Waterman), gaps and misses costing the same."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        last, new = 0, [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (match if x == y else miss), row[j] + miss, last + miss))
            last = new[-1]
        best, row = max(best, max(new)), new
    return best


@register("smith_waterman_workflow_align_v1")
def _alignment(spark, sf_dir):
    """Mean local alignment of workflows with their neighbours in hash order, as a share of the shorter's own score."""
    pairs = neighbour_pairs(coded_variants(_days(spark, sf_dir), *ROLES)).select("code", "other_code")
    share = alignment_score(F.col("code"), F.col("other_code")) / (2 * F.greatest(F.least(F.length("code"), F.length("other_code")), F.lit(1)))
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg(share), 9).alias("mean_similarity"))


def motifs(df: DataFrame, case: list[str], time: str, tie: str, activity: str, low: int = 3, high: int = 6, least: float = 0.3, top: int = 20) -> DataFrame:
    """Runs of ``low`` to ``high`` activities by the share of cases that hold them."""
    seqs = case_variants(df, case, time, tie, activity).select("variant", F.split("variant", ">").alias("s"))
    each = F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("s") - k + 1, F.lit(1))), lambda i: i + k - 1 <= F.size("s")), lambda i: F.array_join(F.slice("s", i, k), ">"))))
    found = seqs.select(F.explode(F.array_distinct(each)).alias("motif")).groupBy("motif").agg(F.count("*").alias("cases"))
    both = found.crossJoin(F.broadcast(seqs.agg(F.count("*").alias("every"))))
    share = F.col("cases") / F.col("every")
    return both.select("motif", "cases", F.round(share, 9).alias("prevalence"), (share > least).alias("meme")).orderBy(F.col("cases").desc(), "motif").limit(top)


@register("meme_motif_discovery_v1", """
WITH c AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS s FROM events GROUP BY 1), k AS (SELECT unnest(range(3, 7)) AS k),
m AS (SELECT DISTINCT user_id, array_to_string(s[i:i + k - 1], '>') AS motif FROM (SELECT user_id, s, k, unnest(range(1, len(s) - k + 2)) AS i FROM c, k WHERE len(s) >= k))
SELECT motif, count(*) AS cases, round(count(*) / (SELECT count(*) FROM c)::DOUBLE, 9) AS prevalence, count(*) / (SELECT count(*) FROM c)::DOUBLE > 0.3 AS meme FROM m GROUP BY motif ORDER BY cases DESC, motif LIMIT 20""")
def _motifs(spark, sf_dir):
    return motifs(_read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type")


def chain_depths(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows (id, depth): steps to the end of each id's chain of parents. Pointers double each round, so rounds grow with the
    logarithm of the longest chain; ids on a cycle, which has no end, have null depth. A parent that is no row ends its chain."""
    own = df.select(F.col(key).alias("id"), F.col(parent).alias("to")).where("id IS NOT NULL").groupBy("id").agg(F.min("to").alias("to"))
    known = own.select(F.col("id").alias("to"))
    now = own.join(known.withColumn("there", F.lit(True)), "to", "left").select("id", F.when(F.col("there"), F.col("to")).alias("to"))
    now = materialize(now.withColumn("depth", F.col("to").isNotNull().cast("long")), "chains")
    limit, rounds = max(now.count(), 1).bit_length() + 1, 0
    while rounds < limit and now.where("to IS NOT NULL").limit(1).count():
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        stepped = now.join(ahead, "to", "left")
        now = materialize(stepped.select("id", F.col("next").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chains")
        rounds += 1
    return now.select("id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


@register("dependency_critical_path_v1", """
WITH RECURSIVE c AS (SELECT event_id AS id, 0 AS depth FROM events WHERE event_id // 3 NOT IN (SELECT event_id FROM events) OR event_id // 3 = event_id
  UNION ALL SELECT e.event_id, c.depth + 1 FROM events e JOIN c ON e.event_id // 3 = c.id WHERE e.event_id // 3 <> e.event_id)
SELECT count(*) AS nodes, max(depth)::BIGINT AS max_depth, round(quantile_cont(depth, 0.95), 6) AS p95_depth FROM c""")
def _depth(spark, sf_dir):
    """Every event depends on the one of a third of its number."""
    rows = _read(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id DIV 3 <> event_id THEN event_id DIV 3 END AS parent")
    return chain_depths(rows, "event_id", "parent").agg(F.count("depth").alias("nodes"), F.max("depth").alias("max_depth"), F.round(F.percentile("depth", 0.95), 6).alias("p95_depth"))


@register("param_near_duplicate_simhash_v1")
def _simhash(spark, sf_dir):
    """Distinct parameter sets (a user's days) with their copies and how many other sets have a 64-bit sign hash of at most three
    other bits: such pairs agree in one of four 16-bit bands, so bands find all of them."""
    rows = _read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set(F.concat_ws("=", "event_type", F.floor(F.col("value") / 50)))).alias("items"))
    sets = rows.groupBy("items").agg(F.count("*").alias("copies")).select(F.array_join("items", ",").alias("key"), "copies", simhash(F.col("items")).alias("h"))
    sets = materialize(sets, "hashes")
    pairs = near_hashes(sets, 3)
    ends = pairs.select(F.col("a").alias("key"), "bits").unionByName(pairs.select(F.col("b").alias("key"), "bits")).groupBy("key").agg(F.count("*").alias("links"), F.min("bits").alias("nearest_bits"))
    return sets.select("key", "copies").join(ends, "key", "left").select("key", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "nearest_bits")


def near_hashes(sets: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b, bits) of rows (key, copies, h) with Hamming distance of at most ``most`` < 4."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("i"), F.call_function("shiftrightunsigned", F.col("h"), i * 16).bitwiseAND(65535).alias("v"))))
    banded = sets.withColumn("band", band)
    a, b = banded.alias("a"), banded.alias("b")
    bits = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h")))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), bits.cast("long").alias("bits"))
    return pairs.where(F.col("bits") <= most).distinct()


# Close cycles


def contention(df: DataFrame, time: str, process: str, duration: str, close: Column, ratio: float = 2.0, rho: float = 0.7) -> DataFrame:
    """For each process: mean duration of all others inside and outside the close window, and Spearman's correlation of its daily
    count with the others' daily mean."""
    rows = df.where(F.col(time).isNotNull() & F.col(process).isNotNull() & F.col(duration).isNotNull())
    cells = rows.groupBy(F.col(process).alias("process"), F.to_date(time).alias("d"), close.alias("closed")).agg(F.count("*").alias("n"), F.sum(duration).alias("s"))
    days = cells.groupBy("d").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds"))
    daily = cells.groupBy("process", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(F.broadcast(days), "d").where("dn > n")
    daily = daily.select("process", "n", F.round((F.col("ds") - F.col("s")) / (F.col("dn") - F.col("n")), 9).alias("m"))
    rank = lambda c: F.rank().over(Window.partitionBy("process").orderBy(c)) + (F.count("*").over(Window.partitionBy("process", c)) - 1) / 2
    corr = daily.select("process", rank("n").alias("x"), rank("m").alias("y")).groupBy("process").agg((F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))).alias("rho"))
    part = lambda c, w: F.sum(F.when(F.col("closed") == w, F.col(c)).otherwise(0))
    every = cells.agg(part("n", True).alias("cn"), part("s", True).alias("cs"), part("n", False).alias("on"), part("s", False).alias("os"))
    own = cells.groupBy("process").agg(part("n", True).alias("a"), part("s", True).alias("b"), part("n", False).alias("c"), part("s", False).alias("e"))
    quotient = ((F.col("cs") - F.col("b")) / (F.col("cn") - F.col("a"))) / ((F.col("os") - F.col("e")) / (F.col("on") - F.col("c")))
    both = own.crossJoin(F.broadcast(every)).withColumn("q", quotient).join(corr, "process")
    return both.select("process", F.round("q", 6).alias("others_ratio"), F.round("rho", 6).alias("rho"), ((F.col("q") >= ratio) & (F.col("rho") >= rho)).alias("contends"))


@register("close_cycle_contention", """
WITH c AS (SELECT event_type AS process, ts::DATE AS d, day(ts) >= 20 OR day(ts) <= 5 AS closed, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL),
y AS (SELECT a.process, a.d, a.n, round((SELECT sum(b.s) / sum(b.n) FROM c b WHERE b.d = a.d AND b.process <> a.process), 9) AS m FROM (SELECT process, d, sum(n) AS n FROM c GROUP BY ALL) a),
r AS (SELECT process, rank() OVER (PARTITION BY process ORDER BY n) + (count(*) OVER (PARTITION BY process, n) - 1) / 2 AS x, rank() OVER (PARTITION BY process ORDER BY m) + (count(*) OVER (PARTITION BY process, m) - 1) / 2 AS y FROM y WHERE m IS NOT NULL),
k AS (SELECT process, corr(x, y) AS rho FROM r GROUP BY 1),
q AS (SELECT p.process, (SELECT sum(s) / sum(n) FROM c WHERE closed AND process <> p.process) / (SELECT sum(s) / sum(n) FROM c WHERE NOT closed AND process <> p.process) AS q FROM (SELECT DISTINCT process FROM c) p)
SELECT process, round(q, 6) AS others_ratio, round(rho, 6) AS rho, q >= 2 AND rho >= 0.7 AS contends FROM q JOIN k USING (process)""")
def _contention(spark, sf_dir):
    return contention(_read(spark, sf_dir, "events"), "ts", "event_type", "value", (F.dayofmonth("ts") >= 20) | (F.dayofmonth("ts") <= 5))


def close_spans(df: DataFrame, time: str, month: Column, share: float = 0.5) -> DataFrame:
    """For each calendar month the first and last day on which ``share`` of the rows belong to another accounting month."""
    rows = df.where(F.col(time).isNotNull()).select(F.trunc(time, "month").alias("m"), F.dayofmonth(time).alias("d"), (month != F.trunc(time, "month")).cast("double").alias("other"))
    days = rows.groupBy("m", "d").agg(F.avg("other").alias("p"), F.count("*").alias("n")).where(F.col("p") >= share)
    return days.groupBy(F.col("m").cast("date").alias("month")).agg(F.min("d").cast("long").alias("first_day"), F.max("d").cast("long").alias("last_day"), F.sum("n").alias("rows"))


@register("dynamic_close_detection", """
WITH d AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, day(o_orderdate) AS d, avg((date_trunc('month', o_orderdate + INTERVAL 9 DAY) <> date_trunc('month', o_orderdate))::INT) AS p, count(*) AS n FROM orders GROUP BY ALL)
SELECT m AS month, min(d)::BIGINT AS first_day, max(d)::BIGINT AS last_day, sum(n)::BIGINT AS rows FROM d WHERE p >= 0.5 GROUP BY m""")
def _dynamic(spark, sf_dir):
    return close_spans(_read(spark, sf_dir, "orders"), "o_orderdate", F.trunc(F.date_add("o_orderdate", 9), "month"))


def backtrack(spans: DataFrame, days: DataFrame, quantile: float = 0.5) -> DataFrame:
    """From each month's first close day back over the days before it whose row count is above the month's quantile."""
    limit = days.groupBy("month").agg(F.percentile("n", quantile).alias("mid"))
    before = days.join(limit, "month").join(spans.select("month", "first_day"), "month").where(F.col("d") < F.col("first_day"))
    quiet = before.where(F.col("n") <= F.col("mid")).groupBy("month").agg(F.max("d").alias("quiet"))
    out = spans.select("month", "first_day").join(quiet, "month", "left")
    return out.select("month", "first_day", (F.coalesce("quiet", F.lit(0)) + 1).cast("long").alias("start_day"))


@register("close_cycle_start_backtrack_v1", """
WITH d AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, day(o_orderdate) AS d, avg((date_trunc('month', o_orderdate + INTERVAL 9 DAY) <> date_trunc('month', o_orderdate))::INT) AS p, count(*) AS n FROM orders GROUP BY ALL),
f AS (SELECT m, min(d) AS f FROM d WHERE p >= 0.5 GROUP BY m), q AS (SELECT m, quantile_cont(n, 0.5) AS mid FROM d GROUP BY m)
SELECT f.m AS month, f.f::BIGINT AS first_day, (coalesce(max(d.d) FILTER (d.d < f.f AND d.n <= q.mid), 0) + 1)::BIGINT AS start_day FROM f JOIN q ON q.m = f.m LEFT JOIN d ON d.m = f.m GROUP BY f.m, f.f""")
def _backtrack(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    days = orders.groupBy(F.trunc("o_orderdate", "month").alias("month"), F.dayofmonth("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return backtrack(close_spans(orders, "o_orderdate", F.trunc(F.date_add("o_orderdate", 9), "month")), days)


# Contracts and donations


def timing(left: DataFrame, right: DataFrame, key: str, time: str, least: int = 3) -> DataFrame:
    """Mean distance in days of a key's left rows to its nearest right one, against uniform times over the whole span: what
    permutations estimate, in closed form. Between right times a uniform time is a quarter of the gap away on average, at the
    ends half of the rest; z and p from the second moments."""
    day = F.unix_micros(F.col(time).cast("timestamp")) / 86_400_000_000
    l, r = left.select(F.col(key).alias("k"), day.alias("t")).where("k IS NOT NULL AND t IS NOT NULL"), right.select(F.col(key).alias("k"), day.alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    span = l.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).unionByName(r.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = Window.partitionBy("k").orderBy("t")
    both = l.withColumn("side", F.lit(1)).unionByName(r.withColumn("side", F.lit(0)))
    last = F.max(F.when(F.col("side") == 0, F.col("t"))).over(own.rangeBetween(Window.unboundedPreceding, 0))
    nxt = F.min(F.when(F.col("side") == 0, F.col("t"))).over(own.rangeBetween(0, Window.unboundedFollowing))
    near = both.select("k", "side", F.least(F.col("t") - last, nxt - F.col("t")).alias("d")).where("side = 1 AND d IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.avg("d").alias("seen"))
    gaps = r.withColumn("g", F.col("t") - F.lag("t").over(own)).crossJoin(F.broadcast(span)).groupBy("k", "lo", "hi").agg(F.sum(F.col("g") ** 2 / 4).alias("g2"), F.sum(F.col("g") ** 3 / 12).alias("g3"), F.min("t").alias("a"), F.max("t").alias("b"))
    head, tail = F.col("a") - F.col("lo"), F.col("hi") - F.col("b")
    width = F.col("hi") - F.col("lo")
    mean = (F.coalesce("g2", F.lit(0.0)) + head**2 / 2 + tail**2 / 2) / width
    square = (F.coalesce("g3", F.lit(0.0)) + head**3 / 3 + tail**3 / 3) / width
    told = near.where(F.col("n") >= least).join(gaps, "k").where("hi > lo").select("k", "n", "seen", mean.alias("mean"), (square - mean * mean).alias("var"))
    z = (F.col("mean") - F.col("seen")) / F.sqrt(F.col("var") / F.col("n"))
    return told.select("k", "n", F.round("seen", 6).alias("mean_days"), F.round("mean", 6).alias("expected_days"), F.round(1 - F.col("seen") / F.col("mean"), 6).alias("effect"), F.round(normal_sf(z), 5).alias("p_value"))


TIMING = """WITH l AS (SELECT o_custkey AS k, epoch_us(o_orderdate) / 86400000000.0 AS t FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT o_custkey AS k, epoch_us(o_orderdate) / 86400000000.0 AS t FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'),
s AS (SELECT min(t) AS lo, max(t) AS hi FROM (SELECT t FROM l UNION ALL SELECT t FROM r)),
d AS (SELECT l.k, l.t, min(abs(l.t - r.t)) AS d FROM (SELECT *, row_number() OVER () AS i FROM l) l JOIN r ON r.k = l.k GROUP BY l.k, l.t, l.i), n AS (SELECT k, count(*) AS n, avg(d) AS seen FROM d GROUP BY k HAVING count(*) >= 3),
g AS (SELECT k, t, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS g FROM r),
m AS (SELECT k, (coalesce(sum(g * g / 4), 0) + power(min(t) - lo, 2) / 2 + power(hi - max(t), 2) / 2) / (hi - lo) AS mean, (coalesce(sum(g * g * g / 12), 0) + power(min(t) - lo, 3) / 3 + power(hi - max(t), 3) / 3) / (hi - lo) AS sq FROM g, s GROUP BY k, lo, hi),
z AS (SELECT k, n, seen, mean, (mean - seen) / sqrt((sq - mean * mean) / n) AS z FROM n JOIN m USING (k)),
t AS (SELECT k, n, round(seen, 6) AS mean_days, round(mean, 6) AS expected_days, round(1 - seen / mean, 6) AS effect, round(1 - """ + PHI.format("z") + """, 5) AS p_value FROM z)
"""


def _timing_rows(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    return timing(orders.where("o_orderpriority = '1-URGENT'"), orders.where("o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'"), "o_custkey", "o_orderdate")


@register("vendor_politician_timing_permutation_v1", TIMING + "SELECT * FROM t")
def _timing(spark, sf_dir):
    return _timing_rows(spark, sf_dir)


@register("red_flags_refined_v1", TIMING + """,
b AS (SELECT o_custkey AS k, max(c) AS bundle FROM (SELECT o_custkey, o_orderdate, count(*) AS c FROM orders GROUP BY ALL) GROUP BY 1), y AS (SELECT o_custkey AS k, max(s) AS most FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS s FROM orders GROUP BY ALL) GROUP BY 1)
SELECT k, p_value, effect, bundle, round(least(1, most / 1000000), 6) AS pressure, round((1 - p_value) * greatest(0, effect) + 0.1 * (bundle - 1) + least(1, most / 1000000), 5) AS score FROM t JOIN b USING (k) JOIN y USING (k) WHERE p_value <= 0.1 AND effect >= 0.2""")
def _flags(spark, sf_dir):
    """Customers with close timing, scored with their largest bundle of one day and their pressure on a yearly limit."""
    orders = _read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    bundle = orders.groupBy("k", "o_orderdate").agg(F.count("*").alias("c")).groupBy("k").agg(F.max("c").alias("bundle"))
    most = orders.groupBy("k", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s")).groupBy("k").agg(F.max("s").alias("most"))
    pressure = F.least(F.lit(1.0), F.col("most") / 1_000_000)
    rows = _timing_rows(spark, sf_dir).where("p_value <= 0.1 AND effect >= 0.2").join(bundle, "k").join(most, "k")
    score = (1 - F.col("p_value")) * F.greatest(F.lit(0.0), F.col("effect")) + 0.1 * (F.col("bundle") - 1) + pressure
    return rows.select("k", "p_value", "effect", "bundle", F.round(pressure, 6).alias("pressure"), F.round(score, 5).alias("score"))


# Columns, roles and plans

#: Name tokens that tell of a role.
ROLE_TOKENS = {
    "process": ("process", "activity", "event", "type", "step", "task"), "time": ("ts", "time", "date", "dt", "timestamp"), "case": ("case", "user", "session", "order", "cust"),
    "host": ("host", "server", "node", "machine"), "value": ("value", "amount", "duration", "price", "total"), "id": ("id", "key", "number"), "params": ("params", "props", "descr", "json"),
}


def role_scores(df: DataFrame) -> DataFrame:
    """Columns with the role they look like and a score: two for a name token, one for each property that fits (a timestamp, a
    number, unique or repeated values). One aggregate job over all rows; distinct values by sketch."""
    kinds = dict(df.dtypes)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.count(F.col(f"`{c}`")).alias("n"), F.approx_count_distinct(F.col(f"`{c}`")).alias("distinct")) for c in df.columns]
    told = df.agg(F.count("*").alias("rows"), F.array(*parts).alias("p")).select("rows", F.explode("p").alias("p")).select("rows", "p.*")
    words = F.split(F.lower(F.regexp_replace("column", "([a-z])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    number, stamp = F.col("dtype").rlike("int|double|float|decimal|long"), F.col("dtype").rlike("timestamp|date")
    unique = F.col("distinct") >= 0.9 * F.col("rows")
    fits = {"process": (~number & ~stamp & (F.col("distinct") <= 0.2 * F.col("rows"))), "time": stamp, "case": (~stamp & ~unique), "host": (~stamp & ~unique), "value": number, "id": unique & ~stamp, "params": F.col("dtype") == "string"}
    scores = F.array(*[F.struct((F.arrays_overlap(words, F.array(*[F.lit(t) for t in tokens])).cast("int") * 2 + fits[role].cast("int")).alias("score"), F.lit(role).alias("role")) for role, tokens in ROLE_TOKENS.items()])
    best = F.array_max(scores)
    return told.select("column", "dtype", F.when(best["score"] >= 2, best["role"]).alias("role"), best["score"].cast("double").alias("score"), "rows")


@register("profile_eventlog")
def _roles(spark, sf_dir):
    return role_scores(_read(spark, sf_dir, "events"))


#: What families of operators need of a table.
NEEDS = {"queueing": {"process", "time", "case"}, "control_charts": {"time", "value"}, "drift": {"time", "value"}, "process_mining": {"process", "time", "case"}, "parameters": {"params"}, "dependence": {"value"}, "hosts": {"host", "time"}}


def plan_for(roles: DataFrame) -> DataFrame:
    """Families of operators with whether a table has the roles they need, and which are missing."""
    have = roles.where("role IS NOT NULL").agg(F.collect_set("role").alias("have"))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(x) for x in sorted(need)]).alias("need")) for f, need in NEEDS.items()]))
    told = have.select("have", rows.alias("r"))
    missing = F.array_except("r.need", "have")
    return told.select("r.family", (F.size(missing) == 0).alias("selected"), F.array_join(missing, ",").alias("missing"))


@register("planner_basic")
def _plan(spark, sf_dir):
    return plan_for(role_scores(_read(spark, sf_dir, "events")))


def sql_pack(schema: DataFrame, table: str) -> DataFrame:
    """Read-only SQL for each column of a schema (column, dtype): counts, and ranges or commonest values by kind."""
    number = F.col("dtype").rlike("int|double|float|decimal|long|timestamp|date")
    return schema.select(
        F.col("column").alias("intent"),
        F.when(number, F.format_string(f"SELECT count(*) AS n, min(`%s`) AS low, max(`%s`) AS high FROM {table}", "column", "column"))
        .otherwise(F.format_string(f"SELECT `%s` AS v, count(*) AS n FROM {table} GROUP BY 1 ORDER BY n DESC, v LIMIT 10", "column")).alias("sql"),
    )


@register("transform_sql_intents_pack_v1")
def _pack(spark, sf_dir):
    return sql_pack(role_scores(_read(spark, sf_dir, "events")).select("column", "dtype"), "quarrystat_events")


def materialize_pack(spark, pack: list[tuple[str, str]], max_rows: int = 1000) -> DataFrame:
    """Each statement of a pack through the guard: rows (intent, statement_id, status, n, rows as JSON)."""
    from quarrystat.functions.guard import guarded_sql, statement_id

    out = None
    for intent, sql in pack:
        try:
            found = guarded_sql(spark, sql, max_rows)
            row = found.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*found.columns)))), "\n").alias("rows"))
            row = row.select(F.lit(intent).alias("intent"), F.lit(statement_id(sql)).alias("statement_id"), F.lit("ok").alias("status"), "n", "rows")
        except Exception as e:  # the statement's own fault is part of the manifest
            row = spark.createDataFrame([(intent, statement_id(sql), f"error: {type(e).__name__}", None, None)], "intent string, statement_id string, status string, n long, rows string")
        out = row if out is None else out.unionByName(row)
    return out


@register("transform_sqlpack_materialize_v1")
def _materialized(spark, sf_dir):
    """The pack of the event log, run read-only over a view of it; one statement a column of its schema."""
    _read(spark, sf_dir, "events").createOrReplaceTempView("quarrystat_events")
    pack = [(r["intent"], r["sql"]) for r in sql_pack(role_scores(spark.table("quarrystat_events")).select("column", "dtype"), "quarrystat_events").collect()]
    return materialize_pack(spark, pack)


def entity_map(names: DataFrame) -> DataFrame:
    """Entities of organisation names (role, name): normal form, how many spellings, which roles, an example."""
    from quarrystat.functions.text import normal_organisation

    rows = names.where("name IS NOT NULL").select("role", "name", normal_organisation(F.col("name")).alias("entity")).where("entity <> ''")
    return rows.groupBy("entity").agg(F.count_distinct("name").alias("alias_count"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("rows"), F.min("name").alias("example"))


@register("transform_entity_resolution_map_v1", """
WITH n AS (SELECT 'part' AS role, p_name AS name FROM part UNION ALL SELECT 'segment', c_mktsegment || ' & Co.' FROM customer UNION ALL SELECT 'segment', lower(c_mktsegment) || ' and company' FROM customer),
e AS (SELECT role, name, trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(upper(trim(name)), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '( (INC|LLC|LTD|CORP|CORPORATION|CO|COMPANY|GMBH|PLC))+$', '')) AS entity FROM n)
SELECT entity, count(DISTINCT name) AS alias_count, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS rows, min(name) AS example FROM e WHERE entity <> '' GROUP BY entity""")
def _entities(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer")
    names = _read(spark, sf_dir, "part").select(F.lit("part").alias("role"), F.col("p_name").alias("name"))
    names = names.unionByName(customers.select(F.lit("segment").alias("role"), F.concat("c_mktsegment", F.lit(" & Co.")).alias("name")))
    return entity_map(names.unionByName(customers.select(F.lit("segment").alias("role"), F.concat(F.lower("c_mktsegment"), F.lit(" and company")).alias("name"))))


def to_template(df: DataFrame, mapping: dict[str, str], fields: list[str]) -> DataFrame:
    """Columns mapped to a template's fields as strings, missing fields null, with the row's other columns left out."""
    back = {field: column for column, field in mapping.items()}
    return df.select(*[(F.col(f"`{back[f]}`").cast("string") if f in back else F.lit(None).cast("string")).alias(f) for f in fields])


@register("transform_template", "SELECT event_type AS process, user_id::VARCHAR AS case_id, NULL::VARCHAR AS host, count(*) AS rows FROM events GROUP BY ALL")
def _template(spark, sf_dir):
    rows = to_template(_read(spark, sf_dir, "events"), {"event_type": "process", "user_id": "case_id"}, ["process", "case_id", "host"])
    return rows.groupBy("process", "case_id", "host").agg(F.count("*").alias("rows"))


@register("log_template_drain", "SELECT regexp_replace(regexp_replace(event_type || ' ' || props, '0x[0-9a-fA-F]+', '<hex>', 'g'), '[0-9]+', '<num>', 'g') AS template, count(*) AS n, min(event_type || ' ' || props) AS example FROM events GROUP BY 1")
def _drain(spark, sf_dir):
    from quarrystat.functions.text import mask

    rows = _read(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", "props").alias("m"))
    return rows.groupBy(mask(F.col("m")).alias("template")).agg(F.count("*").alias("n"), F.min("m").alias("example"))


def anonymised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the named columns as short hashes and personal data inside all other strings redacted, a JSON text a row."""
    from quarrystat.functions.text import redact

    kinds = dict(df.dtypes)
    out = [F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 12).alias(c) if c in columns else redact(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*out)).alias("prompt"))


@register("llm_prompt_builder", "SELECT '{\"event_type\":\"' || event_type || '\",\"user_id\":\"' || substr(sha256(user_id::VARCHAR), 1, 12) || '\",\"n\":' || count(*) || '}' AS prompt FROM events GROUP BY event_type, user_id")
def _prompts(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return anonymised(rows, ["user_id"])


