"""Two-sample and association tests with p-values, ranked and queueing scores, as functions of DataFrames with SQL written apart.

Windows run over the distinct values, days or categories of a key, after rows were counted; ranks come from those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.functions.pvalues import chi2_sf, kolmogorov_sf, normal_sf, two_sided
from quarrystat.plans.halves import early_half
from quarrystat.plans.registry import register

#: DuckDB's side of the tails: series that share nothing with the fits used here.
PHI = "(0.5 + {0} * (SELECT sum(power(-1, k) * power({0} * {0} / 2, k) / (gamma(k + 1) * (2 * k + 1))) FROM range(0, 120) r(k)) / sqrt(2 * pi()))"
HALF = "WITH o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS every FROM events), e AS (SELECT *, (rn <= every // 2) AS early FROM o)"
AGREE = HALF + """,
c AS (SELECT event_type AS key, value AS x, sum(early::INT) AS a, sum((NOT early)::INT) AS b FROM e GROUP BY ALL),
n AS (SELECT key, sum(a) AS n1, sum(b) AS n2 FROM c GROUP BY key)"""


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def status(n: Column, least: int) -> Column:
    return F.when(n >= least, F.lit("ok")).otherwise(F.lit("na"))


def half_counts(df: DataFrame, time: str, tie: str, key: str, value: str) -> DataFrame:
    """Rows (key, x, a, b): how often a value occurs in the early and the late half."""
    rows = early_half(df, [time, tie]).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(F.col(key).alias("key"), F.col(value).alias("x")).agg(F.sum("early").alias("a"), F.sum(1 - F.col("early")).alias("b"))


def _cumulated(counts: DataFrame) -> DataFrame:
    own, upto = Window.partitionBy("key"), Window.partitionBy("key").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("*", F.sum("a").over(own).alias("n1"), F.sum("b").over(own).alias("n2"), F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"))


def ks_test(counts: DataFrame, least: int = 20) -> DataFrame:
    """Kolmogorov-Smirnov statistic of the halves and its asymptotic p."""
    told = _cumulated(counts).groupBy("key", "n1", "n2").agg(F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))).alias("d"))
    lam = F.col("d") * F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    return told.select("key", (F.col("n1") + F.col("n2")).alias("n"), F.round("d", 9).alias("statistic"), F.round(kolmogorov_sf(lam), 6).alias("p_value"), status(F.least("n1", "n2"), least).alias("status"))


KS = AGREE + """,
f AS (SELECT key, n1, n2, abs(sum(a) OVER w / n1 - sum(b) OVER w / n2) AS d FROM c JOIN n USING (key) WINDOW w AS (PARTITION BY key ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT key, n1, n2, max(d) AS d, max(d) * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM f GROUP BY key, n1, n2),
p AS (SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE (SELECT sum(2 * power(-1, k - 1) * exp(-2 * k * k * lam * lam)) FROM range(1, 101) r(k)) END AS p FROM d)"""


@register("two_sample_numeric_ks", KS + "SELECT key, (n1 + n2)::BIGINT AS n, round(d, 9) AS statistic, round(least(1, greatest(0, p)), 6) AS p_value, CASE WHEN least(n1, n2) >= 20 THEN 'ok' ELSE 'na' END AS status FROM p")
def _ks(spark, sf_dir):
    return ks_test(half_counts(_events(spark, sf_dir), "ts", "event_id", "event_type", "value"))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """Column q: the smallest p · m / rank over the tests at least as weak; one row a test, so one task orders the tests."""
    m = Window.partitionBy()
    ranked = df.withColumn("_q", F.col(p) * F.count(p).over(m) / F.rank().over(Window.orderBy(F.col(p).asc_nulls_last())))
    return ranked.withColumn("q_value", F.least(F.lit(1.0), F.min("_q").over(Window.orderBy(F.col(p).desc_nulls_first())))).drop("_q")


@register("multiple_testing_fdr", KS + """, q AS (SELECT *, round(least(1, greatest(0, p)), 6) AS pv FROM p), r AS (SELECT *, pv * count(*) OVER () / rank() OVER (ORDER BY pv) AS raw FROM q)
SELECT key, round(d, 9) AS statistic, pv AS p_value, round(least(1, min(raw) OVER (ORDER BY pv DESC)), 6) AS q_value FROM r""")
def _fdr(spark, sf_dir):
    out = benjamini_hochberg(ks_test(half_counts(_events(spark, sf_dir), "ts", "event_id", "event_type", "value")), "p_value")
    return out.select("key", "statistic", "p_value", F.round("q_value", 6).alias("q_value"))


def mann_whitney(counts: DataFrame, least: int = 20) -> DataFrame:
    """U of the early half with average ranks, and the two-sided normal p corrected for ties."""
    c = _cumulated(counts)
    t = F.col("a") + F.col("b")
    rank = F.col("ca") + F.col("cb") - t + (t + 1) / 2
    told = c.groupBy("key", "n1", "n2").agg(F.sum(F.col("a") * rank).alias("r"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = (F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5) / F.sqrt(var)
    return told.select("key", n.alias("n"), F.round(u, 1).alias("u"), F.round(two_sided(F.greatest(z, F.lit(0.0))), 6).alias("p_value"), status(F.least("n1", "n2"), least).alias("status"))


@register("two_sample_numeric_mann_whitney", HALF + f""",
r AS (SELECT event_type AS key, early, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY event_type, value) AS t FROM e),
u AS (SELECT key, count(*) AS n, sum(early::INT)::DOUBLE AS n1, sum((NOT early)::INT)::DOUBLE AS n2, sum(r) FILTER (early) AS s, sum(t * t - 1.0) AS ties FROM r GROUP BY key),
z AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u, (abs(s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1.0)))) AS z FROM u)
SELECT key, n, round(u, 1) AS u, round(least(1, 2 * (1 - {PHI.format('greatest(z, 0)')})), 6) AS p_value, CASE WHEN least(n1, n2) >= 20 THEN 'ok' ELSE 'na' END AS status FROM z""")
def _mw(spark, sf_dir):
    return mann_whitney(half_counts(_events(spark, sf_dir), "ts", "event_id", "event_type", "value"))


def chi2_test(cells: DataFrame, least: int = 20) -> DataFrame:
    """Pearson's χ² of a table of counts (a, b, n) with all its cells, degrees of freedom, p and Cramér's V.

    Empty cells need no rows: over the cells that have rows, Σ(O−E)²/E = Σ O²/E − N."""
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("every"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    x = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n") / F.col("na") * F.col("n") / F.col("nb")).alias("s"))
    both = x.crossJoin(F.broadcast(total))
    stat, df = F.col("every") * (F.col("s") - 1), (F.col("ka") - 1) * (F.col("kb") - 1)
    v = F.sqrt(F.greatest(stat, F.lit(0.0)) / (F.col("every") * F.nullif(F.least("ka", "kb") - 1, F.lit(0))))
    return both.select(F.col("every").alias("n"), F.round(stat, 6).alias("chi2"), df.alias("df"), F.round(chi2_sf(stat, df), 6).alias("p_value"), F.round(v, 9).alias("cramers_v"), status(F.col("every"), least).alias("status"))


CHI2 = """,
x AS (SELECT sum(power(coalesce(o, 0) - e, 2) / e) AS s FROM (SELECT r.a, q.b, r.n * q.n / (SELECT sum(n) FROM t) AS e FROM (SELECT a, sum(n) AS n FROM t GROUP BY a) r, (SELECT b, sum(n) AS n FROM t GROUP BY b) q) g LEFT JOIN (SELECT a, b, n AS o FROM t) USING (a, b)),
k AS (SELECT s, sum(n)::BIGINT AS n, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM t, x GROUP BY s)
SELECT n, round(s, 6) AS chi2, df, round(1 - exp(-s / 2 + df / 2.0 * ln(s / 2)) * (SELECT sum(exp(j * ln(s / 2) - lgamma(df / 2.0 + j + 1))) FROM range(0, 400) r(j)), 6) AS p_value,
       round(sqrt(s / (n * (least(ka, kb) - 1))), 9) AS cramers_v, CASE WHEN n >= 20 THEN 'ok' ELSE 'na' END AS status FROM k"""


@register("chi_square_association", "WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL)" + CHI2)
def _association(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return chi2_test(rows.groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n")))


@register("hardy_weinberg_param_coupling_v1", "WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL)" + CHI2)
def _hardy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return chi2_test(rows.groupBy(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count("*").alias("n")))


@register("two_sample_categorical_chi2", HALF + ", t AS (SELECT event_type AS a, early AS b, count(*) AS n FROM e GROUP BY ALL)" + CHI2)
def _categorical(spark, sf_dir):
    halves = early_half(_events(spark, sf_dir), ["ts", "event_id"])
    return chi2_test(halves.groupBy(F.col("event_type").alias("a"), F.col("early").alias("b")).agg(F.count("*").alias("n")))


def mann_kendall(df: DataFrame, time: str, key: str, value: str, least: int = 10) -> DataFrame:
    """Kendall's S of daily means, z and p corrected for ties, and Sen's slope; pairs are of days, at most the days squared."""
    rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.to_date(time).alias("d")).agg(F.round(F.avg(value), 9).alias("v"))
    days = rows.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("d")))
    ties = days.groupBy("key", "v").agg(F.count("*").alias("t")).groupBy("key").agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("w"))
    a, b = days.selectExpr("key", "i", "v"), days.selectExpr("key", "i AS j", "v AS w")
    pairs = a.join(b, "key").where("i < j").groupBy("key").agg(F.sum(F.signum(F.col("w") - F.col("v"))).alias("s"), F.percentile((F.col("w") - F.col("v")) / (F.col("j") - F.col("i")), 0.5).alias("slope"))
    both = pairs.join(ties, "key")
    sd = F.sqrt((F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - both["w"]) / 18)
    z = F.when(F.col("s") > 0, F.col("s") - 1).when(F.col("s") < 0, F.col("s") + 1).otherwise(F.lit(0.0)) / sd
    return both.select("key", "n", F.col("s").cast("long").alias("s"), F.round(z, 6).alias("z"), F.round(two_sided(z), 6).alias("p_value"), F.round("slope", 6).alias("sen_slope"), status(F.col("n"), least).alias("status"))


@register("mann_kendall_trend_test_v1", f"""
WITH d AS (SELECT event_type AS key, ts::DATE AS d, round(avg(value), 9) AS v FROM events GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d) AS i FROM d),
t AS (SELECT key, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS w FROM (SELECT key, v, count(*) AS c FROM d GROUP BY ALL) GROUP BY key),
p AS (SELECT a.key, sum(sign(b.v - a.v)) AS s, quantile_cont((b.v - a.v) / (b.i - a.i), 0.5) AS slope FROM i a JOIN i b ON a.key = b.key AND a.i < b.i GROUP BY a.key),
z AS (SELECT *, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - w) / 18.0) AS z FROM p JOIN t USING (key))
SELECT key, n::BIGINT AS n, s::BIGINT AS s, round(z, 6) AS z, round(least(1, 2 * (1 - {PHI.format('abs(z)')})), 6) AS p_value, round(slope, 6) AS sen_slope, CASE WHEN n >= 10 THEN 'ok' ELSE 'na' END AS status FROM z""")
def _kendall(spark, sf_dir):
    return mann_kendall(_events(spark, sf_dir), "ts", "event_type", "value")


def welch(df: DataFrame, group: str, value: str, least: int = 30) -> DataFrame:
    """Each group against all other rows: t of unequal variances and its p for large samples, with Benjamini-Hochberg q."""
    g = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("key")).agg(F.count("*").cast("double").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    both = g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))))
    m, v = lambda n, s: s / n, lambda n, s, q: (q - s * s / n) / (n - 1)
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    n2, s2, q2 = F.col("all_n") - n, F.col("all_s") - s, F.col("all_q") - q
    t = (m(n, s) - m(n2, s2)) / F.sqrt(v(n, s, q) / n + v(n2, s2, q2) / n2)
    ok = both.where(F.least(n, n2) >= least).select("key", n.cast("long").alias("n"), F.round(m(n, s) - m(n2, s2), 6).alias("delta"), F.round(t, 5).alias("t"), F.round(two_sided(t), 6).alias("p_value"))
    return benjamini_hochberg(ok, "p_value").withColumn("q_value", F.round("q_value", 6))


@register("ttests_auto", f"""
WITH g AS (SELECT DISTINCT l_returnflag AS key FROM lineitem),
s AS (SELECT key, count(*) FILTER (l_returnflag = key) AS n, avg(l_quantity) FILTER (l_returnflag = key) AS a, avg(l_quantity) FILTER (l_returnflag <> key) AS b,
      var_samp(l_quantity) FILTER (l_returnflag = key) / count(*) FILTER (l_returnflag = key) + var_samp(l_quantity) FILTER (l_returnflag <> key) / count(*) FILTER (l_returnflag <> key) AS v FROM lineitem, g GROUP BY key),
p AS (SELECT key, n, a - b AS d, (a - b) / sqrt(v) AS t FROM s), q AS (SELECT *, round(least(1, 2 * (1 - {PHI.format('abs(t)')})), 6) AS pv FROM p), r AS (SELECT *, pv * count(*) OVER () / rank() OVER (ORDER BY pv) AS raw FROM q)
SELECT key, n, round(d, 6) AS delta, round(t, 5) AS t, pv AS p_value, round(least(1, min(raw) OVER (ORDER BY pv DESC)), 6) AS q_value FROM r""")
def _welch(spark, sf_dir):
    return welch(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_quantity")


# Scores


def rarefaction(df: DataFrame, kind: Column, ids: list[str], points: int = 50, seed: int = 42, least: int = 20) -> DataFrame:
    """Kinds met in growing seeded shares of the rows. A row's place is its hash, so a kind is met at the smallest hash of its
    rows: one aggregate instead of a shuffled order."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])), 1, 8), 16, 10).cast("long") / 2**32
    first = df.where(kind.isNotNull()).groupBy(kind.alias("kind")).agg(F.min(place).alias("p"), F.count("*").alias("c"))
    told = first.agg(F.count("*").alias("total_unique"), F.sum("c").alias("n"), F.avg((F.col("p") < 0.5).cast("double")).alias("half"), F.array_sort(F.collect_list(F.ceil(F.col("p") * points))).alias("at"))
    return told.select("n", "total_unique", F.round("half", 9).alias("coverage_at_half"), F.when(F.col("half") > 0.9, "saturated").when(F.col("half") < 0.6, "open").otherwise("partial").alias("curve"), status(F.col("n"), least).alias("status"))


@register("rarefaction_coverage_v1", """
WITH p AS (SELECT event_type || '/' || floor(value / 50)::BIGINT AS kind, ('0x' || substr(md5('42|' || event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS p FROM events),
f AS (SELECT kind, min(p) AS p, count(*) AS c FROM p GROUP BY kind)
SELECT sum(c)::BIGINT AS n, count(*) AS total_unique, round(avg((p < 0.5)::INT), 9) AS coverage_at_half, CASE WHEN avg((p < 0.5)::INT) > 0.9 THEN 'saturated' WHEN avg((p < 0.5)::INT) < 0.6 THEN 'open' ELSE 'partial' END AS curve,
       CASE WHEN sum(c) >= 20 THEN 'ok' ELSE 'na' END AS status FROM f""")
def _rarefaction(spark, sf_dir):
    return rarefaction(_events(spark, sf_dir), F.concat_ws("/", "event_type", F.floor(F.col("value") / 50)), ["event_id"])


def binned_rank_slope(df: DataFrame, value: str, width: float, least: int = 20) -> DataFrame:
    """Slope of log rank on log value, ranks being those of bins of values, weighted by their rows."""
    x = F.floor(F.col(value) / width) * width + width / 2
    bins = df.where(F.col(value) > 0).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    ranked = bins.withColumn("r", F.sum("n").over(Window.orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)) - (F.col("n") - 1) / 2)
    lx, lr, w = F.log("x"), F.log("r"), F.col("n")
    told = ranked.agg(F.sum(w).alias("n"), F.sum(w * lx).alias("sx"), F.sum(w * lr).alias("sy"), F.sum(w * lx * lx).alias("sxx"), F.sum(w * lx * lr).alias("sxy"))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") ** 2 / F.col("n"))
    return told.select("n", F.round(slope, 6).alias("exponent"), status(F.col("n"), least).alias("status"))


@register("stevens_power_law_severity_v1", """
WITH b AS (SELECT floor(o_totalprice / 1000) * 1000 + 500 AS x, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1),
r AS (SELECT ln(x) AS x, ln((SELECT sum(n) FROM b c WHERE c.x > b.x) + (n + 1) / 2.0) AS y, n FROM b WHERE EXISTS (SELECT 1 FROM b c WHERE c.x > b.x) UNION ALL SELECT ln(x), ln((n + 1) / 2.0), n FROM b WHERE x = (SELECT max(x) FROM b)),
m AS (SELECT sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my, sum(n) AS n FROM r)
SELECT any_value(m.n)::BIGINT AS n, round(sum(r.n * (x - mx) * (y - my)) / sum(r.n * (x - mx) * (x - mx)), 6) AS exponent, 'ok' AS status FROM r, m""")
def _stevens(spark, sf_dir):
    return binned_rank_slope(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 1000.0)


def error_by_load(df: DataFrame, load: str, error: Column, bins: int = 10, least: int = 20) -> DataFrame:
    """Error rate by bins of load between its distinct quantiles, and the load at the largest rise."""
    cuts = df.agg(F.array_distinct(F.percentile(F.col(load), F.lit([i / bins for i in range(bins + 1)]))).alias("q"), F.count(load).alias("n"))
    inner = F.slice("q", F.lit(2), F.greatest(F.size("q") - 2, F.lit(0)))
    place = F.aggregate(inner, F.lit(0), lambda a, c: a + (F.col(load) >= c).cast("int"))
    rows = df.where(F.col(load).isNotNull() & error.isNotNull()).crossJoin(F.broadcast(cuts)).withColumn("bin", place)
    told = rows.groupBy("bin", "n").agg(F.min(load).alias("low"), F.avg(error.cast("double")).alias("rate"), F.count("*").alias("c"))
    jump = F.col("rate") - F.lag("rate").over(Window.orderBy("bin"))
    return told.select(F.col("bin").cast("long").alias("bin"), F.col("low").cast("double").alias("load_from"), F.col("c").alias("rows"), F.round("rate", 9).alias("rate"), F.round(jump, 9).alias("jump"), status(F.col("n"), least).alias("status"))


@register("cognitive_load_concurrency_v1", """
WITH o AS (SELECT l_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS load, (l_discount > 0.08)::INT AS e FROM lineitem),
q AS (SELECT list_sort(list_distinct(quantile_cont(load, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS q, count(*) AS n FROM o),
b AS (SELECT len(list_filter(q[2:-2], lambda c: load >= c)) AS bin, load, e, n FROM o, q), t AS (SELECT bin, n, min(load) AS low, avg(e) AS rate, count(*) AS c FROM b GROUP BY ALL)
SELECT bin::BIGINT AS bin, low::DOUBLE AS load_from, c AS rows, round(rate, 9) AS rate, round(rate - lag(rate) OVER (ORDER BY bin), 9) AS jump, 'ok' AS status FROM t""")
def _cognitive(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("load", F.count("*").over(Window.partitionBy("l_orderkey")))
    return error_by_load(rows, "load", F.col("l_discount") > 0.08)


def vut(df: DataFrame, case: list[str], time: str, tie: str, key: str, service: str, least: int = 30) -> DataFrame:
    """Kingman's parts by key: variability (ca² + cs²) / 2, utilisation ρ / (1 − ρ), and service time; gaps are within a case."""
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(Window.partitionBy(*case).orderBy(time, tie))) / 1e6
    rows = df.withColumn("gap", gap).where("gap IS NOT NULL")
    told = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.avg("gap").alias("ma"), F.var_pop("gap").alias("va"), F.avg(service).alias("ms"), F.var_pop(service).alias("vs"))
    rho = F.col("ms") / F.col("ma")
    v, u = (F.col("va") / F.col("ma") ** 2 + F.col("vs") / F.col("ms") ** 2) / 2, F.when(rho < 1, rho / (1 - rho))
    return told.select("key", "n", F.round(v, 6).alias("variability"), F.round(u, 9).alias("utilisation"), F.round("ms", 6).alias("service"), F.round(v * u * F.col("ms"), 6).alias("wait"), status(F.col("n"), least).alias("status"))


@register("kingman_vut_decomposition_v1", """
WITH g AS (SELECT event_type AS key, value AS s, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS a FROM events),
m AS (SELECT key, count(*) AS n, avg(a) AS ma, power(stddev_pop(a) / avg(a), 2) AS ca, avg(s) AS ms, power(stddev_pop(s) / avg(s), 2) AS cs FROM g WHERE a IS NOT NULL GROUP BY key)
SELECT key, n, round((ca + cs) / 2, 6) AS variability, round((ms / ma) / (1 - ms / ma), 9) AS utilisation, round(ms, 6) AS service, round((ca + cs) / 2 * (ms / ma) / (1 - ms / ma) * ms, 6) AS wait, CASE WHEN n >= 30 THEN 'ok' ELSE 'na' END AS status FROM m""")
def _vut(spark, sf_dir):
    return vut(_events(spark, sf_dir), ["user_id"], "ts", "event_id", "event_type", "value")


def exergy(df: DataFrame, source: str, target: str, duration: str, key: str, case: list[str], order: list[str], least: int = 20) -> DataFrame:
    """Share of all durations that is neither retries (repeated edges at the median duration), nor idle (under the tenth
    percentile), nor switches of the key within a case (five per cent of all at their rate)."""
    rows = df.where(F.col(duration).isNotNull())
    told = rows.agg(F.count("*").alias("n"), F.sum(duration).alias("total"), F.percentile(duration, F.lit([0.1, 0.5])).alias("q"))
    idle = rows.crossJoin(F.broadcast(told)).agg(F.sum(F.when(F.col(duration) < F.col("q")[0], F.col(duration)).otherwise(0.0)).alias("idle"))
    again = df.groupBy(source, target).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("retries"))
    moved = df.withColumn("_p", F.lag(key).over(Window.partitionBy(*case).orderBy(*order))).where("_p IS NOT NULL").agg(F.avg((F.col("_p") != F.col(key)).cast("double")).alias("rate"))
    both = told.crossJoin(F.broadcast(idle)).crossJoin(F.broadcast(again)).crossJoin(F.broadcast(moved))
    retry, switch = F.col("retries") * F.col("q")[1], F.coalesce(F.col("rate"), F.lit(0.0)) * F.col("total") * 0.05
    useful = F.greatest(F.lit(0.0), F.col("total") - retry - F.col("idle") - switch)
    return both.select("n", F.round(retry, 4).alias("retry_waste"), F.round("idle", 4).alias("idle_waste"), F.round(switch, 4).alias("switch_waste"), F.round(useful / F.col("total"), 9).alias("exergy_ratio"), status(F.col("n"), least).alias("status"))


@register("exergy_waste_analysis_v1", """
WITH t AS (SELECT count(*) AS n, sum(value) AS s, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50 FROM events),
i AS (SELECT sum(value) AS idle FROM events, t WHERE value < p10), r AS (SELECT sum(c - 1) AS r FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type, ts::DATE)),
l AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), m AS (SELECT avg((p <> event_type)::INT) AS rate FROM l WHERE p IS NOT NULL)
SELECT n, round(r * p50, 4) AS retry_waste, round(idle, 4) AS idle_waste, round(rate * s * 0.05, 4) AS switch_waste, round(greatest(0, s - r * p50 - idle - rate * s * 0.05) / s, 9) AS exergy_ratio, CASE WHEN n >= 20 THEN 'ok' ELSE 'na' END AS status FROM t, i, r, m""")
def _exergy(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("target", F.concat_ws("/", "event_type", F.to_date("ts").cast("string")))
    return exergy(rows, "user_id", "target", "value", "event_type", ["user_id"], ["ts", "event_id"])


def competition(df: DataFrame, time: str, kind: str, chunks: int = 20) -> DataFrame:
    """The two commonest kinds: correlation of their counts over ``chunks`` runs of hours, and how far it is negative."""
    hours = df.where(F.col(time).isNotNull()).groupBy(F.col(kind).alias("k"), F.date_trunc("hour", time).alias("h")).agg(F.count("*").alias("n"))
    top = hours.groupBy("k").agg(F.sum("n").alias("s")).orderBy(F.col("s").desc(), "k").limit(2).agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "k"))).alias("t"))
    both = hours.crossJoin(F.broadcast(top)).groupBy("h", "t").agg(F.sum(F.when(F.col("k") == F.col("t")[0]["k"], F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("k") == F.col("t")[1]["k"], F.col("n")).otherwise(0)).alias("b"))
    cut = both.withColumn("c", F.ntile(chunks).over(Window.orderBy("h"))).groupBy("c", "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    told = cut.groupBy("t").agg((F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))).alias("r"))
    return told.select(F.col("t")[0]["k"].alias("type_a"), F.col("t")[1]["k"].alias("type_b"), F.round("r", 6).alias("correlation"), F.round(F.greatest(F.lit(0.0), -F.col("r")), 6).alias("competition_index"))


@register("lotka_volterra_competition_v1", """
WITH top AS (SELECT event_type AS k, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1 QUALIFY r <= 2),
h AS (SELECT date_trunc('hour', ts) AS h, count(*) FILTER (event_type = (SELECT k FROM top WHERE r = 1)) AS a, count(*) FILTER (event_type = (SELECT k FROM top WHERE r = 2)) AS b FROM events GROUP BY 1),
c AS (SELECT ntile(20) OVER (ORDER BY h) AS c, a, b FROM h), s AS (SELECT sum(a) AS a, sum(b) AS b FROM c GROUP BY c)
SELECT (SELECT k FROM top WHERE r = 1) AS type_a, (SELECT k FROM top WHERE r = 2) AS type_b, round(corr(a, b), 6) AS correlation, round(greatest(0, -corr(a, b)), 6) AS competition_index FROM s""")
def _lotka(spark, sf_dir):
    return competition(_events(spark, sf_dir), "ts", "event_type")


def hazard_ratios(df: DataFrame, group: str, duration: str, least: int = 10) -> DataFrame:
    """Hazard of each group against all rows, hazards being inverse mean durations."""
    g = df.where(F.col(duration) > 0).groupBy(F.col(group).cast("string").alias("key")).agg(F.count("*").alias("n"), F.sum(duration).alias("s"))
    return g.crossJoin(F.broadcast(g.agg((F.sum("s") / F.sum("n")).alias("m")))).select("key", "n", F.round(F.col("m") / (F.col("s") / F.col("n")), 9).alias("hazard_ratio"), status(F.col("n"), least).alias("status"))


@register("proportional_hazards_duration", "SELECT l_returnflag AS key, count(*) AS n, round((SELECT avg(l_quantity) FROM lineitem WHERE l_quantity > 0) / avg(l_quantity), 9) AS hazard_ratio, 'ok' AS status FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def _hazard(spark, sf_dir):
    return hazard_ratios(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_quantity")


def dprime(df: DataFrame, signal: Column, response: Column, key: str) -> DataFrame:
    """Log-linear hit and false-alarm rates by key, d' and criterion, the probit being the inverse of ``normal_sf`` by bisection."""

    def probit(p: Column) -> Column:
        step = lambda a, _: F.when(normal_sf((a["lo"] + a["hi"]) / 2) > 1 - p, F.struct(((a["lo"] + a["hi"]) / 2).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), ((a["lo"] + a["hi"]) / 2).alias("hi")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(F.lit(-8.0).alias("lo"), F.lit(8.0).alias("hi")), step, lambda a: (a["lo"] + a["hi"]) / 2)

    c = lambda x: F.sum(x.cast("long"))
    g = df.groupBy(F.col(key).alias("key")).agg(c(signal).alias("s"), c(~signal).alias("n"), c(signal & response).alias("hit"), c(~signal & response).alias("fa"))
    hit, fa = (F.col("hit") + 0.5) / (F.col("s") + 1), (F.col("fa") + 0.5) / (F.col("n") + 1)
    z = g.select("key", F.round(hit, 9).alias("hit_rate"), F.round(fa, 9).alias("false_alarm_rate"), probit(hit).alias("zh"), probit(fa).alias("zf"))
    return z.select("key", "hit_rate", "false_alarm_rate", F.round(F.col("zh") - F.col("zf"), 4).alias("dprime"), F.round(-(F.col("zh") + F.col("zf")) / 2, 4).alias("criterion"))


@register("signal_detection_dprime_v1", """
WITH g AS (SELECT event_type AS key, count(*) FILTER (event_id % 2 = 0) AS s, count(*) FILTER (event_id % 2 = 1) AS n, count(*) FILTER (event_id % 2 = 0 AND value > 40) AS h, count(*) FILTER (event_id % 2 = 1 AND value > 40) AS f FROM events GROUP BY 1),
p AS (SELECT key, (h + 0.5) / (s + 1.0) AS hr, (f + 0.5) / (n + 1.0) AS fr FROM g), grid AS (SELECT -4 + k * 0.0001 AS z FROM range(0, 80001) r(k)),
c AS (SELECT z, 0.5 + sum(exp(-z * z / 2) / sqrt(2 * pi()) * 0.0001) OVER (ORDER BY z) - 0.5 * exp(-z * z / 2) / sqrt(2 * pi()) * 0.0001 - 0.49996832875816688 AS p FROM grid),
q AS (SELECT key, hr, fr, (SELECT z + (hr - c.p) / (exp(-z * z / 2) / sqrt(2 * pi())) FROM c WHERE c.p <= hr ORDER BY c.p DESC LIMIT 1) AS zh, (SELECT z + (fr - c.p) / (exp(-z * z / 2) / sqrt(2 * pi())) FROM c WHERE c.p <= fr ORDER BY c.p DESC LIMIT 1) AS zf FROM p)
SELECT key, round(hr, 9) AS hit_rate, round(fr, 9) AS false_alarm_rate, round(zh - zf, 4) AS dprime, round(-(zh + zf) / 2, 4) AS criterion FROM q""")
def _dprime(spark, sf_dir):
    return dprime(_events(spark, sf_dir), F.col("event_id") % 2 == 0, F.col("value") > 40, "event_type")


def drift_suite(df: DataFrame, time: str, tie: str, key: str, value: str, categories: list[str], alpha: float = 0.05) -> DataFrame:
    """Early against late half: Kolmogorov-Smirnov of the value within each key and χ² of each category, with q-values over all
    tests of the suite."""
    numeric = ks_test(half_counts(df, time, tie, key, value)).select(F.concat(F.lit(f"{value}|"), "key").alias("test"), F.lit("ks").alias("kind"), "statistic", "p_value")
    halves = early_half(df, [time, tie])
    for c in categories:
        found = chi2_test(halves.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("a"), F.col("early").alias("b")).agg(F.count("*").alias("n")))
        numeric = numeric.unionByName(found.select(F.lit(c).alias("test"), F.lit("chi2").alias("kind"), F.col("chi2").alias("statistic"), "p_value"))
    out = benjamini_hochberg(numeric, "p_value")
    return out.select("test", "kind", "statistic", "p_value", F.round("q_value", 6).alias("q_value"), (F.col("q_value") <= alpha).alias("drifts"))


@register("distribution_drift_suite", KS + ", t AS (SELECT event_type AS a, early AS b, count(*) AS n FROM e GROUP BY ALL)" + CHI2.split("SELECT n, round(s, 6) AS chi2")[0] + """,
u AS (SELECT 'value|' || key AS test, 'ks' AS kind, round(d, 9) AS statistic, round(least(1, greatest(0, p)), 6) AS pv FROM p
      UNION ALL SELECT 'event_type', 'chi2', round(s, 6), round(1 - exp(-s / 2 + df / 2.0 * ln(s / 2)) * (SELECT sum(exp(j * ln(s / 2) - lgamma(df / 2.0 + j + 1))) FROM range(0, 400) r(j)), 6) FROM k),
r AS (SELECT *, pv * count(*) OVER () / rank() OVER (ORDER BY pv) AS raw FROM u), q AS (SELECT *, least(1, min(raw) OVER (ORDER BY pv DESC)) AS q FROM r)
SELECT test, kind, statistic, pv AS p_value, round(q, 6) AS q_value, q <= 0.05 AS drifts FROM q""")
def _suite(spark, sf_dir):
    return drift_suite(_events(spark, sf_dir), "ts", "event_id", "event_type", "value", ["event_type"])
