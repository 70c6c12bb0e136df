"""Event, digit, variant and queue operators as functions of a DataFrame with roles, each with SQL written apart from it.

Groups that a window or a list holds are cases, days, terms or digits, never a whole table: halves come from ``early_half``.
Results below an operator's minimum have status 'na'. Rows with null time, key or value don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.plans.halves import early_half
from quarrystat.plans.registry import register

DAY = "CAST(ts AS DATE)"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def status(n: Column, least: int) -> Column:
    return F.when(n >= least, F.lit("ok")).otherwise(F.lit("na"))


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def day_bursts(df: DataFrame, time: str, sigmas: float = 2.0) -> DataFrame:
    """Days whose number of events exceeds the mean by ``sigmas`` sample deviations."""
    days = df.where(F.col(time).isNotNull()).groupBy(F.date_trunc("day", time).alias("day")).agg(F.count("*").alias("n"))
    limits = days.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("s"))
    return days.crossJoin(F.broadcast(limits)).where(F.col("n") > F.col("m") + sigmas * F.col("s")).select("day", "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"))


@register("burst_detection_kleinberg", f"""
WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1),
l AS (SELECT avg(n) AS m, stddev_samp(n) AS s FROM d)
SELECT day, n, round(m, 6) AS mean, round(s, 6) AS std FROM d, l WHERE n > m + 2 * s""")
def _bursts(spark, sf_dir):
    return day_bursts(_events(spark, sf_dir), "ts")


def second_digits(df: DataFrame, value: str, least: int = 100) -> DataFrame:
    """Second significant digits against Benford's law: share, expected share, and χ² and mean absolute gap of all ten."""
    x = F.abs(F.col(value).cast("double"))
    # scientific form: the digit behind the point
    digit = F.substring(F.format_string("%.12e", x), 3, 1).cast("int")
    seen = df.where(x > 0).groupBy(digit.alias("digit")).agg(F.count("*").alias("c"))
    digits = df.sparkSession.range(10).select(
        F.col("id").cast("int").alias("digit"),
        F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0.0), lambda a, d: a + F.log10(1 + 1 / (10 * d + F.col("id")))).alias("expected"),
    )
    both = digits.join(F.broadcast(seen), "digit", "left").select("digit", "expected", F.coalesce("c", F.lit(0)).alias("c"))
    return _second(both, least)


def _second(both: DataFrame, least: int) -> DataFrame:
    total = both.agg(F.sum("c").alias("n"))
    rows = both.crossJoin(F.broadcast(total)).withColumn("gap", F.col("c") / F.col("n") - F.col("expected"))
    told = rows.agg(F.sum(F.col("n") * F.col("gap") ** 2 / F.col("expected")).alias("chi2"), F.avg(F.abs("gap")).alias("mad"))
    return rows.crossJoin(F.broadcast(told)).select(
        F.col("digit").cast("long").alias("digit"), F.col("c").alias("n"), F.round("expected", 9).alias("expected"),
        F.round("chi2", 5).alias("chi2"), F.round("mad", 9).alias("mad"), status(F.col("n"), least).alias("status"),
    )


@register("benford_second_digit_v1", """
WITH s AS (SELECT CAST(substr(printf('%.12e', abs(l_extendedprice)), 3, 1) AS BIGINT) AS digit FROM lineitem WHERE abs(l_extendedprice) > 0),
e AS (SELECT d2 AS digit, sum(log10(1 + 1.0 / (10 * d1 + d2))) AS expected FROM range(1, 10) a(d1), range(0, 10) b(d2) GROUP BY d2),
c AS (SELECT e.digit, expected, count(s.digit) AS c FROM e LEFT JOIN s USING (digit) GROUP BY ALL),
t AS (SELECT *, sum(c) OVER ()::BIGINT AS n, c / (sum(c) OVER ()) - expected AS gap FROM c)
SELECT digit::BIGINT AS digit, c AS n, round(expected, 9) AS expected, round(sum(n * gap * gap / expected) OVER (), 5) AS chi2,
       round(avg(abs(gap)) OVER (), 9) AS mad, CASE WHEN n >= 100 THEN 'ok' ELSE 'na' END AS status FROM t""")
def _benford2(spark, sf_dir):
    return second_digits(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice")


def hourly_means(df: DataFrame, time: str, key: str, value: str) -> DataFrame:
    """Mean value v of each hour that has events, with its place i and the number of hours of its key."""
    rows = df.where(F.col(time).isNotNull() & F.col(key).isNotNull() & F.col(value).isNotNull())
    hours = rows.groupBy(F.col(key).alias("key"), F.date_trunc("hour", time).alias("h")).agg(F.avg(value).alias("v"))
    own = Window.partitionBy("key")
    return hours.select("key", "v", F.row_number().over(own.orderBy("h")).alias("i"), F.count("*").over(own).alias("hours"))


def punctuated(df: DataFrame, time: str, key: str, value: str, factor: float = 3.0, least: int = 20) -> DataFrame:
    """Rolling deviation of the hourly means over max(5, n/20) hours; bursts begin where it first exceeds ``factor`` medians."""
    series = hourly_means(df, time, key, value).groupBy("key", "hours").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    series = series.withColumn("v", F.transform("s", lambda x: x["v"])).drop("s")
    w = F.greatest(F.lit(5), F.floor(F.col("hours") / 20)).cast("int")
    each = F.explode(F.sequence(F.lit(1), (F.col("hours") - F.col("w") + 1).cast("int")))
    windows = series.withColumn("w", w).where(F.col("hours") >= F.col("w")).select("key", "hours", "v", "w", each.alias("p"))
    part = windows.select("key", "hours", "p", F.explode(F.slice("v", F.col("p"), F.col("w"))).alias("x"))
    rows = part.groupBy("key", "hours", "p").agg(F.stddev_pop("x").alias("sd"))
    mids = rows.groupBy("key").agg(F.percentile("sd", 0.5).alias("mid"))
    flagged = rows.join(F.broadcast(mids), "key").withColumn("burst", F.col("sd") > factor * F.col("mid"))
    starts = flagged.withColumn("start", F.col("burst") & ~F.coalesce(F.lag("burst").over(Window.partitionBy("key").orderBy("p")), F.lit(False)))
    out = starts.groupBy("key", "hours").agg(F.sum(F.col("start").cast("long")).alias("n_bursts"), F.round(F.avg((~F.col("burst")).cast("double")), 9).alias("stasis"))
    return out.select("key", F.col("hours").cast("long").alias("n"), "n_bursts", "stasis", status(F.col("hours"), least).alias("status"))


@register("punctuated_equilibrium_v1", """
WITH h AS (SELECT event_type AS key, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL),
s AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY h) AS i, count(*) OVER (PARTITION BY key) AS n FROM h),
g AS (SELECT a.key, a.n, a.i, stddev_pop(b.v) AS sd FROM s a JOIN s b ON a.key = b.key AND b.i BETWEEN a.i AND a.i + greatest(5, a.n // 20) - 1
      WHERE a.i <= a.n - greatest(5, a.n // 20) + 1 GROUP BY ALL),
m AS (SELECT key, quantile_cont(sd, 0.5) AS mid FROM g GROUP BY key),
f AS (SELECT g.*, sd > 3 * mid AS b FROM g JOIN m USING (key)),
t AS (SELECT *, b AND NOT coalesce(lag(b) OVER (PARTITION BY key ORDER BY i), false) AS st FROM f)
SELECT key, n, sum(st::INT)::BIGINT AS n_bursts, round(avg((NOT b)::INT::DOUBLE), 9) AS stasis, CASE WHEN n >= 20 THEN 'ok' ELSE 'na' END AS status FROM t GROUP BY key, n""")
def _punctuated(spark, sf_dir):
    return punctuated(_events(spark, sf_dir), "ts", "event_type", "value")


def cooks_distance(df: DataFrame, row: str, x: str, y: str, top: int = 10) -> DataFrame:
    """Rows with the largest Cook distance in the simple regression of y on x; sums first, then one scan."""
    rows = df.select(F.col(row).alias("row_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    fit = rows.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    e = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    lever = 1 / F.col("n") + (F.col("x") - F.col("mx")) ** 2 / F.col("sxx")
    mse = (F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / (F.col("n") - 2)
    d = e * e * lever / (2 * mse * (1 - lever) ** 2)
    return rows.crossJoin(F.broadcast(fit)).select("row_id", "x", "y", F.round(d, 9).alias("cooks_distance")).orderBy(F.col("cooks_distance").desc(), "row_id").limit(top)


@register("outlier_influence_cooks_distance_v1", """
WITH r AS (SELECT o_orderkey AS row_id, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders),
f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS b, var_pop(x) * count(*) AS sxx FROM r),
e AS (SELECT r.*, n, y - my - b * (x - mx) AS e, 1.0 / n + (x - mx) * (x - mx) / sxx AS h FROM r, f),
m AS (SELECT sum(e * e) / (count(*) - 2) AS mse FROM e)
SELECT row_id, x, y, round(e * e * h / (2 * mse * (1 - h) * (1 - h)), 9) AS cooks_distance FROM e, m ORDER BY cooks_distance DESC, row_id LIMIT 10""")
def _cooks(spark, sf_dir):
    return cooks_distance(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_custkey", "o_totalprice")


def beta_binomial(df: DataFrame, time: str, tie: str, key: str, flag: Column, parts: int = 2, least: int = 50) -> DataFrame:
    """Variance of the key's rates in the two halves against that of a binomial of the same rate."""
    halves = early_half(df, [time, tie]).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), "early").agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("p"))
    both = halves.groupBy("key").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("rate"), F.var_pop("p").alias("seen"), F.avg(1 / F.col("n")).alias("w"))
    expected = F.col("rate") * (1 - F.col("rate")) * F.col("w")
    ratio = F.when(expected > 0, F.col("seen") / expected)
    return both.select("key", "n", F.round("rate", 9).alias("rate"), F.round(ratio, 6).alias("dispersion_ratio"), (F.coalesce(ratio, F.lit(0.0)) > 1.2).alias("overdispersed"), status(F.col("n"), least).alias("status"))


HALF = "WITH o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS every FROM events), e AS (SELECT *, (rn <= every // 2) AS early FROM o)"


@register("beta_binomial_overdispersion_v1", HALF + """,
h AS (SELECT event_type AS key, early, count(*) AS n, avg((value > 50)::INT::DOUBLE) AS p FROM e GROUP BY ALL),
b AS (SELECT key, sum(n)::BIGINT AS n, sum(n * p) / sum(n) AS rate, var_pop(p) AS seen, avg(1.0 / n) AS w FROM h GROUP BY key)
SELECT key, n, round(rate, 9) AS rate, round(seen / (rate * (1 - rate) * w), 6) AS dispersion_ratio, seen / (rate * (1 - rate) * w) > 1.2 AS overdispersed,
       CASE WHEN n >= 50 THEN 'ok' ELSE 'na' END AS status FROM b""")
def _beta(spark, sf_dir):
    return beta_binomial(_events(spark, sf_dir), "ts", "event_id", "event_type", F.col("value") > 50)


# Case variants


def case_variants(df: DataFrame, case: list[str], time: str, tie: str, activity: str) -> DataFrame:
    """A row for each case: its activities in time order, joined by '>'. A case is one row by definition."""
    turn = F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), F.col(activity).cast("string").alias("a"))
    rows = df.where(F.col(activity).isNotNull()).groupBy(*case).agg(F.array_sort(F.collect_list(turn)).alias("s"))
    return rows.select(*case, F.array_join(F.transform("s", lambda x: x["a"]), ">").alias("variant"), F.size("s").alias("steps"))


def variants(df: DataFrame, *roles) -> DataFrame:
    """Variants with their number of cases, share, and whether they are rare: one case of several steps."""
    counts = case_variants(df, *roles).groupBy("variant", "steps").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("cases"))
    return counts.crossJoin(F.broadcast(total)).select("variant", "n", F.round(F.col("n") / F.col("cases"), 9).alias("share"), ((F.col("n") == 1) & (F.col("steps") > 1)).alias("rare"))


def variant_halves(df: DataFrame, case: list[str], time: str, tie: str, activity: str) -> DataFrame:
    """Cases of each variant in the early half of the rows (a) and in the late half (b)."""
    return case_variants(early_half(df, [time, tie]), [*case, "early"], time, tie, activity).groupBy("variant").agg(
        F.sum("early").cast("long").alias("a"), F.sum(1 - F.col("early")).cast("long").alias("b")
    )


ROLES = (["user_id", "day"], "ts", "event_id", "event_type")
CASES = "SELECT user_id, ts::DATE AS day, {} string_agg(event_type, '>' ORDER BY ts, event_id) AS variant, count(*) AS steps FROM {} GROUP BY ALL"
SPLIT = HALF + f", c AS ({CASES.format('early,', 'e')}), v AS (SELECT variant, sum(early::INT)::BIGINT AS a, sum((NOT early)::INT)::BIGINT AS b FROM c GROUP BY variant)"


def _days(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("day", F.to_date("ts"))


@register("process_sequence", f"WITH c AS ({CASES.format('', 'events')}) SELECT variant, count(*) AS n, round(count(*) / (SELECT count(*) FROM c)::DOUBLE, 9) AS share, count(*) = 1 AND max(steps) > 1 AS rare FROM c GROUP BY variant")
def _variants(spark, sf_dir):
    """Cases are a user's days."""
    return variants(_days(spark, sf_dir), *ROLES)


@register("process_drift_conformance_over_time", SPLIT + " SELECT sum(abs(a - b))::BIGINT AS variant_l1_distance, count(*) AS variants FROM v")
def _drift(spark, sf_dir):
    return variant_halves(_days(spark, sf_dir), *ROLES).agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("variant_l1_distance"), F.count("*").alias("variants"))


@register("variant_differential", SPLIT + " SELECT variant, b - a AS delta FROM v ORDER BY abs(b - a) DESC, variant LIMIT 20")
def _differential(spark, sf_dir):
    return variant_halves(_days(spark, sf_dir), *ROLES).select("variant", (F.col("b") - F.col("a")).alias("delta")).orderBy(F.abs("delta").desc(), "variant").limit(20)


@register("process_mining_conformance_v1", f"""
WITH c AS ({CASES.format('', 'events')}), v AS (SELECT variant, count(*) AS n FROM c GROUP BY variant)
SELECT (SELECT variant FROM v ORDER BY n DESC, variant LIMIT 1) AS top_variant, max(n) AS conforming, sum(n)::BIGINT AS cases, round(max(n) / sum(n), 9) AS share FROM v""")
def _conformance(spark, sf_dir):
    counts = case_variants(_days(spark, sf_dir), *ROLES).groupBy("variant").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "variant"))
    return counts.agg(best["variant"].alias("top_variant"), F.max("n").alias("conforming"), F.sum("n").alias("cases"), F.round(F.max("n") / F.sum("n"), 9).alias("share"))


@register("conformance_alignments", f"""
WITH c AS ({CASES.format('', 'events')}), v AS (SELECT variant, count(*) AS n FROM c GROUP BY variant),
x AS (SELECT n, variant, array_to_string(list_transform(string_split(variant, '>'), lambda s: s[1]), '') AS k FROM v),
t AS (SELECT variant, k FROM x ORDER BY n DESC, variant LIMIT 1)
SELECT t.variant AS top_variant, count(*) AS variant_count, sum(n)::BIGINT AS distance_sequences_used, round(sum(n * levenshtein(x.k, t.k)) / sum(n)::DOUBLE, 9) AS avg_edit_distance FROM x, t GROUP BY t.variant""")
def _alignments(spark, sf_dir):
    return alignments(_days(spark, sf_dir), *ROLES)


def alignments(df: DataFrame, case: list[str], time: str, tie: str, activity: str) -> DataFrame:
    """Mean edit distance, in activities, of all cases to the most common variant; each distinct variant is compared once.

    Activities become single characters by their place among the sorted names (at most 60,000 activities)."""
    counts = case_variants(df, case, time, tie, activity).groupBy("variant").agg(F.count("*").alias("n"))
    names = df.where(F.col(activity).isNotNull()).select(F.col(activity).cast("string").alias("a")).distinct().agg(F.array_sort(F.collect_list("a")).alias("names"))
    coded = counts.crossJoin(F.broadcast(names)).select(
        "variant", "n", F.array_join(F.transform(F.split("variant", ">"), lambda a: F.decode(F.unhex(F.lpad(F.hex(F.array_position("names", a) + 255), 4, "0")), "UTF-16BE")), "").alias("code")
    )
    top = coded.agg(F.min(F.struct((-F.col("n")).alias("n"), "variant", "code")).alias("t")).select(F.col("t.variant").alias("top_variant"), F.col("t.code").alias("top_code"))
    rows = coded.crossJoin(F.broadcast(top)).withColumn("d", F.levenshtein("code", "top_code"))
    return rows.groupBy("top_variant").agg(F.count("*").alias("variant_count"), F.sum("n").alias("distance_sequences_used"), F.round(F.sum(F.col("n") * F.col("d")) / F.sum("n"), 9).alias("avg_edit_distance"))


# Tails, terms, queues


def hill(df: DataFrame, key: str, value: str, tie: str, least: int = 50) -> DataFrame:
    """Hill's tail index with k = max(20, min(200, n / 10)): each key's largest values only, cut before the window by a
    threshold that a per-key percentile bounds."""
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("x"), F.col(tie).alias("tie")).where("key IS NOT NULL AND x > 0")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.percentile_approx("x", [0.0, 0.5, 0.9, 0.99, 0.999], 10000).alias("cuts"))
    sizes = sizes.withColumn("k", F.greatest(F.lit(20), F.least(F.lit(200), F.floor(F.col("n") / 10))))
    # the values above the highest of a few quantiles that surely leaves three times k, by the sketch's error of n / 10,000
    left = [1.0, 0.5, 0.1, 0.01, 0.001]
    spare = F.filter(F.arrays_zip(F.lit(left).alias("left"), "cuts"), lambda z: F.col("n") * z["left"] >= 3 * F.col("k") + F.col("n") / 5000)
    sizes = sizes.withColumn("cut", F.coalesce(F.try_element_at(spare, F.lit(-1))["cuts"], F.element_at("cuts", 1)))
    upper = rows.join(F.broadcast(sizes), "key").where(F.col("x") >= F.col("cut"))
    top = upper.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("x").desc(), "tie"))).where("r <= k + 1")
    out = top.groupBy("key", "n", "k").agg(F.sum(F.when(F.col("r") <= F.col("k"), F.log("x"))).alias("s"), F.min("x").alias("low"), F.count("*").alias("c"))
    alpha = F.when((F.col("c") > F.col("k")) & (F.col("s") > F.col("k") * F.log("low")), F.col("k") / (F.col("s") - F.col("k") * F.log("low")))
    return out.select("key", "n", F.col("k").cast("long").alias("k"), F.round(alpha, 6).alias("tail_index_alpha"), status(F.col("n"), least).alias("status"))


@register("heavy_tail_index_hill_v1", """
WITH s AS (SELECT event_type AS key, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0),
k AS (SELECT *, greatest(20, least(200, n // 10)) AS k FROM s)
SELECT key, n, k::BIGINT AS k, round(k / (sum(ln(x)) FILTER (r <= k) - k * ln(min(x))), 6) AS tail_index_alpha, CASE WHEN n >= 50 THEN 'ok' ELSE 'na' END AS status
FROM k WHERE r <= k + 1 GROUP BY key, n, k""")
def _hill(spark, sf_dir):
    return hill(_events(spark, sf_dir), "event_type", "value", "event_id")


def row_mean_share(df: DataFrame, columns: list[str], least: int = 20) -> DataFrame:
    """Variance of the rows' means over the variance of all values, each column scaled to its own deviation."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    scale = x.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)])
    z = [(F.col(c) - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(F.lit(1.0)) for i, c in enumerate(columns)]
    rows = x.crossJoin(F.broadcast(scale)).select(F.array(*z).alias("z"))
    mean = F.aggregate("z", F.lit(0.0), lambda a, v: a + v) / len(columns)
    square = F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v) / len(columns)
    # scaled columns have mean zero, so the variance of all values is their mean square
    out = rows.agg(F.count("*").alias("n"), F.var_pop(mean).alias("between"), F.avg(square).alias("every"))
    return out.select("n", F.round(F.col("between") / F.col("every"), 6).alias("share"), status(F.col("n"), least).alias("status"))


@register("mixed_effects_hierarchical_v1", """
WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS b, stddev_pop(l_extendedprice) AS sb, avg(l_discount) AS c, stddev_pop(l_discount) AS sc FROM lineitem),
z AS (SELECT (l_quantity - a) / sa AS x, (l_extendedprice - b) / sb AS y, (l_discount - c) / sc AS w FROM lineitem, s)
SELECT count(*) AS n, round(var_pop((x + y + w) / 3) / avg((x * x + y * y + w * w) / 3), 6) AS share, CASE WHEN count(*) >= 20 THEN 'ok' ELSE 'na' END AS status FROM z""")
def _mixed(spark, sf_dir):
    return row_mean_share(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_discount"])


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def token_entropy(df: DataFrame, time: str, tie: str, text: str, least: int = 20) -> DataFrame:
    """Entropy in bits of the tokens of all texts, early and late half of the rows."""
    words = early_half(df, [time, tie]).select("early", F.explode(tokens(F.col(text))).alias("w")).groupBy("early", "w").agg(F.count("*").alias("n"))
    # H = log2 N - sum(n log2 n) / N, so no window over all tokens is needed
    out = words.groupBy("early").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    h = F.log2("all") - F.col("s") / F.col("all")
    pick = lambda e: F.max(F.when(F.col("early") == e, h))
    both = out.agg(pick(1).alias("a"), pick(0).alias("b"), F.sum("all").alias("n"))
    return both.select(F.round("a", 6).alias("entropy_pre"), F.round("b", 6).alias("entropy_post"), F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.col("n").alias("tokens"), status(F.col("n"), least).alias("status"))


@register("message_entropy_drift", HALF + """,
w AS (SELECT early, unnest(regexp_extract_all(lower(props), '[a-z0-9]+')) AS w FROM e), c AS (SELECT early, w, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT early, sum(n) AS every FROM c GROUP BY early),
h AS (SELECT early, -sum((n / every) * log2(n / every)) AS h, any_value(every) AS every FROM c JOIN t USING (early) GROUP BY early)
SELECT round(max(h) FILTER (early), 6) AS entropy_pre, round(max(h) FILTER (NOT early), 6) AS entropy_post,
       round(max(h) FILTER (NOT early) - max(h) FILTER (early), 6) AS delta, sum(every)::BIGINT AS tokens, CASE WHEN sum(every) >= 20 THEN 'ok' ELSE 'na' END AS status FROM h""")
def _message(spark, sf_dir):
    return token_entropy(_events(spark, sf_dir), "ts", "event_id", "props")


def term_bursts(df: DataFrame, time: str, text: str, top: int = 20) -> DataFrame:
    """Terms by the largest z of their daily counts; days without a term count as zero, from sums alone."""
    words = df.where(F.col(time).isNotNull()).select(F.to_date(time).alias("day"), F.explode(tokens(F.col(text))).alias("term"))
    counts = words.groupBy("term", "day").agg(F.count("*").alias("n"))
    days = df.where(F.col(time).isNotNull()).agg(F.count_distinct(F.to_date(time)).alias("days"))
    sums = counts.groupBy("term").agg(F.max("n").alias("most"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    m = F.col("s") / F.col("days")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("days") - m * m, F.lit(0.0)))
    z = sums.crossJoin(F.broadcast(days)).select("term", F.col("s").alias("n"), F.round(F.when(sd > 1e-9, (F.col("most") - m) / sd), 6).alias("max_z"))
    return z.where("max_z IS NOT NULL").orderBy(F.col("max_z").desc(), "term").limit(top)


@register("term_burst_kleinberg", """
WITH w AS (SELECT ts::DATE AS day, unnest(regexp_extract_all(lower(event_type || ' ' || props), '[a-z0-9]+')) AS term FROM events),
d AS (SELECT DISTINCT ts::DATE AS day FROM events), t AS (SELECT DISTINCT term FROM w),
c AS (SELECT t.term, d.day, count(w.term) AS n FROM t CROSS JOIN d LEFT JOIN w ON w.term = t.term AND w.day = d.day GROUP BY ALL)
SELECT term, sum(n)::BIGINT AS n, round((max(n) - avg(n)) / stddev_pop(n), 6) AS max_z FROM c GROUP BY term HAVING stddev_pop(n) > 1e-9 ORDER BY max_z DESC, term LIMIT 20""")
def _terms(spark, sf_dir):
    return term_bursts(_events(spark, sf_dir).withColumn("said", F.concat_ws(" ", "event_type", "props")), "ts", "said")


def erlang(df: DataFrame, time: str, key: str, service: str, extra: int = 10, least: int = 20) -> DataFrame:
    """Erlang B and C for server counts from the offered load λ·S: the recursion 1/B(k) = 1 + (k/A)/B(k−1), folded in one expression."""
    rows = df.where((F.col(service) > 0) & F.col(time).isNotNull() & F.col(key).isNotNull())
    load = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.avg(service).alias("s"), ((F.max(micros(time)) - F.min(micros(time))) / 1e6).alias("span"))
    load = load.where("span > 0").withColumn("a", F.col("n") / F.col("span") * F.col("s"))
    first = F.greatest(F.lit(1), F.floor("a")).cast("int")
    each = load.select("*", F.explode(F.sequence(first, first + extra - 1)).alias("servers"))
    inverse = F.aggregate(F.sequence(F.lit(1), F.col("servers")), F.lit(1.0), lambda acc, k: 1.0 + acc * k / F.col("a"))
    told = each.withColumn("b", 1 / inverse)
    wait = F.when(F.col("a") >= F.col("servers"), F.lit(1.0)).otherwise(F.col("b") * F.col("servers") / (F.col("servers") - F.col("a") * (1 - F.col("b"))))
    return told.select("key", F.col("servers").cast("long").alias("servers"), F.round("a", 9).alias("traffic_intensity"), F.round("b", 9).alias("blocking"), F.round(wait, 9).alias("waiting"), status(F.col("n"), least).alias("status"))


@register("erlang_bc_blocking_v1", """
WITH l AS (SELECT event_type AS key, count(*) AS n, avg(value) AS s, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM events WHERE value > 0 GROUP BY 1),
a AS (SELECT *, n / span * s AS a FROM l), e AS (SELECT *, unnest(range(greatest(1, floor(a)::BIGINT), greatest(1, floor(a)::BIGINT) + 10)) AS c FROM a),
t AS (SELECT key, c, a, n, unnest(range(0, c + 1)) AS k FROM e),
p AS (SELECT key, c, a, n, sum(exp(k * ln(a) - lgamma(k + 1))) AS z, max(exp(k * ln(a) - lgamma(k + 1))) FILTER (k = c) AS last FROM t GROUP BY ALL)
SELECT key, c AS servers, round(a, 9) AS traffic_intensity, round(last / z, 9) AS blocking,
       round(CASE WHEN a >= c THEN 1.0 ELSE last * c / (c - a) / (z - last + last * c / (c - a)) END, 9) AS waiting, CASE WHEN n >= 20 THEN 'ok' ELSE 'na' END AS status FROM p""")
def _erlang(spark, sf_dir):
    return erlang(_events(spark, sf_dir), "ts", "event_type", "value")


def lomb_scargle(df: DataFrame, time: str, key: str, value: str, least: int = 20) -> DataFrame:
    """Lomb-Scargle power of hourly means at their true times, at frequencies 1 to hours / 2 cycles a span; the strongest
    frequency against the median. All frequencies count, however long the series."""
    rows = df.where(F.col(time).isNotNull() & F.col(key).isNotNull() & F.col(value).isNotNull())
    hours = rows.groupBy(F.col(key).alias("key"), F.floor(micros(time) / 3_600_000_000).alias("h")).agg(F.avg(value).alias("v"))
    spans = hours.groupBy("key").agg(F.min("h").alias("h0"), (F.max("h") - F.min("h") + 1).alias("span"), F.count("*").alias("n"), F.avg("v").alias("mean"))
    each = hours.join(F.broadcast(spans), "key").select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("int"))).alias("k"))
    w = 2 * F.pi() * F.col("k") / F.col("span") * (F.col("h") - F.col("h0"))
    x = F.col("v") - F.col("mean")
    sums = each.groupBy("key", "k", "n", "span").agg(F.sum(F.sin(2 * w)).alias("s2"), F.sum(F.cos(2 * w)).alias("c2"), F.sum(x * F.cos(w)).alias("xc"), F.sum(x * F.sin(w)).alias("xs"), F.sum(F.cos(w) ** 2).alias("cc"), F.sum(F.sin(w) ** 2).alias("ss"), F.sum(F.sin(w) * F.cos(w)).alias("cs"))
    tau = F.atan2("s2", "c2") / 2
    c, s = F.cos(tau), F.sin(tau)
    part = lambda top, low: F.when(low > 1e-9, top * top / low).otherwise(F.lit(0.0))
    cos2 = F.col("cc") * c * c + 2 * F.col("cs") * c * s + F.col("ss") * s * s
    sin2 = F.col("ss") * c * c - 2 * F.col("cs") * c * s + F.col("cc") * s * s
    power = (part(F.col("xc") * c + F.col("xs") * s, cos2) + part(F.col("xs") * c - F.col("xc") * s, sin2)) / 2
    told = sums.withColumn("p", power).groupBy("key", "n", "span").agg(F.max("p").alias("top"), F.percentile("p", 0.5).alias("mid"), F.max_by("k", F.struct(F.round("p", 6), -F.col("k"))).alias("k"))
    return told.select("key", F.col("n").alias("n"), F.col("k").cast("long").alias("cycles"), F.round(F.col("span") / F.col("k"), 6).alias("period_hours"), F.round(F.col("top") / F.when(F.col("mid") > 0, F.col("mid")), 4).alias("peak_ratio"), status(F.col("n"), least).alias("status"))


@register("lomb_scargle_periodogram_v1", """
WITH h AS (SELECT event_type AS key, epoch_us(ts) // 3600000000 AS h, avg(value) AS v FROM events GROUP BY ALL),
s AS (SELECT key, min(h) AS h0, max(h) - min(h) + 1 AS span, count(*) AS n, avg(v) AS mean FROM h GROUP BY key),
e AS (SELECT key, n, span, k, v - mean AS x, 2 * pi() * k / span * (h - h0) AS w FROM h JOIN s USING (key), unnest(range(1, greatest(1, n // 2) + 1)) AS r(k)),
t AS (SELECT key, n, span, k, atan2(sum(sin(2 * w)), sum(cos(2 * w))) / 2 AS tau FROM e GROUP BY ALL),
p AS (SELECT key, n, span, k, CASE WHEN sum(cos(w - tau) ** 2) > 1e-9 THEN sum(x * cos(w - tau)) ** 2 / sum(cos(w - tau) ** 2) ELSE 0 END / 2
             + CASE WHEN sum(sin(w - tau) ** 2) > 1e-9 THEN sum(x * sin(w - tau)) ** 2 / sum(sin(w - tau) ** 2) ELSE 0 END / 2 AS p FROM e JOIN t USING (key, n, span, k) GROUP BY ALL),
m AS (SELECT key, quantile_cont(p, 0.5) AS mid FROM p GROUP BY key)
SELECT key, n, k::BIGINT AS cycles, round(span / k, 6) AS period_hours, round(p / mid, 4) AS peak_ratio, CASE WHEN n >= 20 THEN 'ok' ELSE 'na' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(p, 6) DESC, k) AS r FROM p) JOIN m USING (key) WHERE r = 1""")
def _lomb(spark, sf_dir):
    return lomb_scargle(_events(spark, sf_dir), "ts", "event_type", "value")


def hick(df: DataFrame, group: str, duration: str, least: int = 3) -> DataFrame:
    """All groups share one number of choices, so the regressor is constant and the split is the fixed 0.3 / 0.7 one; the pool
    size is where the slope's inverse allows it, between 2 and 100."""
    means = df.where(F.col(group).isNotNull() & F.col(duration).isNotNull()).groupBy(group).agg(F.count("*").alias("c"), F.avg(duration).alias("m")).where(F.col("c") >= 3)
    told = means.agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    b = 0.7 * F.col("mean") / F.greatest(F.lit(1.0), F.log2(F.col("n") + 1))
    best = F.greatest(F.lit(2.0), F.least(F.lit(100.0), F.floor(F.pow(F.lit(2.0), F.least(F.lit(60.0), 1 / F.greatest(F.lit(0.01), b))) - 1)))
    return told.select("n", F.round(0.3 * F.col("mean"), 6).alias("a"), F.round(b, 6).alias("b"), F.when(b > 0, best).otherwise(F.col("n")).cast("long").alias("optimal_n"), F.when((F.col("n") >= least) & (F.col("sd") >= 1e-9), F.lit("ok")).otherwise(F.lit("na")).alias("status"))


@register("hick_law_pool_sizing_v1", """
WITH g AS (SELECT event_type, count(*) AS c, avg(value) AS m FROM events GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT count(*) AS n, avg(m) AS mean, stddev_pop(m) AS sd FROM g), b AS (SELECT *, 0.7 * mean / greatest(1.0, log2(n + 1)) AS b FROM t)
SELECT n, round(0.3 * mean, 6) AS a, round(b, 6) AS b, CASE WHEN b > 0 THEN greatest(2, least(100, floor(2 ** least(60, 1 / greatest(0.01, b)) - 1)))::BIGINT ELSE n END AS optimal_n,
       CASE WHEN n >= 3 AND sd >= 1e-9 THEN 'ok' ELSE 'na' END AS status FROM b""")
def _hick(spark, sf_dir):
    return hick(_events(spark, sf_dir), "event_type", "value")


def roll_day(df: DataFrame, time: str, month: Column, share: float = 0.5, streak: int = 2) -> DataFrame:
    """First day of the month from which at least ``streak`` days running have a share of rows of the following accounting
    month of ``share`` or more; close windows begin there. ``month``: the accounting month a row belongs to, as first of month."""
    rows = df.where(F.col(time).isNotNull()).select(F.dayofmonth(time).alias("dom"), (month > F.trunc(time, "month")).cast("int").alias("ahead"))
    days = rows.groupBy("dom").agg(F.count("*").alias("n"), F.avg(F.col("ahead").cast("double")).alias("share")).withColumn("hit", F.col("share") >= share)
    own = Window.partitionBy("hit").orderBy("dom")
    runs = days.where("hit").withColumn("island", F.col("dom") - F.row_number().over(own)).groupBy("island").agg(F.min("dom").alias("roll_day"), F.count("*").alias("streak"), F.sum("n").alias("rows"))
    return runs.where(F.col("streak") >= streak).orderBy("roll_day").limit(1).select(F.col("roll_day").cast("long").alias("roll_day"), "streak", "rows")


@register("close_cycle_window_resolver", """
WITH r AS (SELECT day(o_orderdate) AS dom, (date_trunc('month', o_orderdate + INTERVAL 9 DAY) > date_trunc('month', o_orderdate))::INT AS ahead FROM orders),
d AS (SELECT dom, count(*) AS n, avg(ahead) AS share FROM r GROUP BY dom), h AS (SELECT *, dom - row_number() OVER (ORDER BY dom) AS island FROM d WHERE share >= 0.5)
SELECT min(dom)::BIGINT AS roll_day, count(*) AS streak, sum(n)::BIGINT AS rows FROM h GROUP BY island HAVING count(*) >= 2 ORDER BY 1 LIMIT 1""")
def _roll(spark, sf_dir):
    """Orders of a month's last nine days belong to the next accounting month."""
    return roll_day(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", F.trunc(F.date_add("o_orderdate", 9), "month"))


def payout(df: DataFrame, process: str, source: str, start: str, end: Column, pattern: str) -> DataFrame:
    """Runs of the processes that match the pattern, by source and for all sources: counts, first start, last end, durations."""
    rows = df.where(F.col(process).rlike(pattern)).select(F.col(source).cast("string").alias("source"), F.col(start).cast("timestamp").alias("s"), end.cast("timestamp").alias("e"))
    took = (F.unix_micros("e") - F.unix_micros("s")) / 1e6
    told = lambda g: g.agg(F.count("*").alias("runs"), F.min(F.unix_micros("s")).alias("first_start"), F.max(F.unix_micros("e")).alias("last_end"), F.round(F.sum(took) / 3600, 6).alias("total_hours"), F.round(F.percentile(took, 0.5), 6).alias("median_seconds"))
    return told(rows.groupBy("source")).unionByName(told(rows.groupBy()).select(F.lit("ALL").alias("source"), "*"))


@register("report_payout_report_v1", """
WITH r AS (SELECT o_orderstatus AS source, epoch_us(o_orderdate) AS s, epoch_us(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE regexp_matches(o_orderpriority, '(?i)urgent|high'))
SELECT coalesce(source, 'ALL') AS source, count(*) AS runs, min(s) AS first_start, max(e) AS last_end, round(sum((e - s) / 1e6) / 3600, 6) AS total_hours, round(quantile_cont((e - s) / 1e6, 0.5), 6) AS median_seconds
FROM r GROUP BY GROUPING SETS ((source), ())""")
def _payout(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    runs = read("orders").join(read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return payout(runs, "o_orderpriority", "o_orderstatus", "o_orderdate", F.col("l_shipdate"), "(?i)urgent|high")
