"""Findings of an event log in one form, and what is made of them: levers, cards, checks, manifests and report tables.

A finding is a row (plugin_id, kind, entity, metric, value, measurement, assumption). Every step is a function of a findings
table, so findings of other operators can be joined in by ``unionByName``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.plans.registry import register

#: Kinds with their lever, and the least value that calls for it.
LEVERS = {"tail": ("isolate_process", 100_000.0), "retry": ("retry_backoff", 0.15), "capacity": ("add_server", 0.5)}
#: Cards: name, kind, and the limit that a finding must not exceed.
CARDS = {"slow tail": ("tail", 200_000.0), "many retries": ("retry", 0.25), "lost hours": ("capacity", 1000.0)}


def log_waits(df: DataFrame, case: list[str], time: str, tie: str, process: str) -> DataFrame:
    """Rows (process, case, wait, again): seconds since the case's row before, and whether that was the same process."""
    own = Window.partitionBy(*case).orderBy(time, tie)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.where(F.col(time).isNotNull() & F.col(process).isNotNull()).select(
        F.col(process).cast("string").alias("process"), F.concat_ws("/", *[F.col(c).cast("string") for c in case]).alias("case_id"),
        ((us - F.lag(us).over(own)) / 1e6).alias("wait"), (F.lag(process).over(own) == F.col(process)).cast("double").alias("again"),
    )
    return rows.where("wait IS NOT NULL")


def findings(waits: DataFrame, over: float = 21600.0) -> DataFrame:
    """Three findings for each process: 95th percentile of waits, retry rate, hours that one more server would save."""
    over_h = F.sum(F.when(F.col("wait") > over, F.col("wait")).otherwise(0.0)) / 3600
    servers = waits.agg(F.count_distinct("case_id").alias("servers"))
    told = waits.groupBy("process").agg(F.percentile("wait", 0.95).alias("p95"), F.avg("again").alias("retry"), over_h.alias("h")).crossJoin(F.broadcast(servers))
    row = lambda plugin, kind, metric, value, how, why: F.struct(F.lit(plugin).alias("plugin_id"), F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.round(value, 6).alias("value"), F.lit(how).alias("measurement"), F.lit(why).cast("string").alias("assumption"))
    rows = F.array(
        row("percentile_analysis", "tail", "p95_wait_s", F.col("p95"), "measured", None),
        row("retry_rate_hotspots_v1", "retry", "retry_rate", F.col("retry"), "measured", None),
        row("capacity_scaling", "capacity", "saved_hours", F.col("h") / (F.col("servers") + 1), "modeled", "waits fall with servers / (servers + 1)"),
    )
    return told.select("process", F.explode(rows).alias("f")).select("f.plugin_id", "f.kind", F.col("process").alias("entity"), "f.metric", "f.value", "f.measurement", "f.assumption")


WAITS = """WITH l AS (SELECT user_id, event_type AS process, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS wait, (lag(event_type) OVER w = event_type)::INT::DOUBLE AS again FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT process, quantile_cont(wait, 0.95) AS p95, avg(again) AS retry, sum(CASE WHEN wait > 21600 THEN wait ELSE 0 END) / 3600 AS h FROM l WHERE wait IS NOT NULL GROUP BY 1), s AS (SELECT count(DISTINCT user_id) AS servers FROM l WHERE wait IS NOT NULL),
f AS (SELECT 'percentile_analysis' AS plugin_id, 'tail' AS kind, process AS entity, 'p95_wait_s' AS metric, round(p95, 6) AS value, 'measured' AS measurement, NULL::VARCHAR AS assumption FROM k
      UNION ALL SELECT 'retry_rate_hotspots_v1', 'retry', process, 'retry_rate', round(retry, 6), 'measured', NULL FROM k
      UNION ALL SELECT 'capacity_scaling', 'capacity', process, 'saved_hours', round(h / (servers + 1), 6), 'modeled', 'waits fall with servers / (servers + 1)' FROM k, s)
"""


def _found(spark, sf_dir) -> DataFrame:
    return findings(log_waits(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "ts", "event_id", "event_type"))


def _by_kind(options: dict, place: int) -> Column:
    """A column that picks an option by kind; null for other kinds."""
    out = F.lit(None)
    for kind, values in options.items():
        out = F.when(F.col("kind") == kind, F.lit(values[place])).otherwise(out)
    return out


@register("findings_table", WAITS + "SELECT * FROM f")
def _table(spark, sf_dir):
    return _found(spark, sf_dir)


def levers(found: DataFrame) -> DataFrame:
    """Lever of each finding whose value calls for it, and how far it exceeds what calls for it."""
    rows = found.withColumn("lever", _by_kind(LEVERS, 0)).withColumn("least", _by_kind(LEVERS, 1))
    return rows.where("value >= least").select("lever", "entity", "plugin_id", F.round(F.col("value") / F.col("least"), 6).alias("strength"))


@register("finding_to_lever_bridge_v1", WAITS + """
SELECT lever, entity, plugin_id, round(value / least, 6) AS strength FROM f JOIN (VALUES ('tail', 'isolate_process', 100000.0::DOUBLE), ('retry', 'retry_backoff', 0.15::DOUBLE), ('capacity', 'add_server', 0.5::DOUBLE)) v(kind, lever, least) USING (kind) WHERE value >= least""")
def _bridge(spark, sf_dir):
    return levers(_found(spark, sf_dir))


def ranked_levers(waits: DataFrame, over: float = 21600.0) -> DataFrame:
    """Levers with modeled hours: a process's long waits halved where they are a third of all (isolation), its retries' waits
    saved where one row in six is a retry (backoff), a server's share of its long waits (capacity); by hours."""
    long = F.when(F.col("wait") > over, F.col("wait")).otherwise(0.0) / 3600
    own = waits.groupBy("process").agg(F.sum(long).alias("long_h"), F.sum(F.col("again") * F.col("wait") / 3600).alias("retry_h"), F.avg("again").alias("retry"))
    every = waits.agg(F.sum(long).alias("all_h"), F.count_distinct("case_id").alias("servers"))
    lever = lambda name, when, hours: F.struct(F.lit(name).alias("lever"), F.when(when, hours).alias("hours"))
    options = F.array(
        lever("isolate_process", F.col("long_h") >= F.col("all_h") / 3, F.col("long_h") / 2),
        lever("retry_backoff", F.col("retry") >= 1 / 6, F.col("retry_h")),
        lever("add_server", F.col("long_h") > 0, F.col("long_h") / (F.col("servers") + 1)),
    )
    rows = own.crossJoin(F.broadcast(every)).select("process", F.explode(options).alias("o")).where("o.hours IS NOT NULL")
    return rows.select("process", "o.lever", F.round("o.hours", 6).alias("modeled_hours"))


@register("actionable_ops_levers_v1", WAITS.split(",\nk AS")[0] + """,
w AS (SELECT *, CASE WHEN wait > 21600 THEN wait ELSE 0 END / 3600 AS long FROM l WHERE wait IS NOT NULL), a AS (SELECT sum(long) AS all_h, count(DISTINCT user_id) AS servers FROM w),
p AS (SELECT process, sum(long) AS long_h, sum(again * wait / 3600) AS retry_h, avg(again) AS retry FROM w GROUP BY 1)
SELECT process, 'isolate_process' AS lever, round(long_h / 2, 6) AS modeled_hours FROM p, a WHERE long_h >= all_h / 3
UNION ALL SELECT process, 'retry_backoff', round(retry_h, 6) FROM p WHERE retry >= 1.0 / 6 UNION ALL SELECT process, 'add_server', round(long_h / (servers + 1), 6) FROM p, a WHERE long_h > 0""")
def _ops(spark, sf_dir):
    return ranked_levers(log_waits(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "ts", "event_id", "event_type"))


def issue_cards(found: DataFrame) -> DataFrame:
    """Each card with the findings it looks at, how many exceed its limit, and whether it passes."""
    kinds = {k: (name, limit) for name, (k, limit) in CARDS.items()}
    rows = found.withColumn("card", _by_kind(kinds, 0)).withColumn("limit", _by_kind(kinds, 1)).where("card IS NOT NULL")
    told = rows.groupBy("card").agg(F.count("*").alias("checked"), F.sum((F.col("value") > F.col("limit")).cast("long")).alias("failed"), F.max("value").alias("worst"))
    return told.select("card", "checked", "failed", "worst", (F.col("failed") == 0).alias("passes"))


@register("issue_cards_v2", WAITS + """
SELECT card, count(*) AS checked, sum((value > top)::INT)::BIGINT AS failed, max(value) AS worst, sum((value > top)::INT) = 0 AS passes
FROM f JOIN (VALUES ('tail', 'slow tail', 200000.0), ('retry', 'many retries', 0.25), ('capacity', 'lost hours', 1000.0)) v(kind, card, top) USING (kind) GROUP BY card""")
def _cards(spark, sf_dir):
    return issue_cards(_found(spark, sf_dir))


def dedupe_recommendations(rows: DataFrame, keys: list[str], excluded: list[str] = ()) -> DataFrame:
    """One row for equal keys: how often it was recommended, by what, its greatest strength. Excluded entities are left out."""
    kept = rows.where(~F.col("entity").isin(*excluded)) if excluded else rows
    return kept.groupBy(*keys).agg(F.count("*").alias("observed_count"), F.array_join(F.array_sort(F.collect_set("plugin_id")), ",").alias("evidence"), F.max("strength").alias("strength"))


@register("recommendation_dedupe_v2", WAITS + """,
r AS (SELECT lever, entity, plugin_id, round(value / least, 6) AS strength FROM f JOIN (VALUES ('tail', 'isolate_process', 100000.0::DOUBLE), ('retry', 'retry_backoff', 0.15::DOUBLE), ('capacity', 'add_server', 0.5::DOUBLE)) v(kind, lever, least) USING (kind) WHERE value >= least),
t AS (SELECT * FROM r UNION ALL SELECT lever, entity, 'second_run', strength FROM r WHERE lever = 'add_server')
SELECT lever, entity, count(*) AS observed_count, string_agg(DISTINCT plugin_id, ',' ORDER BY plugin_id) AS evidence, max(strength) AS strength FROM t WHERE entity NOT IN ('error') GROUP BY ALL""")
def _dedupe(spark, sf_dir):
    once = levers(_found(spark, sf_dir))
    twice = once.unionByName(once.where("lever = 'add_server'").withColumn("plugin_id", F.lit("second_run")))
    return dedupe_recommendations(twice, ["lever", "entity"], ["error"])


@register("traceability_manifest_v2", WAITS + "SELECT sha256(plugin_id || '|' || entity || '|' || metric) AS claim_id, plugin_id || ' ' || metric AS source, entity, value FROM f")
def _trace(spark, sf_dir):
    """Every claim with a stable id, the operator and metric it comes from, and its value."""
    claim = F.sha2(F.concat_ws("|", "plugin_id", "entity", "metric"), 256)
    return _found(spark, sf_dir).select(claim.alias("claim_id"), F.concat_ws(" ", "plugin_id", "metric").alias("source"), "entity", "value")


@register("determinism_discipline", WAITS + """
SELECT plugin_id, count(*) AS findings, sum((measurement IS NULL OR measurement = 'modeled' AND coalesce(assumption, '') = '')::INT)::BIGINT AS violations FROM f GROUP BY 1""")
def _discipline(spark, sf_dir):
    """Findings without a measurement type, and modeled ones without an assumption."""
    bad = F.col("measurement").isNull() | ((F.col("measurement") == "modeled") & (F.coalesce("assumption", F.lit("")) == ""))
    return _found(spark, sf_dir).groupBy("plugin_id").agg(F.count("*").alias("findings"), F.sum(bad.cast("long")).alias("violations"))


@register("kona_signal_coverage_audit_v1", WAITS + """
, w AS (SELECT unnest(['tail', 'retry', 'capacity', 'drift', 'spillover']) AS kind)
SELECT count(*) AS kinds, count(*) FILTER (kind IN (SELECT kind FROM f)) AS covered, round(count(*) FILTER (kind IN (SELECT kind FROM f)) / count(*)::DOUBLE, 9) AS coverage FROM w""")
def _coverage(spark, sf_dir):
    """Share of the kinds a state space listens to that the findings have."""
    wanted = spark.createDataFrame([(k,) for k in ("tail", "retry", "capacity", "drift", "spillover")], "kind string")
    seen = _found(spark, sf_dir).select("kind").distinct().withColumn("seen", F.lit(1))
    told = wanted.join(F.broadcast(seen), "kind", "left").agg(F.count("*").alias("kinds"), F.count("seen").alias("covered"))
    return told.select("kinds", "covered", F.round(F.col("covered") / F.col("kinds"), 9).alias("coverage"))


@register("report_plain_english_v1", WAITS + "SELECT entity, metric, entity || ': ' || replace(metric, '_', ' ') || ' is ' || printf('%.2f', value) || ' (' || measurement || ')' AS sentence FROM f")
def _plain(spark, sf_dir):
    sentence = F.format_string("%s: %s is %.2f (%s)", "entity", F.replace("metric", F.lit("_"), F.lit(" ")), "value", "measurement")
    return _found(spark, sf_dir).select("entity", "metric", sentence.alias("sentence"))


@register("report_bundle", WAITS + "SELECT plugin_id, count(*) AS n, string_agg(entity, ',' ORDER BY entity) AS entities, round(max(value), 6) AS top FROM f GROUP BY 1")
def _bundle(spark, sf_dir):
    """A line for each operator: its findings, their entities, the greatest value."""
    return _found(spark, sf_dir).groupBy("plugin_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("entities"), F.round(F.max("value"), 6).alias("top"))


@register("report_decision_bundle_v2", WAITS + """,
r AS (SELECT lever, entity, round(value / least, 6) AS strength FROM f JOIN (VALUES ('tail', 'isolate_process', 100000.0::DOUBLE), ('retry', 'retry_backoff', 0.15::DOUBLE), ('capacity', 'add_server', 0.5::DOUBLE)) v(kind, lever, least) USING (kind) WHERE value >= least)
SELECT row_number() OVER (ORDER BY strength DESC, lever, entity) AS place, lever, entity, strength FROM r QUALIFY place <= 5""")
def _decisions(spark, sf_dir):
    """The five strongest levers in order."""
    top = levers(_found(spark, sf_dir)).orderBy(F.col("strength").desc(), "lever", "entity").limit(5)
    return top.select(F.row_number().over(Window.orderBy(F.col("strength").desc(), "lever", "entity")).cast("long").alias("place"), "lever", "entity", "strength")


@register("report_slide_kit_emitter_v2", WAITS.split(",\nk AS")[0] + """
, p AS (SELECT process, count(*) AS runs, sum(wait) / 3600 AS h FROM l WHERE wait IS NOT NULL GROUP BY 1), s AS (SELECT count(DISTINCT user_id) AS n FROM l WHERE wait IS NOT NULL)
SELECT process, runs, round(h, 4) AS hours, round(h - h * n / (n + 1), 4) AS saved_plus_one, round(h * 0.1, 4) AS saved_ten_percent FROM p, s ORDER BY h DESC, process LIMIT 10""")
def _slides(spark, sf_dir):
    """Processes by hours waited, with what one more server and a tenth less would save."""
    waits = log_waits(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "ts", "event_id", "event_type")
    own = waits.groupBy("process").agg(F.count("*").alias("runs"), (F.sum("wait") / 3600).alias("h"))
    both = own.crossJoin(F.broadcast(waits.agg(F.count_distinct("case_id").alias("n")))).orderBy(F.col("h").desc(), "process").limit(10)
    return both.select("process", "runs", F.round("h", 4).alias("hours"), F.round(F.col("h") - F.col("h") * F.col("n") / (F.col("n") + 1), 4).alias("saved_plus_one"), F.round(F.col("h") * 0.1, 4).alias("saved_ten_percent"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register("report_evidence_index_v1", " UNION ALL ".join(f"SELECT '{t}' AS artifact, count(*) AS rows FROM {t}" for t in TABLES))
def _evidence(spark, sf_dir):
    """Tables with their numbers of rows, from the files' own counts."""
    out = [spark.read.parquet(f"{sf_dir}/{t}.parquet").agg(F.lit(t).alias("artifact"), F.count("*").alias("rows")) for t in TABLES]
    first = out[0]
    for df in out[1:]:
        first = first.unionByName(df)
    return first


def server_levers(waits: DataFrame, share: float = 0.01, over: float = 21600.0) -> DataFrame:
    """Pairs of process and server (case) that hold at least ``share`` of a process's long waits: hours over an even spread."""
    long = F.when(F.col("wait") > over, F.col("wait")).otherwise(0.0) / 3600
    pairs = waits.groupBy("process", "case_id").agg(F.sum(long).alias("h"))
    own = pairs.groupBy("process").agg(F.sum("h").alias("every"), F.count("*").alias("servers"))
    both = pairs.join(F.broadcast(own), "process").where((F.col("h") > 0) & (F.col("h") >= share * F.col("every")))
    return both.select("process", F.col("case_id").alias("server"), F.round("h", 6).alias("hours"), F.round(F.greatest(F.lit(0.0), F.col("h") - F.col("every") / F.col("servers")), 6).alias("delta_hours"), F.round(F.col("h") / F.col("every"), 9).alias("share"))


@register("process_server_levers_v1", WAITS.split(",\nk AS")[0] + """
, p AS (SELECT process, user_id::VARCHAR AS server, sum(CASE WHEN wait > 21600 THEN wait ELSE 0 END) / 3600 AS h FROM l WHERE wait IS NOT NULL GROUP BY ALL), t AS (SELECT process, sum(h) AS every, count(*) AS n FROM p GROUP BY 1)
SELECT process, server, round(h, 6) AS hours, round(greatest(0, h - every / n), 6) AS delta_hours, round(h / every, 9) AS share FROM p JOIN t USING (process) WHERE h > 0 AND h >= 0.01 * every""")
def _servers(spark, sf_dir):
    return server_levers(log_waits(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "ts", "event_id", "event_type"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two runs side by side: added, removed, changed or same, and by how much."""
    both = a.select(*keys, F.col(value).alias("before")).join(b.select(*keys, F.col(value).alias("after")), keys, "full")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.select(*keys, state.alias("state"), F.round(F.col("after") - F.col("before"), 6).alias("delta"))


@register("run_comparison", """
WITH a AS (SELECT event_type AS k, count(*) AS v FROM events WHERE day(ts) <= 15 AND event_type <> 'view' GROUP BY 1), b AS (SELECT event_type AS k, count(*) AS v FROM events WHERE day(ts) > 15 AND event_type <> 'error' GROUP BY 1)
SELECT k, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state, round((b.v - a.v)::DOUBLE, 6) AS delta FROM a FULL JOIN b USING (k)""")
def _compare(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "k")
    n = lambda w: rows.where(w).groupBy("k").agg(F.count("*").cast("double").alias("v"))
    return compare_runs(n("day(ts) <= 15 AND k <> 'view'"), n("day(ts) > 15 AND k <> 'error'"), ["k"], "v")


def evaluate(found: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """Expected rows (entity, metric, value) against findings: missing, within the relative tolerance, or off."""
    both = expected.select("entity", "metric", F.col("value").alias("want")).join(found.select("entity", "metric", "value"), ["entity", "metric"], "left")
    off = F.abs(F.col("value") - F.col("want")) / F.greatest(F.abs("want"), F.lit(1e-12))
    return both.select("entity", "metric", F.when(F.col("value").isNull(), "missing").when(off <= tolerance, "ok").otherwise("off").alias("verdict"))


@register("evaluate_expected", WAITS + """,
e AS (SELECT entity, metric, value * CASE entity WHEN 'view' THEN 1.2 ELSE 1.01 END AS want FROM f WHERE kind = 'tail' UNION ALL SELECT 'nothing', 'p95_wait_s', 1.0)
SELECT entity, metric, CASE WHEN value IS NULL THEN 'missing' WHEN abs(value - want) / greatest(abs(want), 1e-12) <= 0.05 THEN 'ok' ELSE 'off' END AS verdict FROM e LEFT JOIN (SELECT entity, metric, value FROM f) USING (entity, metric)""")
def _evaluate(spark, sf_dir):
    found = _found(spark, sf_dir)
    want = found.where("kind = 'tail'").select("entity", "metric", (F.col("value") * F.when(F.col("entity") == "view", 1.2).otherwise(1.01)).alias("value"))
    return evaluate(found, want.unionByName(spark.createDataFrame([("nothing", "p95_wait_s", 1.0)], want.schema)), 0.05)


def row_trace(output: DataFrame, source: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """Source rows behind each output row, as their number and smallest and greatest id, by the keys both have."""
    return output.select(*keys).join(source, keys).groupBy(*keys).agg(F.count("*").alias("rows"), F.min(ids).alias("first_id"), F.max(ids).alias("last_id"))


@register("row_trace", "SELECT event_type, ts::DATE AS day, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def _row_trace(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    return row_trace(rows.where("event_type IN ('view', 'click')").select("event_type", "day").distinct(), rows, ["event_type", "day"], "event_id")
