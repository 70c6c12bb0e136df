"""Relational primitives: filters, joins of each kind, windows, buckets, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.plans.plan import table
from quarrystat.plans.registry import add_plan, register
from quarrystat.plans.selection import quantiles

orders, items, customers, suppliers, parts, nations, regions, events = (
    table(t) for t in ("orders", "lineitem", "customer", "supplier", "part", "nation", "region", "events")
)
REV = "l_extendedprice * (1 - l_discount)"

PLANS = {
    "filter_between_in": items.where("l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_discount IS NOT NULL").agg("l_returnflag", n="count(*)", qty="round(sum(l_quantity), 4)"),
    "filter_wrap_day_window": events.add(d="CAST(day(ts) AS BIGINT)").where("d >= 20 OR d <= 5").agg("d", n="count(*)"),
    "filter_invalid_strings": events.where("lower(trim(event_type)) NOT IN ('', 'nan', 'none', 'null')").agg("event_type", n="count(*)"),
    "hash_aggregate": items.agg("l_returnflag", "l_linestatus", n="count(*)", qty="round(sum(l_quantity), 4)", mean="round(avg(l_extendedprice), 6)", lo="min(l_discount)", hi="max(l_tax)"),
    "distinct_aggregate": events.agg("event_type", users="count(DISTINCT user_id)", n="count(*)"),
    "conditional_having": orders.agg("o_custkey", n="count(*)", late="CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT)").where("n >= 5"),
    "pivot_crosstab": items.agg("l_returnflag", o="CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT)", f="CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT)"),
    "group_slices": items.agg("l_returnflag", n="count(*)").select("n", slice="concat('l_returnflag=', l_returnflag)")
    .union(items.agg("l_linestatus", n="count(*)").select("n", slice="concat('l_linestatus=', l_linestatus)"))
    .union(items.agg(n="count(*)").select("n", slice="'ALL'")),
    "inner_join": orders.select("o_orderkey", "o_orderpriority").join(items.select("l_quantity", o_orderkey="l_orderkey"), "o_orderkey").agg("o_orderpriority", qty="round(sum(l_quantity), 4)", n="count(*)"),
    "star_join": items.select("l_suppkey", rev=REV).select("rev", s_suppkey="l_suppkey").join(suppliers.select("s_suppkey", n_nationkey="s_nationkey"), "s_suppkey").join(nations.select("n_nationkey", "n_name", r_regionkey="n_regionkey"), "n_nationkey").join(regions, "r_regionkey").agg("r_name", "n_name", revenue="round(sum(rev), 2)"),
    "left_outer_join": customers.select("c_custkey").join(orders.agg("o_custkey", n="count(*)").select("n", c_custkey="o_custkey"), "c_custkey", how="left").select("c_custkey", n="coalesce(n, 0)"),
    "full_outer_join": orders.where("o_totalprice > 250000").agg("o_custkey", a="count(*)").join(orders.where("o_totalprice < 50000").agg("o_custkey", b="count(*)"), "o_custkey", how="full").select("o_custkey", delta="coalesce(a, 0) - coalesce(b, 0)"),
    "semi_join": customers.select("c_custkey", "c_mktsegment").join(orders.where("o_totalprice > 300000").select(c_custkey="o_custkey"), "c_custkey", how="semi").agg("c_mktsegment", n="count(*)"),
    "anti_join": customers.select("c_custkey", "c_mktsegment").join(orders.select(c_custkey="o_custkey"), "c_custkey", how="anti").agg("c_mktsegment", n="count(*)"),
    "range_join": events.select("event_id", "value").within(events.agg("event_type", lo="PCT(value, 0.4)", hi="PCT(value, 0.45)"), "value >= lo AND value < hi").agg("event_type", n="count(*)"),
    "asof_backward": events.add(last_buy="max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").select("event_id", "user_id", age="(US(ts) - US(last_buy)) / 1000000.0").where("age <= 172800").select("event_id", "user_id", age="round(age, 3)"),
    "pairwise_self_join": orders.agg("o_orderpriority", n="count(*)").within(orders.agg("o_orderpriority", m="count(*)").select("m", other="o_orderpriority"), "o_orderpriority < other").select("o_orderpriority", "other", delta="n - m"),
    "window_lead_lag": events.add(gap="US(ts)").add(prev="lag(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id)").select("event_id", gap_s="round((gap - prev) / 1000000.0, 3)"),
    "window_cumulative": events.select("event_id", cum="round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4)", peak="max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "window_moving_mean": events.add(n="count(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", m="avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)").select("event_id", mean="CASE WHEN n >= 5 THEN round(m, 6) END"),
    "window_centred_mean": events.select("event_id", mean="round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6)"),
    "window_rank_average": orders.select("o_orderkey", r="rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0").select("o_orderkey", r="CAST(r AS DOUBLE)"),
    "window_ntile": events.select("event_id", q="CAST(ntile(5) OVER (PARTITION BY event_type ORDER BY value, event_id) AS BIGINT)"),
    "time_bucket_hour": events.agg("event_type", h="0").select("event_type").join(events.add(hour="date_trunc('hour', ts)").agg("event_type", "hour", n="count(*)"), "event_type"),
    "top_k_per_group": orders.add(k="row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)").where("k <= 5").select("o_orderpriority", "o_orderkey", k="CAST(k AS BIGINT)"),
    "top_k": orders.agg("o_custkey", total="round(sum(o_totalprice), 2)").top("total DESC, o_custkey", 10),
    "dedup_first": orders.add(k="row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)").where("k = 1").select("o_custkey", "o_orderkey"),
    "union_all": events.where("event_type = 'error'").select("user_id", kind="'error'").union(events.where("event_type = 'signup'").select("user_id", kind="'signup'")).agg("kind", n="count(*)", users="count(DISTINCT user_id)"),
    "string_normalise": parts.select("p_partkey", name="lower(trim(p_name))", brand="RSUB(p_brand, '[^0-9]', '')"),
    "date_parts": events.add(h="hour(ts)", d="CAST(day(ts) AS BIGINT)", m="CAST(month(ts) AS BIGINT)").agg("m", "d", n="count(*)", after_hours="CAST(sum(CASE WHEN h < 8 OR h >= 18 THEN 1 ELSE 0 END) AS BIGINT)"),
    "close_month": events.select("event_id", m="CAST(CASE WHEN day(ts) <= 5 THEN year(ts) * 12 + month(ts) - 2 ELSE year(ts) * 12 + month(ts) - 1 END AS BIGINT)").agg("m", n="count(*)"),
    "json_field": events.select("event_type", k="CAST(JGET(props, '$.k') AS BIGINT)").agg("event_type", n="count(k)", mean="round(avg(k), 6)"),
    "sessionise_gaps": events.add(t="US(ts)").add(gap="t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id)").add(s="sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").agg("user_id", "s", n="count(*)", span="round((max(t) - min(t)) / 1000000.0, 3)").select("user_id", "n", "span", session="CAST(s AS BIGINT)"),
    "log_masks": events.select(m="RSUB(RSUB(props, '[0-9a-f]{8,}', '<hex>'), '[0-9]+', '<num>')").agg("m", n="count(*)"),
}

for _name, _plan in PLANS.items():
    add_plan(_name, _plan)


@register(
    "exact_quantiles",
    "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
)
def _quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By selection, so that no buffer holds a type's values."""
    wanted = {"p05": ("value", 0.05), "p50": ("value", 0.5), "p95": ("value", 0.95)}
    found = quantiles(events.df(spark, sf_dir), ["event_type"], wanted)
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in wanted])
