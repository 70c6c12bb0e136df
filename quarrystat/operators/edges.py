"""Edge-list, two-sample, surface and map operators as plans.

The edge list is trade between nations, so its size is bounded by the number of nations squared. Two-sample statistics need
the pooled order within an event type; series work on hourly buckets.
"""

from __future__ import annotations

from quarrystat.operators.buckets import BY, days, hours, robust
from quarrystat.operators.statistics import ks
from quarrystat.plans.plan import Plan, table
from quarrystat.plans.registry import add_plan

events, items = table("events"), table("lineitem")
sold = (
    table("orders").select("o_orderkey", c_custkey="o_custkey", t="US(o_orderdate)").join(table("customer").select("c_custkey", src="c_nationkey"), "c_custkey")
    .join(items.select(o_orderkey="l_orderkey", s_suppkey="l_suppkey", price="l_extendedprice"), "o_orderkey").join(table("supplier").select("s_suppkey", dst="s_nationkey"), "s_suppkey")
)


def weighted(source: Plan, *keys: str) -> Plan:
    """All distinct edges with their number and mean price; no loops."""
    return source.where("src <> dst").agg(*keys, "src", "dst", n="count(*)", w="round(avg(price), 4)")


trade = weighted(sold)
halved = weighted(sold.halve("t", "o_orderkey", "s_suppkey", "price"), "early")
few = trade
back = trade.select(src="dst", dst="src", m="n")
both = trade.select("src", "dst", "n", "w").union(trade.select("n", "w", src="dst", dst="src")).agg("src", "dst", n="CAST(sum(n) AS BIGINT)", w="avg(w)")
node = both.agg("src", k="count(*)", own="avg(w)", sd="stddev_pop(w)")
tie = both.add(p="n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE)").select("src", "dst", "p")
indirect = tie.select("src", q="dst", p1="p").join(tie.select("dst", q="src", p2="p"), "q").where("src <> dst").agg("src", "dst", through="sum(p1 * p2)")
pooled = ks.add(n1="CAST(sum(a) OVER (PARTITION BY event_type) AS DOUBLE)", n2="CAST(sum(b) OVER (PARTITION BY event_type) AS DOUBLE)", nxt="lead(value) OVER (PARTITION BY event_type ORDER BY value)").add(hn="fa * n1 + fb * n2", big="n1 + n2")
pval = pooled.agg("event_type", d="max(abs(fa - fb))", e="sqrt(max(n1 * n2 / (n1 + n2)))").add(lam="(e + 0.12 + 0.11 / e) * d").add(p="least(1.0, 2.0 * exp(-2.0 * lam * lam))")
NEAR = "OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN {} AND {})"
steps = hours.add(d=f"abs(v - lag(v) {BY})", d2=f"lead(v) {BY} - 2 * v + lag(v) {BY}", d4=f"lead(v, 2) {BY} - 2 * v + lag(v, 2) {BY}", d8=f"lead(v, 4) {BY} - 2 * v + lag(v, 4) {BY}")
calibrated = steps.add(lim=f"PCT(d, 0.9) {NEAR.format('48 PRECEDING', '1 PRECEDING')}").where("i > 48")
medians = hours.add(b=f"PCT(v, 0.5) {NEAR.format('12 PRECEDING', '1 PRECEDING')}", a=f"PCT(v, 0.5) {NEAR.format('CURRENT ROW', '11 FOLLOWING')}").where("i > 12 AND i <= size - 11")
fence = hours.join(hours.agg("event_type", q1="PCT(v, 0.25)", q3="PCT(v, 0.75)"), "event_type").add(out="CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END")
runs = fence.add(g="i - row_number() OVER (PARTITION BY event_type, out ORDER BY h)").where("out = 1").agg("event_type", "g", length="count(*)")
PARTS = {"x": "l_quantity", "y": "l_discount", "z": "l_tax"}
centre = {f"g{c}": f"PCT({v}, 0.5)" for c, v in PARTS.items()}
scale = items.agg(**centre, **{f"s{c}": f"stddev_pop({v})" for c, v in PARTS.items()})
vectors = items.agg("l_returnflag", **{c: f"PCT({v}, 0.5)" for c, v in PARTS.items()}).cross(scale)
DOT = lambda a, b: " + ".join(f"{a.format(c)} * {b.format(c)}" for c in "xyz")
COS = f"round(({DOT('({0} / s{0})', '(g{0} / s{0})')}) / sqrt(({DOT('({0} / s{0})', '({0} / s{0})')}) * ({DOT('(g{0} / s{0})', '(g{0} / s{0})')})), 9)"
pair = items.agg(**{f"{g}{c}": f"PCT(CASE WHEN l_linestatus = '{g}' THEN {v} END, 0.5)" for g in "OF" for c, v in PARTS.items()}).cross(scale)
NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def profile(column: str) -> Plan:
    return items.agg(rows="count(*)", missing=f"count(*) - count({column})", unique_=f"count(DISTINCT {column})", low=f"min({column})", high=f"max({column})", mean=f"round(avg({column}), 7)", sd=f"round(stddev_pop({column}), 6)").add(name=f"'{column}'")


profiles = profile(NUMERIC[0])
for _column in NUMERIC[1:]:
    profiles = profiles.union(profile(_column))
ext = items.agg(**{f"{s}{c}": f"{f}({v})" for c, v in PARTS.items() for s, f in (("l", "min"), ("h", "max"))})
parts = items.select("l_returnflag", a="l_quantity", b="l_extendedprice", c="l_tax + 0.01").add(g="(ln(a) + ln(b) + ln(c)) / 3.0")
waits = events.add(wait="(US(ts) - lag(US(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0").add(d="date_trunc('day', ts)")
daily = waits.agg("d", users="count(DISTINCT user_id)", med="PCT(wait, 0.5)")
energy = events.join(events.agg("event_type", mu="avg(value)", sd="stddev_pop(value)"), "event_type").agg("event_type", s1="sum(exp(-0.5 * power((value - mu) / sd, 2)))", s2="sum(exp(-power((value - mu) / sd, 2)))", n="count(*)")

PLANS = {
    "structural_holes_broker_v1": tie.join(indirect, "src", "dst", how="left").agg("src", constraint_="round(sum(power(p + coalesce(through, 0.0), 2)), 6)"),
    "thermohaline_circulation_v1": trade.join(back, "src", "dst", how="left").agg(ratio="round(avg(CASE WHEN m IS NOT NULL THEN 1.0 ELSE 0.0 END), 9)", edges="count(*)"),
    "navier_stokes_backpressure_v1": trade.join(node.select(dst="src", down="own"), "dst").join(node.select("src", "own"), "src").agg("src", pressure="round(avg(down) / max(own), 6)"),
    "sheaf_consistency_v1": both.join(node.select(dst="src", there="own", ds="sd"), "dst").join(node.select("src", "own", "sd"), "src").agg("src", gap="round(max(abs(there - own) / nullif(greatest(sd, ds), 0.0)), 5)"),
    "operad_composition_v1": trade.select("src", mid="dst", w1="w").join(trade.select("dst", mid="src", w2="w"), "mid").agg("src", "dst", composed="PCT(w1 + w2, 0.5)").join(trade, "src", "dst").where("abs(composed - w) > 0.3 * w").agg(n="count(*)", ratio="round(avg(composed / w), 6)"),
    "dataflow_dead_output_v1": few.agg("dst", preds="count(*)", src="min(src)").join(few.select(dst="src", any_="n"), "dst", how="anti").where("preds = 1").join(few.agg("src", outs="count(*)").where("outs > 1"), "src").select("dst", "src"),
    "sir_failure_cascade_v1": node.agg(k="avg(k)").add(r0="0.3 * k / 0.1").select(r0="round(r0, 6)", peak="round(CASE WHEN r0 > 1 THEN 1.0 - (1.0 + ln(r0)) / r0 ELSE 0.0 END, 6)"),
    "graph_assortativity_shift_v1": halved.join(halved.agg("early", "src", od="count(*)"), "early", "src").join(halved.agg("early", "dst", id_="count(*)"), "early", "dst").agg("early", r="round(covar_pop(od, id_) / nullif(stddev_pop(od) * stddev_pop(id_), 0.0), 6)", edges="count(*)").select("r", "edges", early="CAST(early AS BIGINT)"),
    "graph_motif_triads_shift_v1": halved.select("early", a="src", b="dst").join(halved.select("early", b="src", c="dst"), "early", "b").where("a <> c").join(halved.select("early", a="src", c="dst", closed="1"), "early", "a", "c", how="left").agg("early", triads="count(*)", closed="count(closed)").select("triads", "closed", early="CAST(early AS BIGINT)"),
    "energy_distance_two_sample_v1": pooled.where("nxt IS NOT NULL").agg("event_type", energy="round(2.0 * sum((fa - fb) * (fa - fb) * (nxt - value)), 6)"),
    "two_sample_numeric_ad": pooled.where("hn < big - 0.5").agg("event_type", a2="round(sum((a + b) * power(fa * n1 * big - n1 * hn, 2) / (hn * (big - hn))) / max(n1 * n2), 5)"),
    "online_conformal_changepoint": calibrated.agg("event_type", alarms="CAST(sum(CASE WHEN d > lim THEN 1 ELSE 0 END) AS BIGINT)", n="count(*)"),
    "bayesian_online_changepoint_studentt_v1": medians.join(robust.agg("event_type", mad="max(mad)"), "event_type").agg("event_type", score="round(max(abs(a - b)) / nullif(max(mad), 0.0), 5)"),
    "defect_density_classification_v1": runs.agg("event_type", points="CAST(sum(CASE WHEN length = 1 THEN 1 ELSE 0 END) AS BIGINT)", lines="CAST(sum(CASE WHEN length BETWEEN 2 AND 4 THEN 1 ELSE 0 END) AS BIGINT)", planes="CAST(sum(CASE WHEN length > 4 THEN 1 ELSE 0 END) AS BIGINT)"),
    "surface_roughness_metrics": steps.add(turn="CASE WHEN (v - mv) * (lag(v) OVER (PARTITION BY event_type ORDER BY h) - mv) < 0 THEN 1.0 ELSE 0.0 END").agg("event_type", rough="round(stddev_pop(d), 5)", mad="round(PCT(d, 0.5), 5)", crossings="CAST(sum(turn) AS BIGINT)"),
    "surface_multiscale_wavelet_curvature": steps.agg("event_type", one="round(avg(abs(d2)), 5)", two="round(avg(abs(d4)), 5)", four="round(avg(abs(d8)), 5)"),
    "bayesian_point_displacement": days.add(early="CASE WHEN i * 2 <= size THEN 1 ELSE 0 END").agg("event_type", a="avg(CASE WHEN early = 1 THEN v END)", b="avg(CASE WHEN early = 0 THEN v END)", se="var_samp(v) / count(*) * 4.0").add(tau="avg((b - a) * (b - a)) OVER ()").select("event_type", shift="round((b - a) * tau / (tau + se), 5)"),
    "topographic_similarity_angle_projection": vectors.select("l_returnflag", cosine=COS),
    "topographic_angle_dynamics": items.add(y_="CAST(year(l_shipdate) AS BIGINT)").agg("y_", **{c: f"PCT({v}, 0.5)" for c, v in PARTS.items()}).cross(scale).select("y_", cosine=COS),
    "map_permutation_test_karniski": pair.select(norm="round(sqrt(" + " + ".join(f"power((O{c} - F{c}) / s{c}, 2)" for c in "xyz") + "), 9)"),
    "csp_binding_rules_v1": items.cross(ext).agg(**{c: f"round(avg(CASE WHEN {v} <= l{c} + 0.05 * (h{c} - l{c}) + 0.000001 OR {v} >= h{c} - 0.05 * (h{c} - l{c}) - 0.000001 THEN 1.0 ELSE 0.0 END), 9)" for c, v in PARTS.items()}),
    "compositional_logratio_v1": parts.agg("l_returnflag", a="round(avg(ln(a) - g), 6)", b="round(avg(ln(b) - g), 6)", c="round(avg(ln(c) - g), 6)"),
    "partition_function_landscape_v1": energy.select("event_type", states="round(s1 * s1 / s2, 3)", share="round(s1 * s1 / s2 / n, 6)"),
    "close_cycle_capacity_impact": daily.cross(daily.agg(cut="PCT(users, 0.5)")).agg(high="PCT(CASE WHEN users > cut THEN med END, 0.5)", low="PCT(CASE WHEN users <= cut THEN med END, 0.5)").select(impact="round(high - low, 3)"),
    "profile_basic": profiles,
}

for _name, _plan in PLANS.items():
    add_plan(_name, _plan)
