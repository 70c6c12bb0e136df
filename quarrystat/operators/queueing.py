"""Event-log and queueing operators: waits, bottlenecks, concurrency, variants, counterfactuals, close windows.

Role mapping: case and host = user_id, activity and process = event_type, queue time = the case's previous event, start = ts.
Windows run within a case or group, never over the whole table.
"""

from __future__ import annotations

from quarrystat.plans.plan import Plan, table
from quarrystat.plans.registry import add_plan

CASE = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND"

events = table("events").add(t="US(ts)")
log = (
    events.add(prev_t=f"lag(t) {CASE}", prev_type=f"lag(event_type) {CASE}", nxt=f"lead(event_type) {CASE}", nxt2=f"lead(event_type, 2) {CASE}")
    .add(wait="CASE WHEN prev_t IS NOT NULL THEN greatest(0.0, (t - prev_t) / 1000000.0) END")
    .add(day="date_trunc('day', ts)", hour="CAST(hour(ts) AS BIGINT)", dom="CAST(day(ts) AS BIGINT)")
)
halved = log.halve("t", "event_id")
THRESHOLD = 21600  # seconds of wait that count as long
long_wait = log.add(over=f"CASE WHEN wait > {THRESHOLD} THEN wait ELSE 0.0 END").where("wait IS NOT NULL")
bigrams = log.where("nxt IS NOT NULL").agg("event_type", "nxt", n="count(*)")
trigrams = log.where("nxt2 IS NOT NULL").agg("event_type", "nxt", "nxt2", n="count(*)")
close = log.add(is_close="CASE WHEN dom >= 20 OR dom <= 5 THEN 1 ELSE 0 END")
daily = log.agg("day", n="count(*)", p95="PCT(wait, 0.95)", med="PCT(wait, 0.5)")


def flags(column: str, values: str) -> str:
    return f"CAST(sum(CASE WHEN {values} THEN {column} ELSE 0 END) AS BIGINT)"


def halves(keys: tuple[str, ...], source: Plan = halved) -> Plan:
    """Counts by key in the early and the late half."""
    return source.agg(*keys, a="CAST(sum(early) AS BIGINT)", b="CAST(sum(1 - early) AS BIGINT)")


def entropy(counts: Plan, *keys: str) -> Plan:
    """Shannon entropy in bits of ``n`` within ``keys``."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return counts.add(p=f"n / CAST(sum(n) OVER ({part}) AS DOUBLE)").agg(*keys, h="round(-sum(p * ln(p)) / ln(2), 6)")


def savings(key: str) -> Plan:
    """Over-threshold wait per run against the lower quartile of the groups' averages."""
    groups = long_wait.agg(key, n="count(*)", total="sum(over)").where("n >= 5").add(per_run="total / n")
    return (
        groups.cross(groups.agg(base="PCT(per_run, 0.25)")).add(modeled="least(total, base * n)")
        .select(key, "n", total_h="round(total / 3600.0, 6)", delta_h="round((total - modeled) / 3600.0, 6)")
    )


islands = (
    long_wait.where("over > 0").select("user_id", "event_type", s="prev_t", e="t", w="wait")
    .add(reach=f"max(e) OVER (PARTITION BY user_id ORDER BY s, e {UPTO} 1 PRECEDING)")
    .add(fresh="CASE WHEN reach IS NULL OR s > reach + 60000000 THEN 1 ELSE 0 END")
    .add(island=f"CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e {UPTO} CURRENT ROW) AS BIGINT)")
)
edges = log.where("prev_t IS NOT NULL").select("user_id", stamp="prev_t", d="1").union(log.where("prev_t IS NOT NULL").select("user_id", stamp="t", d="-1"))
sweep = edges.agg("user_id", "stamp", d="CAST(sum(d) AS BIGINT)").add(
    c=f"CAST(sum(d) OVER (PARTITION BY user_id ORDER BY stamp {UPTO} CURRENT ROW) AS BIGINT)",
    w="lead(stamp) OVER (PARTITION BY user_id ORDER BY stamp) - stamp",
)
chain = log.agg("user_id", n="count(*)", span="(max(t) - min(t)) / 1000000.0", run="sum(value)")
variants = log.where("nxt2 IS NOT NULL").agg("event_type", "nxt", "nxt2", n="count(*)")
rates = long_wait.agg("event_type", n="count(*)", bad="sum(CASE WHEN over > 0 THEN 1.0 ELSE 0.0 END)", m="avg(wait)", v="var_samp(wait)")

PLANS = {
    "percentile_analysis": log.agg("event_type", n="count(wait)", p50="round(PCT(wait, 0.5), 6)", p95="round(PCT(wait, 0.95), 6)", p99="round(PCT(wait, 0.99), 6)"),
    "attribution": long_wait.agg("event_type", v="sum(wait)", tail="sum(over)").select(dimension="'process'", k="event_type", wait_h="round(v / 3600.0, 6)", tail_h="round(tail / 3600.0, 6)")
    .union(long_wait.agg("user_id", v="sum(wait)", tail="sum(over)").top("v DESC, user_id", 20).select(dimension="'user'", k="CAST(user_id AS VARCHAR(20))", wait_h="round(v / 3600.0, 6)", tail_h="round(tail / 3600.0, 6)")),
    "tail_isolation": long_wait.where("over > 0").agg("event_type", n="count(*)", s="sum(over)").cross(long_wait.agg(every="sum(over)")).select("event_type", "n", share="round(s / every, 6)"),
    "queue_delay_decomposition": close.where("wait IS NOT NULL").agg("event_type", "is_close", n="count(*)", eligible_h="round(sum(wait) / 3600.0, 6)", over_h=f"round(sum(CASE WHEN wait > {THRESHOLD} THEN wait ELSE 0.0 END) / 3600.0, 6)").select("event_type", "n", "eligible_h", "over_h", is_close="CAST(is_close AS BIGINT)"),
    "busy_period_segmentation_v2": islands.agg("user_id", "island", n="count(*)", hours="round(sum(w) / 3600.0, 6)", span_h="round((max(e) - min(s)) / 3600000000.0, 6)", top="max_by(event_type, w)"),
    "capacity_scaling": long_wait.agg("event_type", total="sum(over)").cross(events.agg(h="count(DISTINCT user_id)")).select("event_type", total_h="round(total / 3600.0, 6)", modeled_h="round(total / (h + 1) * h / 3600.0, 6)"),
    "chain_makespan": chain.select("user_id", "n", span="round(span, 6)", idle="round(greatest(span - run, 0.0), 4)"),
    "concurrency_reconstruction": sweep.agg("user_id", peak="max(c)", mean="round(sum(c * w) / nullif(CAST(sum(w) AS DOUBLE), 0.0), 6)"),
    "dependency_resolution_join": events.select("event_id", "t", dep="event_id - 1").join(events.select(dep="event_id", dep_t="t"), "dep", how="left").agg(n="count(*)", found="count(dep_t)", p50="round(PCT((t - dep_t) / 1000000.0, 0.5), 6)"),
    "process_sequence_bottlenecks": log.where("wait IS NOT NULL").agg("prev_type", "event_type", n="count(*)", total_h="round(sum(wait) / 3600.0, 6)", p95="round(PCT(wait, 0.95), 6)"),
    "sequence_classification": events.select("event_type", dep="event_id * 2").join(events.select(dep="event_id"), "dep", how="semi").agg("event_type", sequence_runs="count(*)").join(events.agg("event_type", runs="count(*)"), "event_type"),
    "process_counterfactuals": savings("event_type"),
    "user_host_savings": savings("user_id"),
    "upload_linkage": log.add(up=f"max(CASE WHEN event_type = 'signup' THEN t END) OVER (PARTITION BY user_id ORDER BY ts, event_id {UPTO} 1 PRECEDING)").agg("event_type", n="count(*)", linked="CAST(sum(CASE WHEN t - up <= 172800000000 THEN 1 ELSE 0 END) AS BIGINT)"),
    "conformance_checking": bigrams.add(before="coalesce(sum(n) OVER (ORDER BY n DESC, event_type, nxt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").cross(bigrams.agg(every="CAST(sum(n) AS BIGINT)")).add(baseline="before < 0.9 * every").add(rate="sum(CASE WHEN baseline THEN n ELSE 0 END) OVER () / CAST(every AS DOUBLE)").select("event_type", "nxt", "n", "baseline", rate="round(rate, 9)"),
    "process_mining_discovery_v1": bigrams.top("n DESC, event_type, nxt", 10),
    "markov_transition_shift": halves(("event_type", "nxt")).where("nxt IS NOT NULL").select("event_type", "nxt", delta="abs(a - b)").top("delta DESC, event_type, nxt", 10),
    "sequential_patterns_prefixspan": bigrams.select("event_type", "nxt", support="n").top("support DESC, event_type, nxt", 10),
    "sequence_grammar_sequitur_v1": bigrams.where("n >= 10"),
    "ngram_step_transitions_v1": bigrams.select("n", gram="concat(event_type, '>', nxt)").union(trigrams.select("n", gram="concat(event_type, '>', nxt, '>', nxt2)")).add(rare="n < 3"),
    "entropy_rate_step_sequences_v1": entropy(log.agg("event_type", n="count(*)").select("n")).select(h1="h").cross(entropy(bigrams.select("n")).select(h2="h")).cross(entropy(trigrams.select("n")).select(h3="h")).select("h1", h_next="round(h2 - h1, 5)", h_second="round(h3 - h2, 5)"),
    "hold_time_attribution_v1": log.agg("event_type", hold_h="round(sum(wait) / 3600.0, 6)", share="round(sum(wait) / (sum(wait) + sum(value)), 6)", p95="round(PCT(wait, 0.95), 6)"),
    "retry_rate_hotspots_v1": log.where("prev_type IS NOT NULL").agg("event_type", n="count(*)", retry="round(avg(CASE WHEN prev_type = event_type THEN 1.0 ELSE 0.0 END), 9)"),
    "param_variant_explosion_v1": events.agg("event_type", runs="count(*)", variants="count(DISTINCT props)").select("event_type", "runs", "variants", ratio="round(variants / CAST(runs AS DOUBLE), 9)"),
    "waterfall_summary_v2": long_wait.agg(total="sum(over)", driver="sum(CASE WHEN event_type = 'purchase' THEN over ELSE 0.0 END)", h="count(DISTINCT user_id)").select(total_h="round(total / 3600.0, 6)", driver_h="round(driver / 3600.0, 6)", plus_one_h="round(total / 3600.0 * h / (h + 1), 6)", unexplained_h="round((total - driver) / 3600.0 * h / (h + 1), 6)"),
    "close_cycle_uplift": close.where("wait IS NOT NULL").agg("event_type", **{f"{m}_{w}": f"avg(CASE WHEN is_close = {c} THEN {v} END)" for m, v in (("wait", "wait"), ("duration", "value")) for w, c in (("closed", 1), ("opened", 0))}).add(wait_uplift="wait_closed / wait_opened", duration_uplift="duration_closed / duration_opened").add(place="rank() OVER (ORDER BY round(wait_uplift, 9) DESC)").select("event_type", place="CAST(place AS BIGINT)", closed="round(wait_closed, 6)", opened="round(wait_opened, 6)", wait_uplift="round(wait_uplift, 6)", duration_uplift="round(duration_uplift, 6)"),
    "close_cycle_change_point_v1": daily.add(k="ntile(10) OVER (ORDER BY day)").agg(ratio="round(avg(CASE WHEN k > 7 THEN p95 END) / avg(CASE WHEN k <= 3 THEN p95 END), 6)"),
    "close_cycle_capacity_model": daily.cross(daily.agg(mn="avg(n)", sn="stddev_pop(n)", mm="avg(med)", sm="stddev_pop(med)")).select("day", "n", pressure="round((n - mn) / nullif(sn, 0.0) + (med - mm) / nullif(sm, 0.0), 6)"),
    "close_cycle_revenue_compression": table("orders").add(m="date_trunc('month', o_orderdate)").agg("m", n="count(*)", span_d="(US(max(o_orderdate)) - US(min(o_orderdate))) / 86400000000.0").select("m", "n", scale="round(span_d / 7.0, 6)"),
    "littles_law_consistency": sweep.agg("user_id", load="sum(c * w) / nullif(CAST(sum(w) AS DOUBLE), 0.0)").join(log.agg("user_id", lam="count(wait) / nullif((max(t) - min(t)) / 1000000.0, 0.0)", w="avg(wait)"), "user_id").select("user_id", load="round(load, 6)", law="round(lam * w, 6)"),
    "queue_model_fit": log.agg("event_type", lam="1.0 / avg(wait)", mu="1.0 / avg(value)").select("event_type", lam="round(lam, 9)", mu="round(mu, 9)", rho="round(lam / mu, 9)"),
    "kingman_vut_approx": log.agg("event_type", ma="avg(wait)", va="var_pop(wait)", ms="avg(value)", vs="var_pop(value)").add(rho="ms / ma").select("event_type", wq="round(rho / (1.0 - rho) * (va / (ma * ma) + vs / (ms * ms)) / 2.0 * ms, 6)"),
    "hawkes_self_exciting": log.agg("event_type", cv="round(stddev_pop(wait) / avg(wait), 6)"),
    "etas_self_exciting_cascade_v1": log.join(log.agg("event_type", m="avg(wait)"), "event_type").agg("event_type", share="round(avg(CASE WHEN wait < 0.3 * m THEN 1.0 ELSE 0.0 END), 6)"),
    "hrv_intercompletion_v1": log.add(prev_wait=f"lag(wait) {CASE}").agg("user_id", sdnn="round(stddev_pop(wait), 6)", rmssd="round(sqrt(avg((wait - prev_wait) * (wait - prev_wait))), 6)").where("rmssd IS NOT NULL"),
    "marked_point_process_intensity_v1": log.add(h="date_trunc('hour', ts)").agg("event_type", "h", n="count(*)").agg("event_type", p95="round(PCT(n, 0.95), 6)", hours="count(*)"),
    "circular_time_of_day_drift_v1": halved.add(a="hour * 2.0 * pi() / 24.0").agg(**{f"{x}{e}": f"avg(CASE WHEN early = {e} THEN {f}(a) END)" for x, f in (("c", "cos"), ("s", "sin")) for e in (0, 1)}).add(m1="atan2(s1, c1)", m0="atan2(s0, c0)", r1="sqrt(c1 * c1 + s1 * s1)", r0="sqrt(c0 * c0 + s0 * s0)").add(d="m0 - m1").add(turn="abs(atan2(sin(d), cos(d)))").select(delta_mu_rad="round(turn, 6)", delta_r="round(r0 - r1, 6)", drifts="turn > 1.0 OR abs(r0 - r1) > 0.2"),
    "empirical_bayes_shrinkage_v1": rates.where("n >= 50").cross(rates.agg(tau2="var_samp(m)", grand="avg(m)")).select("event_type", "n", shrunk="round(n / (n + v / tau2) * m + (1.0 - n / (n + v / tau2)) * grand, 4)"),
    "buhlmann_credibility_v1": rates.cross(rates.agg(within="avg(v)", between="var_samp(m)")).select("event_type", z="round(n / (n + within / between), 6)"),
    "experience_rating_score_v1": rates.cross(long_wait.agg(grand="avg(wait)")).select("event_type", score="round(m / grand, 9)"),
    "fst_machine_differentiation_v1": rates.cross(long_wait.agg(total="var_pop(wait)", grand="avg(wait)")).agg(fst="round(sum(n * (m - grand) * (m - grand)) / sum(n) / max(total), 9)"),
    "climate_attribution_far_v1": long_wait.cross(long_wait.agg(p90="PCT(wait, 0.9)")).agg("event_type", rate="avg(CASE WHEN wait > p90 THEN 1.0 ELSE 0.0 END)").select("event_type", far="round(1.0 - 0.1 / nullif(rate, 0.0), 6)"),
    "lanchester_concentration_v1": events.agg("user_id", n="count(*)").agg(hhi="sum(n * n)", every="sum(n)").select(hhi="round(CAST(hhi AS DOUBLE) / (CAST(every AS DOUBLE) * CAST(every AS DOUBLE)), 9)"),
    "shannon_diversity_index_v1": entropy(events.agg("user_id", "event_type", n="count(*)"), "user_id"),
    "niche_overlap_pianka_v1": bigrams.join(events.agg("event_type", total="count(*)"), "event_type").select("event_type", "nxt", p="n / CAST(total AS DOUBLE)").join(bigrams.join(events.agg("event_type", total="count(*)"), "event_type").select("nxt", other="event_type", q="n / CAST(total AS DOUBLE)"), "nxt").where("event_type < other").agg("event_type", "other", overlap="round(sum(p * q) / sqrt(sum(p * p) * sum(q * q)), 6)"),
    "tfidf_step_importance_v1": events.agg("user_id", "event_type", tf="count(*)").join(events.agg("event_type", df="count(DISTINCT user_id)"), "event_type").cross(events.agg(docs="count(DISTINCT user_id)")).select("user_id", "event_type", score="round(tf * ln(docs / CAST(df AS DOUBLE)), 6)").top("score DESC, user_id, event_type", 10),
    "survival_time_to_event": log.agg("event_type", n="count(wait)", p50="round(PCT(wait, 0.5), 6)", p90="round(PCT(wait, 0.9), 6)", p99="round(PCT(wait, 0.99), 6)").where("n >= 100"),
    "win_probability_added_v1": long_wait.agg("event_type", won="sum(CASE WHEN over > 0 THEN 1.0 ELSE 0.0 END)", n="count(*)").cross(long_wait.agg(w="sum(CASE WHEN over > 0 THEN 1.0 ELSE 0.0 END)", m="count(*)")).select("event_type", wpa="round(won / n - (w - won) / (m - n), 9)"),
    "ooda_loop_bottleneck_v1": log.agg("event_type", med="PCT(wait, 0.5)").add(share="med / sum(med) OVER ()").select("event_type", share="round(share, 6)"),
    "reynolds_number_analogue_v1": log.agg("event_type", re="round(count(wait) / ((max(t) - min(t)) / 1000000.0) * stddev_pop(wait) / avg(wait) * PCT(wait, 0.95), 6)"),
    "fork_join_straggler_v1": log.where("wait IS NOT NULL").agg("user_id", worst="max_by(event_type, wait)").agg("worst", n="count(*)"),
}

for _name, _plan in PLANS.items():
    add_plan(_name, _plan)
