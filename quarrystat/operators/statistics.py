"""Drift, control charts, series, dependence, distribution and graph operators over grouped numeric data.

Series are the values of one event type in time order. Windows along them reach a few rows, so hours with borrowed neighbours
hold them (``plans.chunked``), and places come from counts of hours: no task holds an event type.
"""

from __future__ import annotations

from quarrystat.operators.queueing import THRESHOLD, entropy, halves, log
from quarrystat.plans.plan import Plan, table
from quarrystat.plans.registry import add_plan

SER = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"
FRAME = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {} AND {})"
items, docs = table("lineitem"), table("documents")
events = table("events").add(t="US(ts)")
ALONG = ("event_type", "ts, event_id")
series = events.place(*ALONG, "i").near(*ALONG, 1, prev=f"lag(value) {SER}").add(d="value - prev")
halved = events.halve("t", "event_id")
med = events.agg("event_type", m="PCT(value, 0.5)")
dev = events.join(med, "event_type").add(a="abs(value - m)")
robust = dev.join(dev.agg("event_type", mad="PCT(a, 0.5)"), "event_type").add(z="(value - m) / nullif(1.4826 * mad, 0.0)")
moments = events.agg("event_type", mu="avg(value)", sd="stddev_pop(value)", n="count(*)")
num = items.select("l_returnflag", x="l_quantity", y="l_extendedprice", z="l_discount", w="l_tax")
five = events.add(q="ntile(5) OVER (PARTITION BY event_type ORDER BY value, event_id)")
sized = events.place(*ALONG, "i").join(events.agg("event_type", every="count(*)"), "event_type").add(size="floor(every / 8.0)", more="every % 8")
eighths = sized.add(k="CASE WHEN i <= more * (size + 1) THEN ceil(i / (size + 1)) ELSE more + ceil((i - more * (size + 1)) / greatest(size, 1.0)) END")
chunks = eighths.agg("event_type", "k", m="avg(value)", s="stddev_pop(value)", n="count(*)", span="(max(t) - min(t)) / 1000000.0")
tokens = docs.select("doc_id", "lang", "source", "n_chars")
deg = table("orders").select(src="o_custkey", o_orderkey="o_orderkey").join(items.select(o_orderkey="l_orderkey", dst="l_suppkey"), "o_orderkey").agg("src", "dst", n="count(*)")
out_deg, in_deg = deg.agg("src", od="count(*)"), deg.agg("dst", id="count(*)")


def chi2(a: str, b: str, source: Plan) -> Plan:
    """Pearson's statistic and Cramer's V of two categories. All cells of the table count."""
    cells = source.agg(a, n_a="count(*)").cross(source.agg(n="count(*)")).within(source.agg(b, n_b="count(*)"), "true")
    seen = source.agg(a, b, o="count(*)")
    full = cells.join(seen, a, b, how="left").add(e="n_a * n_b / CAST(n AS DOUBLE)").add(x="(coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e")
    return full.agg(s="sum(x)", n="max(n)", ka=f"count(DISTINCT {a})", kb=f"count(DISTINCT {b})").select(
        chi2="round(s, 6)", cramers_v="round(sqrt(s / (n * nullif(least(ka, kb) - 1, 0))), 9)", df="(ka - 1) * (kb - 1)"
    )


def avg_rank(source: Plan, x: str, part: str) -> Plan:
    return source.add(r=f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0")


def corr(a: str, b: str) -> str:
    return f"round(corr({a}, {b}), 6)"


ranked = avg_rank(halved, "value", "event_type")
ks = halved.agg("event_type", "value", a="CAST(sum(early) AS BIGINT)", b="CAST(sum(1 - early) AS BIGINT)").add(
    fa="sum(a) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(a) OVER (PARTITION BY event_type) AS DOUBLE)",
    fb="sum(b) OVER (PARTITION BY event_type ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(b) OVER (PARTITION BY event_type) AS DOUBLE)",
)
rolling = series.near(*ALONG, 9, m=f"avg(value) {FRAME.format('9 PRECEDING', 'CURRENT ROW')}", s=f"stddev_pop(value) {FRAME.format('9 PRECEDING', 'CURRENT ROW')}")
around = series.near(*ALONG, 10, b=f"avg(value) {FRAME.format('10 PRECEDING', '1 PRECEDING')}", a=f"avg(value) {FRAME.format('CURRENT ROW', '9 FOLLOWING')}").add(delta="a - b")
digits = items.add(f="CAST(substr(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)), 1, 1) AS BIGINT)")
second = items.where("l_extendedprice >= 10").add(f="CAST(substr(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)), 2, 1) AS BIGINT)")
# users of equal counts share a stretch of ranks, so the window orders distinct counts only
ABOVE = "OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ranks = events.agg("user_id", n="count(*)").agg("n", f="count(*)").add(base=f"coalesce(sum(f) {ABOVE}, 0)", rows_above=f"coalesce(sum(f * n) {ABOVE}, 0)", every="sum(f * n) OVER ()").each("j", 1, "f").add(r="base + j", c="rows_above + j * n")
km = log.where("wait IS NOT NULL").add(h="floor(wait / 3600.0)").agg("event_type", "h", d="count(*)").add(
    at_risk="sum(d) OVER (PARTITION BY event_type ORDER BY h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)

PLANS = {
    "control_chart_individuals": robust.where("abs(z) > 4").agg("event_type", n="count(*)", latest="max(event_id)", worst="round(max(abs(z)), 6)"),
    "spc_cpk_capability_v1": moments.where("sd > 0").select("event_type", cp="round((mu + 3 * sd - (mu - 3 * sd)) / (6 * sd), 6)", cpk="round(least(mu + 3 * sd - mu, mu - (mu - 3 * sd)) / (3 * sd), 6)", mu="round(mu, 6)", sigma="round(sd, 6)", usl="round(mu + 3 * sd, 6)", lsl="round(mu - 3 * sd, 6)"),
    "change_impact_pre_post": halved.agg("event_type", a="PCT(CASE WHEN early = 1 THEN value END, 0.5)", b="PCT(CASE WHEN early = 0 THEN value END, 0.5)").select("event_type", delta="round(b - a, 6)"),
    "effect_size_report": items.agg(a="PCT(CASE WHEN l_returnflag = 'A' THEN l_quantity END, 0.5)", b="PCT(CASE WHEN l_returnflag <> 'A' THEN l_quantity END, 0.5)", s="stddev_pop(l_quantity)").select(effect="round((a - b) / s, 9)"),
    "changepoint_detection_v1": around.where("i > 10").agg("event_type", z="round(max(abs(delta)) / stddev_pop(delta), 6)"),
    "quantile_mapping_drift_qq_v1": halved.agg("event_type", **{f"{h}{q}": f"PCT(CASE WHEN early = {e} THEN value END, {q / 100})" for h, e in (("a", 1), ("b", 0)) for q in (10, 25, 50, 75, 90)}).select("event_type", d="round((" + " + ".join(f"abs(a{q} - b{q})" for q in (10, 25, 50, 75, 90)) + ") / 5.0, 6)"),
    "distribution_shift_wasserstein_v1": halved.add(k="floor(value / 10.0)").agg("event_type", "k", a="sum(early)", b="sum(1 - early)").add(c="abs(sum(a) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(a) OVER (PARTITION BY event_type) AS DOUBLE) - sum(b) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(b) OVER (PARTITION BY event_type) AS DOUBLE))").agg("event_type", w="round(sum(c) * 10.0, 6)"),
    "garch_volatility_shift_v1": series.join(events.agg("event_type", n="count(*)"), "event_type").agg("event_type", a="var_pop(CASE WHEN i <= n * 0.3 THEN d END)", b="var_pop(CASE WHEN i > n * 0.7 THEN d END)").select("event_type", ratio="round(b / a, 6)"),
    "permutation_entropy_drift_v1": entropy(halved.near(*ALONG, 2, b=f"lead(value) {SER}", c=f"lead(value, 2) {SER}").where("c IS NOT NULL").add(pat="concat(CASE WHEN value < b THEN 'u' ELSE 'd' END, CASE WHEN b < c THEN 'u' ELSE 'd' END, CASE WHEN value < c THEN 'u' ELSE 'd' END)").agg("early", "pat", n="count(*)"), "early").select("h", early="CAST(early AS BIGINT)"),
    "constraints_violation_detector_v1": halved.agg("early", n="count(*)", negative="round(avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END), 9)", fraction="round(avg(CASE WHEN value <> floor(value) THEN 1.0 ELSE 0.0 END), 9)").select("n", "negative", "fraction", early="CAST(early AS BIGINT)"),
    "template_drift_two_sample": halves(("m",), halved.add(m="RSUB(props, '[0-9]+', '<num>')")).select("m", delta="b - a"),
    "time_series_analysis_auto": series.agg("event_type", slope="round(regr_slope(value, i), 9)", n="count(*)"),
    "stl_seasonal_decompose_v1": series.add(k="i % 7").agg("event_type", "k", seasonal="round(avg(value), 6)", n="count(*)").select("event_type", "seasonal", "n", k="CAST(k AS BIGINT)"),
    "onset_detection_rhythm_v1": series.join(series.agg("event_type", mu="avg(abs(d))", sd="stddev_pop(abs(d))"), "event_type").agg("event_type", onsets="CAST(sum(CASE WHEN abs(d) > mu + 2 * sd THEN 1 ELSE 0 END) AS BIGINT)"),
    "haar_wavelet_transient_detector_v1": events.near(*ALONG, 8, c=f"avg(value) {FRAME.format('CURRENT ROW', '7 FOLLOWING')} - avg(value) {FRAME.format('8 PRECEDING', '1 PRECEDING')}").agg("event_type", peak="round(max(abs(c)), 6)"),
    "transfer_entropy_directional": items.add(p="lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice)").agg(r=corr("p", "l_extendedprice")),
    "lagged_predictability_test": series.agg("event_type", r=corr("prev", "value")),
    "granger_causality_v1": series.near(*ALONG, 1, pt=f"lag(t) {SER}").agg("event_type", r=corr("t - pt", "prev")),
    "teleconnection_lag_v1": events.near(*ALONG, 20, **{f"l{k}": f"lag(value, {k}) {SER}" for k in range(1, 21)}).agg("event_type", **{f"r{k}": corr(f"l{k}", "value") for k in range(1, 21)}),
    "pid_controller_analogue_v1": series.join(med, "event_type").add(e="value - m").running(*ALONG, "i_e", "e").near(*ALONG, 1, last=f"lag(e) {SER}").add(d_e="e - last").agg("event_type", p="var_pop(e)", i="var_pop(i_e)", d="var_pop(d_e)").select("event_type", p_share="round(p / (p + i + d), 6)", d_share="round(d / (p + i + d), 6)"),
    "soil_depletion_resource_v1": chunks.where("m > 0").agg("event_type", decay="round(regr_slope(ln(m), k), 6)"),
    "half_life_utilization_v1": chunks.where("m > 0").agg("event_type", decay="regr_slope(ln(m), k)").select("event_type", half_life="round(ln(2) / nullif(abs(decay), 0.0), 3)"),
    "creep_fatigue_prediction_v1": rolling.agg("event_type", slope="round(regr_slope(m, i), 9)", ratio="round(stddev_pop(value) / avg(value), 6)"),
    "wright_fisher_config_drift_v1": events.add(k="CAST(floor((day(ts) - 1) / 4.0) AS BIGINT)").agg("k", "event_type", n="count(*)").add(p="n / CAST(sum(n) OVER (PARTITION BY k) AS DOUBLE)").agg("event_type", drift="round(stddev_pop(p), 6)"),
    "salvo_burst_threshold_v1": rolling.agg("event_type", burst="round(max(m) / PCT(m, 0.5), 6)"),
    "fluid_model_backlog_v1": chunks.select("event_type", k="CAST(k AS BIGINT)", net="round(n / nullif(span, 0.0) - 1.0 / m, 9)"),
    "vo2max_capacity_ceiling_v1": chunks.add(rate="n / nullif(span, 0.0)").agg("event_type", top="round(max(rate), 9)", p75="round(PCT(rate, 0.75), 9)"),
    "chain_ladder_ibnr_v1": chunks.add(c="sum(n) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").add(f="c / CAST(lag(c) OVER (PARTITION BY event_type ORDER BY k) AS DOUBLE)").select("event_type", k="CAST(k AS BIGINT)", factor="round(f, 9)"),
    "benfords_law_anomaly_v1": digits.where("f > 0").agg("f", n="count(*)").add(every="CAST(sum(n) OVER () AS DOUBLE)", e="log10(1.0 + 1.0 / f)").add(gap="n / every - e").add(chi2="sum(every * gap * gap / e) OVER ()").select("f", "n", gap="round(gap, 9)", chi2="round(chi2, 5)"),
    "outlier_iqr": events.join(events.agg("event_type", q1="PCT(value, 0.25)", q3="PCT(value, 0.75)"), "event_type").where("value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)").agg("event_type", n="count(*)"),
    "mutual_information_screen": items.tiles("l_returnflag", keep="l_returnflag, l_quantity, l_extendedprice, l_orderkey, l_linenumber, l_partkey", a=(5, "l_quantity, l_orderkey, l_linenumber, l_extendedprice, l_partkey"), b=(5, "l_extendedprice, l_orderkey, l_linenumber, l_quantity, l_partkey")).agg("l_returnflag", "a", "b", n="count(*)").add(p="n / CAST(sum(n) OVER (PARTITION BY l_returnflag) AS DOUBLE)").add(pa="sum(p) OVER (PARTITION BY l_returnflag, a)", pb="sum(p) OVER (PARTITION BY l_returnflag, b)").agg("l_returnflag", mi="round(sum(p * ln(p / (pa * pb))), 6)"),
    "copula_dependence": avg_rank(avg_rank(table("orders").select("o_orderpriority", "o_totalprice", k="o_custkey"), "o_totalprice", "o_orderpriority").select("o_orderpriority", "k", rx="r"), "k", "o_orderpriority").agg("o_orderpriority", rho=corr("rx", "r")),
    "notears_linear": num.agg(xy="corr(x, y)", xz="corr(x, z)", xw="corr(x, w)", yz="corr(y, z)", yw="corr(y, w)", zw="corr(z, w)").select(**{p: f"CASE WHEN abs({p}) >= 0.2 THEN round({p}, 6) ELSE 0.0 END" for p in ("xy", "xz", "xw", "yz", "yw", "zw")}, edges="CAST(2 * (" + " + ".join(f"CASE WHEN abs({p}) >= 0.2 THEN 1 ELSE 0 END" for p in ("xy", "xz", "xw", "yz", "yw", "zw")) + ") AS BIGINT)"),
    "icp_invariant_causal_prediction_v1": items.add(env="l_suppkey % 5").agg("env", r="corr(l_quantity, l_extendedprice)", n="count(*)").agg(envs="count(*)", mean="avg(r)", spread="stddev_pop(r)", low="min(r)", high="max(r)").select("envs", mean="round(mean, 6)", spread="round(spread, 6)", invariant="spread < 0.1 AND low * high > 0"),
    "cronbach_alpha_consistency_v1": num.agg("l_returnflag", vs="var_samp(z + w)", vz="var_samp(z)", vw="var_samp(w)").select("l_returnflag", alpha="round(2.0 * (1.0 - (vz + vw) / vs), 6)"),
    "bullwhip_effect_detection_v1": num.agg("l_returnflag", ratio="round(var_pop(y) / var_pop(x), 2)"),
    "cuped_variance_reduction_v1": num.agg("l_returnflag", theta="covar_samp(x, y) / var_samp(x)", r="corr(x, y)").select("l_returnflag", theta="round(theta, 3)", reduction="round(r * r, 6)"),
    "dependency_graph_change_detection": items.add(t="US(l_shipdate)").halve("t", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").agg(**{f"{p}{e}": f"corr(CASE WHEN early = {e} THEN {x} END, CASE WHEN early = {e} THEN {y} END)" for p, x, y in (("qp", "l_quantity", "l_extendedprice"), ("qd", "l_quantity", "l_discount"), ("pd", "l_extendedprice", "l_discount"), ("pt", "l_extendedprice", "l_tax"), ("qt", "l_quantity", "l_tax"), ("dt", "l_discount", "l_tax")) for e in (0, 1)}).select(**{p: f"round({p}0 - {p}1, 6)" for p in ("qp", "qd", "pd", "pt", "qt", "dt")}, largest="round(greatest(" + ", ".join(f"abs({p}0 - {p}1)" for p in ("qp", "qd", "pd", "pt", "qt", "dt")) + "), 6)"),
    "zipf_law_frequency_v1": ranks.agg(slope="round(regr_slope(ln(n), ln(r)), 6)", r2="round(regr_r2(ln(n), ln(r)), 6)"),
    "lotka_law_concentration_v1": events.agg("user_id", n="count(*)").agg("n", f="count(*)").agg(slope="round(regr_slope(ln(f), ln(n)), 6)", r2="round(regr_r2(ln(f), ln(n)), 6)"),
    "bradford_law_core_hosts_v1": ranks.agg(core="CAST(sum(CASE WHEN c * 3 <= every THEN 1 ELSE 0 END) AS BIGINT)", users="count(*)"),
    "survival_kaplan_meier": km.add(s="exp(sum(CASE WHEN at_risk > d THEN ln(1.0 - d / CAST(at_risk AS DOUBLE)) ELSE -50.0 END) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))").select("event_type", h="CAST(h AS BIGINT)", s="round(s, 6)"),
    "life_table_hazard_v1": km.select("event_type", h="CAST(h AS BIGINT)", hazard="round(d / CAST(at_risk AS DOUBLE), 9)"),
    "competing_risks_cif_v1": log.where("wait IS NOT NULL").cross(log.agg(t50="PCT(wait, 0.5)", t90="PCT(wait, 0.9)", every="count(wait)")).agg("event_type", c50="round(sum(CASE WHEN wait <= t50 THEN 1.0 ELSE 0.0 END) / max(every), 9)", c90="round(sum(CASE WHEN wait <= t90 THEN 1.0 ELSE 0.0 END) / max(every), 9)"),
    "population_pyramid_shape_v1": moments.join(events, "event_type").agg("event_type", skew="round(avg(power((value - mu) / sd, 3)), 5)", kurt="round(avg(power((value - mu) / sd, 4)) - 3.0, 4)"),
    "negative_binomial_overdispersion_v1": events.agg("event_type", "user_id", n="count(*)").agg("event_type", m="avg(n)", v="var_pop(n)").select("event_type", ratio="round(v / m, 6)", r="round(m * m / nullif(v - m, 0.0), 4)"),
    "dirichlet_multinomial_categorical_overdispersion_v1": halved.agg("early", "event_type", n="count(*)").add(p="n / CAST(sum(n) OVER (PARTITION BY early) AS DOUBLE)").agg("event_type", spread="round(max(p) - min(p), 9)"),
    "fairness_bias_detection_v1": items.agg("l_linestatus", rate="avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)", n="count(*)").add(gap="max(rate) OVER () - min(rate) OVER ()", ratio="min(rate) OVER () / nullif(max(rate) OVER (), 0.0)").select("l_linestatus", "n", rate="round(rate, 9)", gap="round(gap, 9)", disparate="round(ratio, 9)"),
    "renyi_entropy_spectrum_v1": events.add(k="floor(value / 10.0)").agg("event_type", "k", n="count(*)").add(p="n / CAST(sum(n) OVER (PARTITION BY event_type) AS DOUBLE)").agg("event_type", h0="round(ln(count(*)), 6)", h1="round(-sum(p * ln(p)), 6)", h2="round(-ln(sum(p * p)), 6)"),
    "surface_rugosity_index": series.agg("event_type", n="count(*)", s="sum(abs(d))", lo="PCT(value, 0.05)", hi="PCT(value, 0.95)").select("event_type", rugosity="round(s / ((hi - lo) * (n - 1)), 6)"),
    "surface_terrain_position_index": events.near(*ALONG, 5, m=f"avg(value) {FRAME.format('5 PRECEDING', '5 FOLLOWING')}").agg("event_type", q90="round(PCT(abs(value - m), 0.9), 6)"),
    "surface_fractal_dimension_variogram": events.near(*ALONG, 4, **{f"l{k}": f"lag(value, {k}) {SER}" for k in (1, 2, 4)}).agg("event_type", **{f"g{k}": f"avg((value - l{k}) * (value - l{k})) / 2.0" for k in (1, 2, 4)}).where("g1 > 0 AND g4 > 0").add(slope="(ln(g4) - ln(g1)) / (2.0 * ln(2.0))").select("event_type", g1="round(g1, 4)", g2="round(g2, 4)", g4="round(g4, 4)", hurst="round(slope / 2.0, 6)", dimension="round(2.0 - slope / 2.0, 6)"),
    "moran_i_autocorrelation_v1": series.join(moments, "event_type").near(*ALONG, 1, nxt=f"lead(value) {SER}").add(z="value - mu", zn="nxt - mu").agg("event_type", n="count(*)", c="sum(z * zn)", v="sum(z * z)").select("event_type", i="round(n / (2.0 * (n - 1)) * 2.0 * c / v, 6)"),
    "getis_ord_hotspot_v1": events.near(*ALONG, 5, s=f"sum(value) {FRAME.format('5 PRECEDING', '5 FOLLOWING')}", k=f"count(*) {FRAME.format('5 PRECEDING', '5 FOLLOWING')}").join(moments, "event_type").add(g="(s - k * mu) / nullif(sd * sqrt((n * k - k * k) / CAST(n - 1 AS DOUBLE)), 0.0)").agg("event_type", hot="CAST(sum(CASE WHEN g > 1.96 THEN 1 ELSE 0 END) AS BIGINT)", cold="CAST(sum(CASE WHEN g < -1.96 THEN 1 ELSE 0 END) AS BIGINT)"),
    "evt_gumbel_tail": series.add(b="floor((i - 1) / 20.0)").agg("event_type", "b", m="max(value)").agg("event_type", mean="avg(m)", sd="stddev_pop(m)").select("event_type", beta="round(sd * sqrt(6.0) / pi(), 6)", mu="round(mean - 0.5772156649 * sd * sqrt(6.0) / pi(), 6)"),
    "psha_probabilistic_risk_v1": events.agg("event_type", p95="PCT(value, 0.95)", p99="PCT(value, 0.99)").select("event_type", ratio="round(p99 / p95, 6)"),
    "assortativity_scheduling_bias_v1": deg.join(out_deg, "src").join(in_deg, "dst").agg(r=corr("od", "id"), edges="count(*)"),
    "cascade_r0_reproduction_v1": out_deg.agg(mean="round(avg(od), 6)", var="round(var_pop(od), 6)", nodes="count(*)"),
    "toc_binding_constraint_v1": in_deg.cross(in_deg.agg(m="avg(id)")).select("dst", ratio="round(id / m, 6)").top("ratio DESC, dst", 10),
    "safety_stock_buffer_v1": items.agg("l_suppkey", stock="round(1.645 * stddev_pop(l_quantity) * sqrt(7.0), 6)"),
    "eoq_batch_sizing_v1": items.agg("l_partkey", d="sum(l_quantity)", h="avg(l_extendedprice)").select("l_partkey", eoq="round(sqrt(2.0 * d * 50.0 / h), 6)"),
    "fmea_rpn_scoring_v1": events.agg("event_type", sev="PCT(value, 0.95) / PCT(value, 0.5)", occ="count(*)").cross(events.agg(every="count(*)")).select("event_type", rpn="round(least(10.0, sev) * least(10.0, 10.0 * occ / every), 6)"),
    "pythagorean_expectation_v1": log.where("wait IS NOT NULL").agg("event_type", good=f"sum(CASE WHEN wait <= {THRESHOLD} THEN 1.0 ELSE 0.0 END)", bad=f"sum(CASE WHEN wait > {THRESHOLD} THEN 1.0 ELSE 0.0 END)").select("event_type", e="round(good * good / (good * good + bad * bad), 9)"),
    "borda_count_multicriteria_v1": events.agg("event_type", a="round(avg(value), 9)", b="count(*)").add(ra="rank() OVER (ORDER BY a)", rb="rank() OVER (ORDER BY b DESC)").select("event_type", borda="CAST(ra + rb AS BIGINT)"),
    "condorcet_host_ranking_v1": events.mean("event_type", "m", "value").within(events.mean("event_type", "om", "value").select("om", other="event_type"), "m < om").agg("event_type", wins="count(*)"),
    "bundled_donations_v1": table("orders").agg("o_orderdate", "o_orderpriority", n="count(*)", total="round(sum(o_totalprice), 2)").where("n >= 3"),
    "contribution_limit_flags_v1": table("orders").add(y="CAST(year(o_orderdate) AS BIGINT)").agg("o_custkey", "y", total="sum(o_totalprice)").where("total > 500000").select("o_custkey", "y", excess="round(total - 500000, 2)"),
    "vendor_influence_breadth_v1": deg.agg("dst", breadth="count(DISTINCT src)").top("breadth DESC, dst", 20),
    "document_profile": tokens.agg("lang", docs="count(*)", sources="count(DISTINCT source)", chars="CAST(sum(n_chars) AS BIGINT)", p95="round(PCT(n_chars, 0.95), 3)"),
}

for _name, _plan in PLANS.items():
    add_plan(_name, _plan)
