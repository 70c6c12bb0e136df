"""Multivariate, causal and test statistics from moments: one pass of mergeable sums, then closed forms.

Three correlations determine what the operators on three standardised columns need (inverse, partial correlations,
eigenvalues), so no row leaves its partition before it is summed.
"""

from __future__ import annotations

from quarrystat.plans.plan import Plan, table
from quarrystat.plans.registry import add_plan

items, orders, events = table("lineitem"), table("orders"), table("events")
num = items.select("l_returnflag", x="l_quantity", y="l_extendedprice", z="l_discount", t="US(l_shipdate)")
STATS = {f"m{c}": f"avg({c})" for c in "xyz"} | {f"s{c}": f"stddev_pop({c})" for c in "xyz"} | {"a": "corr(x, y)", "b": "corr(x, z)", "c": "corr(y, z)", "n": "count(*)"}
DET = "1 + 2 * a * b * c - a * a - b * b - c * c"
T2 = (
    "((1 - c * c) * zx * zx + (1 - b * b) * zy * zy + (1 - a * a) * zz * zz"
    " + 2 * (b * c - a) * zx * zy + 2 * (a * c - b) * zx * zz + 2 * (a * b - c) * zy * zz) / det"
)


def three(*keys: str, source: Plan = num) -> Plan:
    """Moments of x, y, z with partial correlations and the eigenvalues of the correlation matrix in falling order."""
    return (
        source.agg(*keys, **STATS).add(det=DET, p="sqrt((a * a + b * b + c * c) / 3.0)")
        .add(pxy="(a - b * c) / sqrt((1 - b * b) * (1 - c * c))", pxz="(b - a * c) / sqrt((1 - a * a) * (1 - c * c))", pyz="(c - a * b) / sqrt((1 - a * a) * (1 - b * b))")
        .add(phi="acos(greatest(-1.0, least(1.0, a * b * c / (p * p * p)))) / 3.0")
        .add(e1="1.0 + 2.0 * p * cos(phi)", e3="1.0 + 2.0 * p * cos(phi + 2.0 * pi() / 3.0)").add(e2="3.0 - e1 - e3")
    )


cut = num.median("t", "cut")
halves = num.halve("t", "x", "y", "z")
moved = three("early", source=halves)
shift = moved.where("early = 1").cross(moved.where("early = 0").select(qxy="pxy", qxz="pxz", qyz="pyz", f1="e1"))
distance = num.cross(three()).add(zx="(x - mx) / sx", zy="(y - my) / sy", zz="(z - mz) / sz").add(t2=T2)
KEEP = "CASE WHEN abs({0}) > 0.02 AND abs({1}) > 0.02 THEN 1 ELSE 0 END"

bounds = items.agg(**{f"{s}{c}": f"{f}({v})" for c, v in {"x": "l_quantity", "y": "l_extendedprice", "t": "l_discount"}.items() for s, f in (("l", "min"), ("h", "max"))})
binned = items.cross(bounds).select(**{c: f"CAST(least(7, floor(8.0 * ({v} - l{c}) / nullif(h{c} - l{c}, 0.0))) AS BIGINT)" for c, v in {"x": "l_quantity", "y": "l_extendedprice", "t": "l_discount"}.items()})
cube = binned.agg("x", "y", "t", n="count(*)").add(p="n / CAST(sum(n) OVER () AS DOUBLE)").add(
    **{f"p{k.replace(', ', '')}": f"sum(p) OVER (PARTITION BY {k})" for k in ("x", "y", "t", "x, y", "x, t", "y, t")}
)
MI = {k: f"sum(p * ln({num_} / ({k} * pt)))" for k, num_ in {"px": "pxt", "py": "pyt", "pxy": "p"}.items()}

trial = items.cross(cut).select("l_suppkey", "l_linestatus", "l_returnflag", post="CASE WHEN US(l_shipdate) >= cut THEN 1 ELSE 0 END", treat="CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END", y="l_extendedprice", x="l_quantity", d="l_discount", t="US(l_shipdate) / 86400000000.0", cut="cut / 86400000000.0")
strata = trial.add(k="CAST(floor(x / 5.0) AS BIGINT)").agg("k", n="count(*)", n1="CAST(sum(treat) AS BIGINT)", y1="sum(CASE WHEN treat = 1 THEN y ELSE 0.0 END)", y0="sum(CASE WHEN treat = 0 THEN y ELSE 0.0 END)").add(e="greatest(0.01, least(0.99, n1 / CAST(n AS DOUBLE)))")
groups = items.agg("l_linestatus", "l_returnflag", n="count(*)", m="avg(l_quantity)", v="var_samp(l_quantity)")
two = items.agg(**{f"{s}{g}": f"{f}(CASE WHEN l_linestatus = '{g}' THEN l_quantity END)" for g in "OF" for s, f in (("n", "count"), ("m", "avg"), ("v", "var_samp"))})
flags = items.agg(n="count(*)", a="avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)", b="avg(CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0.0 END)", ab="avg(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1.0 ELSE 0.0 END)").add(d="ab - a * b")
kpi = events.agg("user_id", n="count(*)", m="round(avg(value), 9)", worst="max(value)")
ideal = kpi.agg(lm="PCT(m, 0.1)", lw="PCT(worst, 0.1)", ln_="PCT(n, 0.9)", sm="stddev_pop(m)", sw="stddev_pop(worst)", sn="stddev_pop(n)")
gap = kpi.cross(ideal).add(gm="greatest(0.0, m - lm) / sm", gw="greatest(0.0, worst - lw) / sw", gn="greatest(0.0, ln_ - n) / sn").add(energy="gm * gm + gw * gw + gn * gn")
ordered = kpi.agg("n", best="min(m)", c="count(*)").add(before="min(best) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
order_size = items.agg("l_orderkey", lines="count(*)", q="sum(l_quantity)", pay="sum(l_extendedprice)", days="(max(US(l_shipdate)) - min(US(l_shipdate))) / 86400000000.0")
kinds = events.select("user_id", "event_type").agg("user_id", "event_type", n="count(*)")
support = kinds.where("n >= 2").select("user_id", a="event_type").join(kinds.where("n >= 2").select("user_id", b="event_type"), "user_id").where("a <> b").agg("a", "b", n="count(*)")
single, base = kinds.where("n >= 2").agg("event_type", c="count(*)"), events.agg(users="count(DISTINCT user_id)")
rules = support.join(single.select(a="event_type", na="c"), "a").join(single.select(b="event_type", nb="c"), "b").cross(base)

PLANS = {
    "multivariate_t2_control": distance.agg(limit_="round(PCT(t2, 0.995), 5)", worst="round(max(t2), 5)", n="count(*)"),
    "robust_covariance_outliers": distance.cross(distance.agg(lim="PCT(t2, 0.99)")).where("t2 > lim + 0.000001").agg("l_returnflag", n="count(*)"),
    "multicollinearity_vif_screen_v1": three("l_returnflag").select("l_returnflag", x="round((1 - c * c) / det, 6)", y="round((1 - b * b) / det, 6)", z="round((1 - a * a) / det, 6)"),
    "pc_algorithm_causal_graph_v1": three("l_returnflag").select("l_returnflag", xy=KEEP.format("a", "pxy"), xz=KEEP.format("b", "pxz"), yz=KEEP.format("c", "pyz")).select("l_returnflag", xy="CAST(xy AS BIGINT)", xz="CAST(xz AS BIGINT)", yz="CAST(yz AS BIGINT)"),
    "partial_correlation_network_shift_v1": shift.select(shift="round(greatest(abs(pxy - qxy), abs(pxz - qxz), abs(pyz - qyz)), 6)"),
    "spectral_radius_stability_v1": shift.select(delta="round(abs(e1 - f1), 6)"),
    "random_matrix_marchenko_pastur_denoise_v1": three().select(edge="round(power(1.0 + sqrt(3.0 / n), 2), 6)", above="CAST((CASE WHEN e1 > power(1.0 + sqrt(3.0 / n), 2) THEN 1 ELSE 0 END) + (CASE WHEN e2 > power(1.0 + sqrt(3.0 / n), 2) THEN 1 ELSE 0 END) AS BIGINT)", top="round(e1, 6)"),
    "pca_auto": three().select(first="round(e1 / 3.0, 6)", second="round(e2 / 3.0, 6)", third="round(e3 / 3.0, 6)"),
    "surface_fabric_sso_eigen": three("l_returnflag").select("l_returnflag", anisotropy="round((e1 - e2) / e1, 6)", planarity="round((e2 - e3) / e1, 6)"),
    "liebig_minimum_constraint_v1": three("l_returnflag").select("l_returnflag", weakest="CASE WHEN abs(a) <= abs(c) THEN 'x' ELSE 'z' END", headroom="round(least(1 - abs(a), 1 - abs(c)), 6)"),
    "virtual_metrology_early_v1": three("l_returnflag").select("l_returnflag", r2="round((b * b + c * c - 2 * a * b * c) / (1 - a * a), 6)"),
    "gam_spline_regression_v1": three("l_returnflag", source=items.select("l_returnflag", x="l_quantity", z="l_quantity * l_quantity", y="l_extendedprice")).select("l_returnflag", r2="round((a * a + c * c - 2 * a * b * c) / (1 - b * b), 5)"),
    "channel_capacity_bound_v1": cube.agg(x=MI["px"], y=MI["py"]).select(x_bits="round(x / ln(2.0), 6)", y_bits="round(y / ln(2.0), 6)"),
    "pid_synergy_redundancy_v1": cube.agg(x=MI["px"], y=MI["py"], xy=MI["pxy"]).select(synergy="round(xy - x - y, 6)"),
    "linkage_disequilibrium_steps_v1": flags.select(d="round(d, 9)", d_prime="round(d / nullif(CASE WHEN d >= 0 THEN least(a * (1 - b), (1 - a) * b) ELSE least(a * b, (1 - a) * (1 - b)) END, 0.0), 6)"),
    "diff_in_diff_v1": trial.agg(**{f"c{i}{j}": f"avg(CASE WHEN treat = {i} AND post = {j} THEN y END)" for i in (0, 1) for j in (0, 1)}).select(effect="round((c11 - c10) - (c01 - c00), 4)"),
    "regression_discontinuity_v1": trial.where("abs(t - cut) <= 180").agg(b="regr_intercept(CASE WHEN post = 1 THEN y END, t - cut)", a="regr_intercept(CASE WHEN post = 0 THEN y END, t - cut)").select(jump="round(b - a, 3)"),
    "interrupted_time_series_v1": trial.agg(b="regr_intercept(CASE WHEN post = 1 THEN y END, t - cut)", a="regr_intercept(CASE WHEN post = 0 THEN y END, t - cut)", d="regr_slope(CASE WHEN post = 1 THEN y END, t - cut)", c="regr_slope(CASE WHEN post = 0 THEN y END, t - cut)").select(level="round(b - a, 3)", slope="round(d - c, 6)"),
    "instrumental_variables_2sls_v1": trial.agg(top="covar_pop(treat, y)", low="covar_pop(treat, x)").select(effect="round(top / nullif(low, 0.0), 2)"),
    "inverse_propensity_weighting_v1": strata.agg(n="sum(n)", a="sum(y1 / e)", b="sum(y0 / (1 - e))").select(ate="round((a - b) / n, 4)"),
    "bayesian_ab_test_v1": trial.agg("treat", n="count(*)", s="CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT)").select(treat="CAST(treat AS BIGINT)", mean="round((s + 1.0) / (n + 2.0), 9)", sd="round(sqrt((s + 1.0) * (n - s + 1.0) / (power(n + 2.0, 2) * (n + 3.0))), 9)"),
    "anova_auto": groups.add(total="sum(n) OVER (PARTITION BY l_linestatus)", gm="sum(n * m) OVER (PARTITION BY l_linestatus) / sum(n) OVER (PARTITION BY l_linestatus)").agg("l_linestatus", k="count(*)", total="max(total)", ssb="sum(n * power(m - gm, 2))", ssw="sum((n - 1) * v)").where("k >= 2").select("l_linestatus", f="round((ssb / (k - 1)) / (ssw / (total - k)), 5)"),
    "neutral_drift_noise_v1": kinds.agg("event_type", m="avg(n)", v="var_pop(n)").select("event_type", ratio="round(v / m, 6)"),
    "quantile_regression_duration": items.agg("l_returnflag", p90="PCT(l_extendedprice, 0.9)").agg(top="max(p90)").cross(items.agg(rest="PCT(l_extendedprice, 0.9)")).select(gap="round(top - rest, 4)"),
    "aft_survival_lognormal_v1": items.agg("l_returnflag", slope="round(regr_slope(ln(1 + l_extendedprice), l_quantity), 9)", intercept="round(regr_intercept(ln(1 + l_extendedprice), l_quantity), 6)"),
    "symbolic_regression_gp_v1": items.where("l_quantity > 0").agg(**{k: f"round(regr_r2(l_extendedprice, {e}), 6)" for k, e in {"line": "l_quantity", "logarithm": "ln(l_quantity)", "root": "sqrt(l_quantity)", "square": "l_quantity * l_quantity", "inverse": "1.0 / l_quantity"}.items()}),
    "amdahl_law_serial_fraction_v1": order_size.where("days > 0").agg("lines", d="avg(days)").agg(s="regr_intercept(d, 1.0 / lines)", p="regr_slope(d, 1.0 / lines)").select(serial="round(s, 6)", parallel="round(p, 6)"),
    "fitts_law_precision_v1": order_size.where("days > 0").agg(r2="round(power(corr(pay, log2(2 * days / q)), 2), 6)"),
    "job_shop_scheduling_bound_v1": order_size.agg(job="max(q)").cross(items.agg("l_suppkey", q="sum(l_quantity)").agg(machine="max(q)")).select(bound="greatest(job, machine)"),
    "war_value_above_replacement_v1": kpi.cross(events.agg(mid="PCT(value, 0.5)")).select("user_id", war="round(m - mid, 9)"),
    "irt_step_difficulty_v1": events.agg("event_type", s="CAST(sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS BIGINT)", n="count(*)").select("event_type", difficulty="round(-ln((s + 0.5) / (n - s + 0.5)), 6)"),
    "koopman_search_allocation_v1": events.agg("event_type", n="count(*)", cv="stddev_pop(value) / avg(value)").add(w="sqrt(n * cv)").add(share="w / sum(w) OVER ()").select("event_type", share="round(share, 6)"),
    "poisson_yield_complexity_v1": events.agg("event_type", d="avg(CASE WHEN value > 200 THEN 1.0 ELSE 0.0 END)", a="avg(CAST(length(props) AS DOUBLE))").select("event_type", yield_="round(exp(-d * a), 6)"),
    "hr_diagram_classification_v1": kpi.cross(kpi.agg(mn="PCT(n, 0.5)", mm="PCT(m, 0.5)")).add(quadrant="concat(CASE WHEN n > mn THEN 'busy' ELSE 'quiet' END, '-', CASE WHEN m > mm THEN 'slow' ELSE 'fast' END)").agg("quadrant", users="count(*)"),
    "nash_equilibrium_contention_v1": kpi.cross(kpi.agg(mn="PCT(n, 0.5)", mm="PCT(m, 0.5)")).agg(**{f"p{i}{j}": f"round(avg(CASE WHEN n {a} mn AND m {b} mm THEN worst END), 5)" for i, a in ((0, "<="), (1, ">")) for j, b in ((0, "<="), (1, ">"))}),
    "mechanism_design_scheduling_v1": order_size.agg(r="round(corr(q, pay), 6)", over="round(avg(CASE WHEN pay > 1500.0 * q THEN 1.0 ELSE 0.0 END), 9)"),
    "arrow_impossibility_pareto_v1": ordered.agg(front="CAST(sum(CASE WHEN before IS NULL OR best < before THEN 1 ELSE 0 END) AS BIGINT)", levels="count(*)"),
    "functorial_migration_v1": orders.agg("o_orderpriority", m="avg(o_totalprice)").cross(orders.agg(mu="avg(o_totalprice)", sd="stddev_pop(o_totalprice)")).select("o_orderpriority", drift="round(abs(m - mu) / sd, 6)"),
    "ideaspace_normative_gap": gap.select("user_id", gm="round(gm, 5)", gw="round(gw, 5)", gn="round(gn, 5)"),
    "ideaspace_energy_ebm_v1": gap.select("user_id", energy="round(energy, 5)"),
    "ebm_action_verifier_v1": gap.add(after="power(greatest(0.0, 0.9 * m - lm) / sm, 2) + gw * gw + gn * gn").select("user_id", gain="round(energy - after, 5)"),
    "fragility_perturbation_v1": gap.each("pct", -1, 1).add(moved="power(greatest(0.0, (1.0 + pct / 10.0) * m - lm) / sm, 2) + gw * gw + gn * gn").agg("pct", change="round(avg(moved - energy), 6)"),
    "frequent_itemsets_fpgrowth_v1": rules.where("a < b").select("a", "b", "n", support="round(n / CAST(users AS DOUBLE), 9)"),
    "association_rules_apriori_v1": rules.select("a", "b", confidence="round(n / CAST(na AS DOUBLE), 9)", lift="round(n * users / (CAST(na AS DOUBLE) * nb), 6)"),
    "log_template_mining_drain": events.add(template="RSUB(RSUB(props, '[0-9a-f]{8}-[0-9a-f-]{27}', '<uuid>'), '[0-9]+', '<num>')").agg("event_type", "template", n="count(*)", example="min(props)"),
    "job_sequence_cache_rotation_v1": events.add(q="ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id)").agg("event_type", cold="PCT(CASE WHEN q = 1 THEN value END, 0.5)", warm="PCT(CASE WHEN q > 1 THEN value END, 0.5)").select("event_type", ratio="round(cold / warm, 6)"),
}

for _name, _plan in PLANS.items():
    add_plan(_name, _plan)
