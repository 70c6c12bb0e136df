"""Time-bucket operators: spectra, memory, bursts, capacity and trend of hourly or daily series.

Events are first summed into hours or days of an event type, so what windows order is bounded by the time covered, not by
the number of events. Positions count the buckets that have events. Spectra and lags join or expand these buckets only.
"""

from __future__ import annotations

from quarrystat.plans.plan import Plan, table
from quarrystat.plans.registry import add_plan

BY = "OVER (PARTITION BY event_type ORDER BY h)"
RUN = "OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ALL = "OVER (PARTITION BY event_type)"
events = table("events")


def buckets(unit: str) -> Plan:
    """Count n, mean v and position i of each bucket; size is the number of buckets."""
    found = events.add(h=f"date_trunc('{unit}', ts)").agg("event_type", "h", n="count(*)", v="round(avg(value), 9)")
    return found.add(i=f"CAST(row_number() {BY} AS BIGINT)", size=f"count(*) {ALL}", mn=f"avg(n) {ALL}", mv=f"avg(v) {ALL}", sn=f"stddev_pop(n) {ALL}", sv=f"stddev_pop(v) {ALL}")


hours, days = buckets("hour"), buckets("day")


def wave(source: Plan, x: str, *keys: str) -> Plan:
    """Power of the centred series x at all whole frequencies of the series, 1 to half its buckets."""
    turn = "2.0 * pi() * k * i / size"
    return (
        source.each("k", 1, "greatest(1, floor(size / 2.0))").agg("event_type", *keys, "k", re=f"sum({x} * cos({turn}))", im=f"sum({x} * sin({turn}))", size="max(size)")
        .add(power="re * re + im * im")
    )


def peak(spectrum: Plan) -> Plan:
    """The strongest frequency of each type, with its power, the whole power and the median power."""
    ranked = spectrum.add(r="row_number() OVER (PARTITION BY event_type ORDER BY power DESC, k)")
    return ranked.agg("event_type", k="max(CASE WHEN r = 1 THEN k END)", top="max(power)", every="sum(power)", mid="PCT(power, 0.5)", size="max(size)")


def lagged(source: Plan, low: int, high: int | str) -> Plan:
    """Pairs of a bucket and the one k positions later."""
    later = source.select("event_type", i="i", n2="n", v2="v")
    return source.each("k", low, high).select("event_type", "k", "n", "v", "mn", "mv", "size", m="i", i="i + k").join(later, "event_type", "i")


gaps = events.add(gap="(US(ts) - lag(US(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0").where("gap IS NOT NULL")
gap_hours = gaps.add(h="date_trunc('hour', ts)").agg("event_type", "h", n="count(*)", v="avg(gap)").add(i=f"CAST(row_number() {BY} AS BIGINT)", size=f"count(*) {ALL}", mv=f"avg(v) {ALL}")
robust = hours.join(hours.agg("event_type", med="PCT(v, 0.5)"), "event_type").add(a="abs(v - med)")
robust = robust.join(robust.agg("event_type", mad="PCT(a, 0.5)"), "event_type").add(z="(v - med) / nullif(1.4826 * mad, 0.0)")
# the two-sided recursion max(0, S + z - k) in closed form: the running sum less its smallest value so far
cusum = robust.add(cu=f"sum(z - 0.5) {RUN}", cd=f"sum(-z - 0.5) {RUN}").add(up=f"cu - least(0.0, min(cu) {RUN})", down=f"cd - least(0.0, min(cd) {RUN})")
acf = lagged(hours, 1, "greatest(1, floor(size / 2.0))").agg("event_type", "k", r="corr(n, n2)")
higuchi = lagged(hours, 1, 8).add(off="m % k").agg("event_type", "k", "off", s="sum(abs(v2 - v))", c="count(*)", size="max(size)").add(len="s * (size - 1) / (c * k * k)").agg("event_type", "k", len="avg(len)")
scaled = hours.each("e", 3, 7).add(w="CAST(round(power(2, e)) AS BIGINT)").add(c="CAST(floor((i - 1) / w) AS BIGINT)").add(m="avg(v) OVER (PARTITION BY event_type, w, c)", of="count(*) OVER (PARTITION BY event_type, w, c)").where("of = w")
ranges = scaled.add(y="sum(v - m) OVER (PARTITION BY event_type, w, c ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").agg("event_type", "w", "c", rs="(max(y) - min(y)) / nullif(stddev_pop(v), 0.0)").agg("event_type", "w", rs="avg(rs)")
big = hours.join(hours.agg("event_type", p95="PCT(n, 0.95)"), "event_type").add(last=f"max(CASE WHEN n >= p95 THEN i END) {RUN}").add(k="i - last").where("k BETWEEN 1 AND 100").agg("event_type", "k", m="avg(n)")
segments = events.add(day="date_trunc('day', ts)", i="CAST(hour(ts) AS BIGINT)").agg("event_type", "day", "i", n="count(*)", v="sum(value)")
segments = segments.each("k", 1, 11).add(turn="2.0 * pi() * k * i / 24").agg("event_type", "day", "k", xr="sum(n * cos(turn))", xi="sum(n * sin(turn))", yr="sum(v * cos(turn))", yi="sum(v * sin(turn))")
cross = segments.agg("event_type", "k", re="sum(xr * yr + xi * yi)", im="sum(xi * yr - xr * yi)", xx="sum(xr * xr + xi * xi)", yy="sum(yr * yr + yi * yi)")
span = events.agg("user_id", first="floor(min(US(ts)) / 86400000000.0)", last="floor(max(US(ts)) / 86400000000.0)").select("user_id", first="CAST(first AS BIGINT)", last="CAST(last AS BIGINT)")
frontier = hours.add(best="max(v) OVER (PARTITION BY event_type ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").add(eff="v / nullif(best, 0.0)")
load = hours.add(q="CAST(ntile(5) OVER (PARTITION BY event_type ORDER BY n, h) AS BIGINT)").agg("event_type", "q", n="avg(n)", v="avg(v)")
hist = events.add(b="CAST(floor(value / 20.0) AS BIGINT)").agg("event_type", "b", n="count(*)").add(s="avg(n) OVER (PARTITION BY event_type ORDER BY b ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
modes = hist.add(a="coalesce(lag(s) OVER (PARTITION BY event_type ORDER BY b), 0.0)", c="coalesce(lead(s) OVER (PARTITION BY event_type ORDER BY b), 0.0)")

PLANS = {
    "control_chart_suite": cusum.agg("event_type", individuals="CAST(sum(CASE WHEN abs(z) > 4.0 THEN 1 ELSE 0 END) AS BIGINT)", cusum="CAST(sum(CASE WHEN greatest(up, down) > 5.0 THEN 1 ELSE 0 END) AS BIGINT)", buckets="count(*)"),
    "periodicity_spectral_scan": peak(wave(hours.add(x="n - mn"), "x")).select("event_type", "k", ratio="round(top / nullif(mid, 0.0), 5)", period="round(size / CAST(k AS DOUBLE), 6)"),
    "wave_directional_spectra_v1": hours.agg("event_type", e="count(*) * var_pop(v)").add(share="e / sum(e) OVER ()").select("event_type", share="round(share, 6)", dominant="share > 0.3"),
    "tidal_harmonic_cycles_v1": wave(hours.add(x="v - mv"), "x").add(r="row_number() OVER (PARTITION BY event_type ORDER BY power DESC, k)").agg("event_type", fraction="round(sum(CASE WHEN r <= 5 THEN power ELSE 0.0 END) / sum(power), 6)"),
    "periodic_schedule_fft_v1": peak(wave(gap_hours.add(x="v - mv"), "x")).select("event_type", "k", share="round(top / every, 6)"),
    "spectral_coherence_coupling_v1": cross.select("event_type", "k", coherence="round((re * re + im * im) / nullif(xx * yy, 0.0), 6)"),
    "bode_frequency_response_v1": cross.select("event_type", "k", gain="round(sqrt(re * re + im * im) / nullif(xx, 0.0), 4)"),
    "bls_periodic_outage_v1": hours.each("period", 2, 51).add(phase="i % period").agg("event_type", "period", "phase", low="avg(v)", mv="max(mv)", sv="max(sv)", c="count(*)").agg("event_type", "period", depth="max((mv - low) / nullif(sv, 0.0) * sqrt(c))").select("event_type", "period", depth="round(depth, 5)"),
    "tempo_tracking_cadence_v1": acf.select("event_type", "k", r="round(r, 6)"),
    "higuchi_fractal_dimension_v1": higuchi.agg("event_type", dimension="round(-regr_slope(ln(len), ln(k)), 6)"),
    "hurst_exponent_long_memory_v1": ranges.agg("event_type", hurst="round(regr_slope(ln(rs), ln(w)), 6)", r2="round(regr_r2(ln(rs), ln(w)), 6)"),
    "omori_aftershock_decay_v1": big.agg("event_type", decay="round(-regr_slope(ln(m), ln(k)), 6)"),
    "scan_statistics": hours.add(m="avg(n) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)").where("i >= 6").agg("event_type", z="round(max((m - mn) / nullif(sn, 0.0)), 6)"),
    "burst_modeling_hawkes_v1": acf.where("k = 1").select("event_type", branching="round(greatest(0.0, r), 6)"),
    "fused_lasso_trend_filtering_v1": days.add(d=f"v - lag(v) {BY}").join(days.add(d=f"v - lag(v) {BY}").agg("event_type", cut="PCT(abs(d), 0.9)"), "event_type").where("d IS NOT NULL").add(
        step="CASE WHEN d > cut THEN d - cut WHEN d < -cut THEN d + cut ELSE 0.0 END").agg("event_type", breaks="CAST(sum(CASE WHEN abs(step) > 0.000001 THEN 1 ELSE 0 END) AS BIGINT)", moved="round(sum(abs(step)), 5)"),
    "stratigraphic_layers_v1": hours.add(a="avg(v) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)", b="avg(v) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)").where("i > 12 AND i <= size - 11").agg(
        "event_type", worst="max(abs(b - a))", mu="avg(abs(b - a))", sd="stddev_pop(abs(b - a))").select("event_type", z="round((worst - mu) / nullif(sd, 0.0), 5)"),
    "entropy_production_rate_v1": events.add(h="date_trunc('day', ts)", b="floor(value / 20.0)").agg("event_type", "h", "b", n="count(*)").add(p="n / CAST(sum(n) OVER (PARTITION BY event_type, h) AS DOUBLE)").agg("event_type", "h", e="-sum(p * ln(p))").add(
        i=f"row_number() {BY}").agg("event_type", rate="round(regr_slope(e, i), 6)"),
    "renormalization_multiscale_v1": scaled.agg("event_type", "w", "c", m="avg(v)", sv="max(sv)").agg("event_type", "w", share="round(var_pop(m) / nullif(max(sv) * max(sv), 0.0), 6)"),
    "demographic_transition_v1": span.select("user_id", day="first", born="1", died="0").union(span.select("user_id", day="last", born="0", died="1")).agg("day", births="CAST(sum(born) AS BIGINT)", deaths="CAST(sum(died) AS BIGINT)"),
    "gutenberg_richter_bvalue_v1": hist.add(above="sum(n) OVER (PARTITION BY event_type ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").agg("event_type", b_value="round(-regr_slope(log10(above), b), 6)"),
    "phase_type_multimodal_v1": modes.agg("event_type", modes="CAST(sum(CASE WHEN s > a AND s >= c THEN 1 ELSE 0 END) AS BIGINT)", bins="count(*)"),
    "capacity_frontier_envelope_v1": frontier.agg("event_type", mean="round(avg(eff), 6)", low="round(min(eff), 6)"),
    "stress_strain_capacity_v1": load.select("event_type", "q", load="round(n, 6)", strain="round(v, 5)"),
    "michaelis_menten_saturation_v1": hours.where("v > 0").agg("event_type", s="regr_slope(1.0 / v, 1.0 / n)", c="regr_intercept(1.0 / v, 1.0 / n)").select("event_type", vmax="round(1.0 / nullif(c, 0.0), 4)", km="round(s / nullif(c, 0.0), 5)"),
    "cdma_interference_sir_v1": events.where("value > 0").agg("event_type", p="PCT(value, 0.1)", m="avg(value)").select("event_type", sir="round(10.0 * log10(p / (m - p)), 6)"),
    "carnot_efficiency_bound_v1": events.join(events.agg("event_type", lo="PCT(value, 0.05)", hi="PCT(value, 0.95)", every="sum(value)"), "event_type").where("value BETWEEN lo AND hi").agg("event_type", useful="round(sum(value) / max(every), 6)"),
    "evt_peaks_over_threshold": events.join(events.agg("event_type", u="PCT(value, 0.95)"), "event_type").where("value > u").agg("event_type", m="avg(value - u)", s="var_samp(value - u)", n="count(*)").select("event_type", "n", shape="round(0.5 * (1.0 - m * m / s), 5)", scale="round(0.5 * m * (m * m / s + 1.0), 5)"),
    "diffusion_approx_heavy_traffic_v1": days.agg("event_type", drift="avg(n)", diffusion="var_pop(n)").select("event_type", drift="round(drift, 6)", dispersion="round(diffusion / drift, 6)"),
    "bathtub_curve_lifecycle_v1": events.join(events.agg("event_type", p90="PCT(value, 0.9)", t0="min(US(ts))", t1="max(US(ts))"), "event_type").add(third="least(2, CAST(floor(3.0 * (US(ts) - t0) / nullif(t1 - t0, 0)) AS BIGINT))").agg("event_type", "third", hazard="round(avg(CASE WHEN value > p90 THEN 1.0 ELSE 0.0 END), 9)"),
    "weber_fechner_threshold_v1": hours.add(p=f"lag(v) {BY}").where("p > 0").agg("event_type", jnd="round(PCT(abs(v - p) / p, 0.5), 6)"),
    "red_queen_arms_race_v1": hours.add(dn=f"n - lag(n) {BY}", dv=f"v - lag(v) {BY}").agg("event_type", r="round(corr(dn, dv), 6)"),
    "close_cycle_duration_shift": events.add(c="CASE WHEN day(ts) >= 20 OR day(ts) <= 5 THEN 1 ELSE 0 END").agg("event_type", a="PCT(CASE WHEN c = 1 THEN value END, 0.5)", b="PCT(CASE WHEN c = 0 THEN value END, 0.5)").select("event_type", delta="round(a - b, 6)", slowdown="round(a / nullif(b, 0.0), 6)"),
}

for _name, _plan in PLANS.items():
    add_plan(_name, _plan)
