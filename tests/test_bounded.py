"""Series, panel, network and moment operators: planted signals, closed forms, brute force, and the frame around them."""

import itertools

import numpy as np
import pytest

from quarrystat.operators import bound, covariance, network, panel, series  # noqa: F401
from quarrystat.plans.bounded import OPERATORS, apply

R = np.random.default_rng(1)
FLAT = R.normal(10, 1, 300)
STEP = np.concatenate([R.normal(0, 1, 150), R.normal(6, 1, 150)])
SINE = 5 + np.sin(2 * np.pi * np.arange(240) / 24) + R.normal(0, 0.1, 240)
KEYS = ["a", "b", "c"]


def body(name, *args, **more):
    op = OPERATORS[name]
    return op.body(*args, **(op.params | more))


def one(name, y, c=None, **more):
    return body(name, y, np.ones(len(y)) if c is None else c, **more)


def on(name, x, **more):
    return body(name, x, np.ones(x.shape), [f"k{i}" for i in range(x.shape[1])], **more)


def net(name, w, **more):
    w = np.array(w, dtype=float)
    return body(name, [f"n{i}" for i in range(len(w))], w, **more)


@pytest.mark.parametrize("name", ["changepoint_pelt", "wild_binary_segmentation_v1", "drift_adwin", "bocpd_gaussian", "changepoint_method_survey_guided", "change_score_consensus_v1", "state_space_smoother_level_shift_v1", "bsts_intervention_counterfactual_v1", "piecewise_linear_trend_changepoints_v1"])
def test_a_step_is_found(name):
    r = one(name, STEP)
    rows = r if isinstance(r, list) else [r]
    at = [int(x) for row in rows for x in str(row.get("at", row.get("t0"))).split(",")]
    assert any(abs(a - 150) <= (30 if name == "drift_adwin" else 8) for a in at), at


@pytest.mark.parametrize("name", ["changepoint_pelt", "wild_binary_segmentation_v1", "drift_adwin"])
def test_nothing_in_noise(name):
    assert len(one(name, FLAT)) == 0


def test_pelt_is_the_best_segmentation():
    y = np.concatenate([R.normal(m, 1, 12) for m in (0, 4, 1)])
    cost = lambda a, b: ((y[a:b] - y[a:b].mean()) ** 2).sum()
    best = min(
        (sum(cost(a, b) for a, b in zip([0, *cut], [*cut, len(y)])) + 5.0 * len(cut), cut)
        for k in range(4) for cut in itertools.combinations(range(5, len(y) - 4), k) if all(b - a >= 5 for a, b in zip([0, *cut], [*cut, len(y)]))
    )
    assert series.pelt(y, 5.0) == list(best[1])


def test_energy_and_permutations():
    a, b = R.normal(0, 1, 40), R.normal(1, 2, 50)
    d = lambda p, q: np.abs(p[:, None] - q[None, :]).mean()
    assert abs(series.energy(a, b) - (2 * d(a, b) - d(a, a) - d(b, b))) < 1e-9
    assert one("changepoint_energy_edivisive", STEP[100:200])["confidence"] == 1.0
    assert one("randomization_test_median_shift_v1", STEP)["p_value"] <= 0.001 + 1e-12 < one("randomization_test_median_shift_v1", FLAT)["p_value"]
    low, high = (one("bootstrap_ci_effect_sizes_v1", FLAT)[k] for k in ("low", "high"))
    assert low < 0.3 and high > -0.3 and one("bootstrap_ci_effect_sizes_v1", STEP)["low"] > 1


def test_halves():
    assert one("sinkhorn_ot_drift_v1", STEP, epsilon=0.01)["cost"] > 0.4 > one("sinkhorn_ot_drift_v1", FLAT)["cost"]
    assert abs(one("sliced_wasserstein_drift_v1", np.concatenate([FLAT[:150], FLAT[:150] + 3]))["distance"] - 3) < 1e-9
    x = FLAT[:60]
    m, tol = 2, 0.2 * np.std(x)
    pairs = lambda k: sum(np.max(np.abs(x[i : i + k] - x[j : j + k])) <= tol for i in range(58) for j in range(58) if i != j)
    want = -np.log(pairs(m + 1) / pairs(m))
    assert series.sampen(x) == pytest.approx(want)


def test_spectra_and_forecasts():
    assert one("polyrhythm_contention_v1", SINE)["cycle"] == 24
    assert one("self_similarity_matrix_v1", SINE)["best_lag"] % 24 == 0
    y = SINE.copy()
    y[200] += 9
    hw = one("seasonal_holt_winters_forecast_residuals_v1", y)
    assert hw["spikes"] >= 1 and hw["max_z"] > 10
    assert one("reservoir_computing_esn_v1", SINE)["rmse"] < one("reservoir_computing_esn_v1", SINE)["naive_rmse"]
    mp = one("matrix_profile_motifs_discords", y)
    assert 188 < mp["discord_at"] <= 200
    assert one("matched_filter_anomaly_v1", y)[0]["detections"] >= 1
    assert one("synchrosqueezing_drift_v1", np.sin(np.arange(256) ** 2 / 400))["freq_shift"] > 0.1
    assert one("pulsar_timing_residual_v1", SINE)["periodic_lag"] in (23, 24, 25, 47, 48, 49, 71, 72, 73)


def test_chaos():
    x = np.empty(400)
    x[0] = 0.3
    for i in range(399):
        x[i + 1] = 4 * x[i] * (1 - x[i])
    assert one("lyapunov_exponent_chaos_v1", x, dim=1)["exponent"] > 0.3 > abs(one("lyapunov_exponent_chaos_v1", np.sin(np.arange(400) / 5))["exponent"])
    assert one("takens_embedding_v1", x)["dimension"] <= 3
    alternating = np.tile([0.0, 1.0], 100)
    assert one("excess_entropy_memory_v1", alternating, bins=2)["entropy_rate"] < 0.02
    assert one("markov_harmonic_progression_v1", alternating, bins=2)["norm_entropy"] == pytest.approx(0)
    assert one("recurrence_quantification_rqa_v1", SINE)["determinism"] > one("recurrence_quantification_rqa_v1", FLAT)["determinism"]
    assert one("kolmogorov_complexity_ncd_v1", np.tile(FLAT[:37], 8))["mean_ncd"] < one("kolmogorov_complexity_ncd_v1", FLAT)["mean_ncd"]


def test_points():
    even, packed = np.ones(200), np.zeros(200)
    packed[::20] = 10
    assert not one("ripley_k_temporal_clustering_v1", even, even)[0]["clustered"] and one("ripley_k_temporal_clustering_v1", packed, packed)[0]["clustered"]
    n, c = 200, packed
    times = np.repeat(np.arange(n), c.astype(int))
    for r in one("ripley_k_temporal_clustering_v1", packed, packed, radii=3):
        d = np.abs(times[:, None] - times[None, :])
        share = (np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]) <= r["radius"]).mean()
        pairs = ((d <= r["radius"]).sum() - len(times)) / (len(times) * (len(times) - 1))
        assert r["k_ratio"] == pytest.approx(pairs / share)
    g = R.gumbel(5, 2, 60_000)
    e = one("return_period_evt_v1", g, block=1)
    assert abs(e["shape"]) < 0.03 and abs(e["scale"] - 2) < 0.1 and abs(e["location"] - 5) < 0.1
    assert one("dp_gmm", np.concatenate([R.normal(-8, 1, 100), R.normal(8, 1, 100)]))["components"] == 2


def test_panel_outliers():
    x = R.normal(0, 1, (200, 3))
    x[77] = [9, -9, 9]
    for name in ("isolation_forest_anomaly", "local_outlier_factor", "one_class_svm", "robust_pca_sparse_outliers", "geometric_median_multivariate_location_v1"):
        assert on(name, x)[0]["at"] == 77, name
    for name in ("multivariate_ewma_control", "pca_control_chart"):
        assert abs(on(name, x)["at"] - 77) <= 1, name
    assert on("multivariate_control_charts", x)[0]["at"] == on("normalizing_flow_density_v1", x)["at"] == 77
    line = np.column_stack([np.arange(100.0), 2 * np.arange(100.0) + R.normal(0, 0.1, 100)])
    line[:10, 1] += 500
    h = on("robust_regression_huber_ransac_v1", line)
    assert abs(h["slope_huber"] - 2) < abs(h["slope_ols"] - 2) and abs(h["slope_ransac"] - 2) < 0.01


def test_lof_by_hand():
    z, k = R.normal(0, 1, (30, 2)), 4
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    near = [sorted((d[i, j], j) for j in range(30) if j != i)[:k] for i in range(30)]
    density = [k / sum(max(x, near[j][-1][0]) for x, j in near[i]) for i in range(30)]
    want = [np.mean([density[j] for _, j in near[i]]) / density[i] for i in range(30)]
    assert np.allclose(panel.lof(z, k), want)


def test_panel_dependence():
    a = R.normal(0, 1, 150)
    x = np.column_stack([a, a**2, R.normal(0, 1, 150)])
    d = {(r["key_a"], r["key_b"]): r for r in on("distance_covariance_dependence_v1", x)}
    assert d["k0", "k1"]["p_value"] <= 0.02 < d["k0", "k2"]["p_value"]
    m = on("hsic_independence_screen_v1", x)
    assert max(m, key=lambda r: r["hsic"])["key_b"] == "k1"
    shifted = np.vstack([R.normal(0, 1, (60, 2)), R.normal(2, 1, (60, 2))])
    for name in ("kernel_two_sample_mmd", "knn_graph_two_sample_test_v1"):
        assert on(name, shifted)["p_value"] <= 0.01 < on(name, R.normal(0, 1, (120, 2)))["p_value"] + 0.01
    lagged = np.column_stack([a, np.roll(a, 3)])
    assert any(r["indirect"] and r["best_lag"] == 3 for r in on("ekman_transport_indirect_v1", lagged))
    s = on("synthetic_control_v1", np.column_stack([0.3 * a + 0.7 * x[:, 2], a, x[:, 2]]))
    assert [round(r["weight"], 3) for r in s] == [0.3, 0.7]


def test_topology():
    z = np.array([[0.0, 0], [1, 0], [0, 1], [10, 10], [11, 10]])
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    assert np.allclose(panel.mst(d), [1, 1, 1, np.hypot(10, 9)])
    want = 5 - sum(d[i, j] <= 1.5 for i in range(5) for j in range(i)) + sum(max(d[i, j], d[j, k], d[i, k]) <= 1.5 for i, j, k in itertools.combinations(range(5), 3))
    assert panel.euler(d, 1.5) == want
    ring = np.column_stack([np.cos(np.arange(20) * 0.314159), np.sin(np.arange(20) * 0.314159)])
    assert panel.betti1(np.linalg.norm(ring[:, None] - ring[None], axis=2), 2) == 1
    square = panel.convex_hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]]))
    assert {tuple(p) for p in square} == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_embeddings():
    groups = np.vstack([R.normal(m, 0.2, (30, 2)) for m in (0, 5, 10)])
    for name in ("tsne_embedding_v1", "umap_embedding_v1"):
        assert on(name, groups)["silhouette"] > 0.7
    assert on("seriation_ordering_v1", groups[R.permutation(90)])["improvement_pct"] > 50
    assert on("hmm_workflow_state_v1", groups)["best_n_states"] >= 3
    low = R.random((60, 1)) @ R.random((1, 4))
    assert on("nonnegative_matrix_factorization_v1", low, rank=1)["error_ratio"] < 0.05
    assert on("cur_decomposition_explain_v1", R.normal(0, 1, (50, 2)))[0]["error"] < 1e-9
    assert on("ica_source_separation_v1", np.column_stack([R.laplace(size=2000), R.normal(size=2000)]) @ np.array([[1, 0.5], [0.2, 1]]))[0]["kurtosis"] > 1.5


PATH = [[0, 5, 0, 0], [0, 0, 3, 0], [0, 0, 0, 4], [0, 0, 0, 0]]
BARBELL = np.zeros((6, 6))
for _i, _j in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]:
    BARBELL[_i, _j] = 3
BARBELL[2, 3] = 1


def test_networks():
    for name in ("dependency_community_louvain_v1", "dependency_community_leiden_v1", "community_detection_dag_v1"):
        assert sorted(r["members"] for r in net(name, BARBELL)) == ["n0,n1,n2", "n3,n4,n5"]
    assert net("graph_min_cut_partition_v1", BARBELL)["cut"] == 1
    assert net("cheeger_bottleneck_v1", BARBELL)["side"] in ("n0,n1,n2", "n3,n4,n5")
    b = net("weak_ties_bridge_v1", BARBELL)
    assert (b["n_bridges"], b["edges"]) == (1, 7)
    assert net("min_cost_flow_throughput_v1", PATH)["flow"] == 3
    assert net("fault_tree_minimal_cuts_v1", PATH) == {"min_cut_size": 1, "n_cut_sets": 2}
    assert net("graph_coloring_resources_v1", BARBELL)["n_colors"] == net("graph_coloring_resources_v1", BARBELL)["clique"] == 3
    assert [r["node"] for r in net("heaviest_path", PATH)] == ["n0", "n1", "n2", "n3"]
    assert net("heaviest_path", PATH)[0]["length"] == 12
    assert net("harris_matrix_ordering_v1", PATH)["n_layers"] == 4 and net("network_controllability_v1", PATH)["n_drivers"] == 1
    assert net("vorticity_thrashing_v1", [[0, 1, 0], [0, 0, 1], [1, 0, 0]])["recirculation_rate"] == 1 and net("vorticity_thrashing_v1", PATH)["cycle_edges"] == 0
    assert net("contact_tracing_superspreader_v1", PATH)["max_reach"] == 3
    assert net("temporal_network_bottleneck_v1", PATH)[0]["betweenness"] == 2
    assert net("spectral_graph_fiedler_v1", np.array(PATH) > 0)["lambda_2"] == pytest.approx(2 - np.sqrt(2))
    assert net("grothendieck_coverage_v1", [[0, 1, 1], [0, 0, 0], [0, 0, 0]])["cover"] == 1


def test_min_cut_by_brute_force():
    for _ in range(20):
        w = R.integers(0, 4, (6, 6)) * (R.random((6, 6)) < 0.6)
        a = network.undirected(w.astype(float))
        want = min(a[np.ix_(s, [i for i in range(6) if i not in s])].sum() for k in range(1, 4) for s in map(list, itertools.combinations(range(6), k)))
        assert net("graph_min_cut_partition_v1", w)["cut"] == want
        s, t = 0, 5
        cut = min(sum(w[i, j] for i in side for j in range(6) if j not in side) for k in range(5) for rest in itertools.combinations(range(1, 5), k) for side in [{s, *rest}])
        assert network.max_flow(w.astype(float), s, t) == cut


def test_moments():
    n = 5000
    a, b = R.normal(size=n), R.normal(size=n)
    x = np.column_stack([2 * a - b + 0.1 * R.normal(size=n), a, b, R.normal(size=n)])
    args = n, x.mean(0), np.cov(x.T, bias=True), ["y", "a", "b", "c"]
    r = {q["column"]: q["coefficient"] for q in body("regression_auto", *args, ridge=0.0)}
    want = np.linalg.lstsq(np.column_stack([np.ones(n), x[:, 1:]]), x[:, 0], rcond=None)[0][1:]
    assert np.allclose([r["a"], r["b"], r["c"]], want)
    edges = {frozenset((e["source"], e["target"])) for e in body("ges_score_based_causal_v1", *args)}
    assert {frozenset("ya"), frozenset("yb")} <= edges and frozenset("yc") not in edges
    assert {q["column"] for q in body("gaussian_knockoffs", *args, q=0.6) if q["selected"]} >= {"a", "b"}
    k = {frozenset((q["column_a"], q["column_b"])) for q in body("graphical_lasso_dependency_network", *args)}
    assert frozenset("ya") in k and frozenset("yc") not in k
    lam0 = covariance.glasso(covariance.correlation(args[2]), 0.0)
    assert np.allclose(lam0, np.linalg.inv(covariance.correlation(args[2])), rtol=1e-3, atol=1e-3)
    total = sum(q["interaction"] for q in body("shapley_interactions_v1", *args))
    assert abs(total) < 1.0
    c = body("cca_crossblock_association_v1", n, np.zeros(4), np.array([[1, 0, 0.8, 0], [0, 1, 0, 0.3], [0.8, 0, 1, 0], [0, 0.3, 0, 1]]), list("abcd"))
    assert c["top_corr"] == pytest.approx(0.8) and c["second_corr"] == pytest.approx(0.3)


ROLES = {"series": {"time": "when", "key": "kind", "value": "x"}, "panel": {"time": "when", "key": "kind", "value": "x"}, "network": {"source": "kind", "target": "other", "weight": "x"}, "moments": {"columns": ["x", "z"]}}


@pytest.mark.parametrize("name", ["r2r_ewma_control_v1", "changepoint_pelt", "pca_control_chart", "graph_min_cut_partition_v1", "cca_crossblock_association_v1"])
def test_frame(spark, name):
    """Other columns and names, nulls, too few rows, an empty table."""
    op = OPERATORS[name]
    rows = [(f"2024-01-{1 + i // 24:02d} {i % 24:02d}:30:00", "ab"[i % 2] if i % 9 else None, "bc"[i % 2], float(i % 7) if i % 11 else None, float(i * i % 13), 1) for i in range(300)]
    df = spark.createDataFrame(rows, "t string, kind string, other string, x double, z double, n long").selectExpr("CAST(t AS TIMESTAMP) AS when", "*")
    got = apply(name, df, **ROLES[op.kind]).collect()
    assert got and all(r["status"] in ("ok", "na") for r in got)
    if op.kind == "series":
        assert {r["key"] for r in got} == {"a", "b"}
    if op.kind == "moments":
        assert got[0]["n"] == sum(r[3] is not None for r in rows)
    few = apply(name, df.limit(1), **ROLES[op.kind]).collect()
    assert all(r["status"] == "na" for r in few)
    none = apply(name, df.where("false"), **ROLES[op.kind]).collect()
    assert none == [] if op.kind == "series" else [(r["n"], r["status"]) for r in none] == [(0, "na")]


def test_moments_are_exact_and_partitions_do_not_matter(spark, sf):
    from quarrystat.plans.bounded import moment_row

    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    x = np.array(df.collect())
    for parts in (1, 7):
        r = moment_row(df.repartition(parts), df.columns).first()
        assert r["n"] == len(x) and np.allclose(r["means"], x.mean(0)) and np.allclose(r["products"], np.cov(x.T, bias=True)[np.triu_indices(2)])


def test_early_half(spark):
    from quarrystat.plans.halves import early_half

    r = np.random.default_rng(4)
    for n, spread in ((0, 1), (1, 1), (2, 5), (101, 3), (400, 20_000)):
        rows = [(int(t) * 400_000, i) for i, t in enumerate(r.integers(0, spread * 10, n))]
        df = spark.createDataFrame([*rows, (None, -1)], "t long, i long").repartition(3)
        got = {x["i"] for x in early_half(df, ["t", "i"]).where("early = 1").collect()}
        assert got == {i for _, i in sorted(rows)[: n // 2]}
