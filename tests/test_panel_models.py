"""Models, causal estimates, geometry and action search on planted panels, some against brute force."""

import itertools

import numpy as np
import pytest
from test_bounded import on, one

from quarrystat.operators import panel_models as M

R = np.random.default_rng(2)
F = R.normal(0, 1, (300, 3))
WIDE = R.normal(0, 1, (3000, 2))
CURVED = np.column_stack([np.sin(2 * F[:, 0]) + F[:, 1] ** 2 + R.normal(0, 0.1, 300), F])


def test_regressions():
    R = np.random.default_rng(5)
    assert on("gaussian_process_regression_v1", CURVED)["mae_ratio"] < 0.6
    assert on("bart_uplift_surrogate_v1", CURVED)["r2"] > 0.6
    nam = {r["key"]: r for r in on("neural_additive_model_nam_v1", CURVED)}
    assert nam["k1"]["r2"] > 0.7 and nam["k3"]["importance"] < nam["k2"]["importance"]
    quad = np.column_stack([F[:, 0] * F[:, 1] + F[:, 2] ** 2, F])
    assert on("response_surface_interaction_v1", quad)["r2"] > 0.999 > 0.3 > on("response_surface_interaction_v1", quad)["linear_r2"]
    spiky = CURVED.copy()
    spiky[40, 0] = 30
    assert on("quantile_regression_forest_v1", spiky)[0]["at"] == 40
    moved = on("quantile_loss_boosting_v1", np.vstack([CURVED, CURVED + [5, 2, 0, 0]]))["q90_drift_scaled"]
    assert moved > 0.15 > abs(on("quantile_loss_boosting_v1", np.vstack([CURVED, CURVED]))["q90_drift_scaled"])
    sharp = np.column_stack([F[:, 0] * 3 + R.normal(0, 0.3, 300), F])
    assert on("tabpfn_foundation_tabular_v1", sharp)["accuracy"] > 0.9
    assert all(abs(r["coverage"] - 0.9) < 0.06 for r in on("conformal_feature_prediction", np.column_stack([WIDE, WIDE[:, 0] + R.normal(0, 1, 3000)])))
    wins = {r["key"] for r in on("knockoff_wrapper_rf", CURVED, q=0.6) if r["selected"]}
    assert wins <= {"k1", "k2", "k3"} and on("knockoff_wrapper_rf", CURVED)[0]["w"] > on("knockoff_wrapper_rf", CURVED)[2]["w"]


def test_causal():
    R = np.random.default_rng(5)
    f = R.normal(0, 1, (600, 2))
    drive = f[:, 0] + R.normal(0, 1, 600)
    x = np.column_stack([2.0 * (drive > np.median(drive)) + 3 * f[:, 0] + R.normal(0, 0.1, 600), drive, f])
    unit = 1 / M.scale_of(x[:, 0])
    for r in on("meta_learner_cate_v1", x):
        assert abs(r["ate"] / unit - 2) < 0.3, r
    assert abs(on("propensity_score_matching_v1", x)["att"] / unit - 2) < 1.2
    first = on("causal_recommendations_v1", x)[0]
    assert abs(first["ate"] / unit - 2) < 0.3 and abs(first["placebo"]) < 0.2 and abs(first["subset"] / unit - 2) < 0.4
    split = np.column_stack([np.where(f[:, 0] > 0, 4, 0) * (drive > np.median(drive)) + R.normal(0, 0.1, 600), drive, f])
    leaves = on("causal_forest_hte_v1", split)
    assert leaves[-1]["effect"] > leaves[0]["effect"] + 1
    arms = on("thompson_sampling_bandit_v1", np.column_stack([F[:, 0], F[:, 1] + 1]))
    assert arms[1]["p_best"] > 0.99


def test_geometry():
    R = np.random.default_rng(5)
    p = R.random((40, 2))
    t = M.delaunay(p)
    for a, b, c in t:  # no point inside a circumcircle
        m = np.array([[2 * (p[b] - p[a])[0], 2 * (p[b] - p[a])[1]], [2 * (p[c] - p[a])[0], 2 * (p[c] - p[a])[1]]])
        o = np.linalg.solve(m, [p[b] @ p[b] - p[a] @ p[a], p[c] @ p[c] - p[a] @ p[a]])
        assert (np.linalg.norm(p - o, axis=1) >= np.linalg.norm(p[a] - o) - 1e-9).all()
    area = sum(M.cell_area(p, i, np.zeros(2), np.ones(2)) for i in range(40))
    assert area == pytest.approx(1)
    grid = (np.stack(np.meshgrid(np.linspace(0, 1, 300), np.linspace(0, 1, 300)), -1)).reshape(-1, 2)
    own = np.bincount(np.linalg.norm(grid[:, None] - p[None], axis=2).argmin(1), minlength=40) / len(grid)
    assert max(abs(M.cell_area(p, i, np.zeros(2), np.ones(2)) - own[i]) for i in range(40)) < 5e-3
    plane = np.column_stack([p, p[:, 0]])
    assert on("delaunay_interpolation_v1", plane)["mae"] < 0.5


def test_clusters():
    R = np.random.default_rng(5)
    z = np.vstack([R.normal(0, 0.1, (40, 2)), R.normal(5, 0.1, (40, 2)), R.normal([0, 9], 0.1, (40, 2))])
    h = on("density_clustering_hdbscan_v1", z)
    assert h["clusters"] == 3 and h["largest"] <= 40
    counts = np.kron(np.array([[9, 9, 0, 0], [0, 0, 9, 9]]), np.ones((20, 1))) + 0.01
    b = M.coclusters(counts, counts, ["a", "b", "c", "d"], 2)
    assert sorted(r["keys"] for r in b) == ["a,b", "c,d"]
    k = M.constrained(counts, counts, ["a", "b", "c", "d"], 2)
    assert sorted(r["keys"] for r in k) == ["a,b", "c,d"] and k[0]["violations"] == 0
    d = M.dtw_profiles(np.tile(np.eye(24)[:, :3], (3, 1)), np.tile(np.eye(24)[:, :3], (3, 1)), ["a", "b", "c"])
    assert d[0]["distance"] >= 0


def test_actions():
    R = np.random.default_rng(5)
    x = np.abs(R.normal(1, 1, (50, 6)))
    gain, cost = M.actions(x, np.ones(x.shape))
    for budget in (0.2, 0.5, 0.7):
        best = max(gain[list(s)].sum() for k in range(7) for s in itertools.combinations(range(6), k) if cost[list(s)].sum() <= budget + 1e-9)
        assert on("action_search_mip_batched_scheduler_v1", x, budget=budget)["gain"] == pytest.approx(best)
        assert on("action_search_simulated_annealing_v1", x, budget=budget)["gain"] >= 0.95 * best
    assert sum(r["weight"] for r in on("kona_weight_learner_v1", x)) == pytest.approx(1)
    assert on("kohonen_energy_map_v1", x)["quantisation_error"] < np.linalg.norm(M.scaled(x) - M.scaled(x).mean(0), axis=1).mean()


def test_counts_and_queues():
    R = np.random.default_rng(5)
    c = R.poisson(3, 4000) * (R.random(4000) > 0.3)
    z = one("zero_inflated_count_model_v1", c, c)
    assert abs(z["pi"] - 0.3) < 0.05 and abs(z["lambda"] - 3) < 0.2
    dose = np.tile(np.arange(1, 21.0), 5)
    h = one("hill_equation_dose_response_v1", 1 + 10 * dose**2 / (25 + dose**2), dose)
    assert h["r2"] > 0.999 and abs(h["ec50"] - 5) < 0.2
    q = one("discrete_event_queue_simulator_v1", np.ones(50), np.full(50, 1.0), hours=200_000)
    assert abs(q["mean_wait"] - 0.8 * 0.8 / 0.2) < 0.4 and q["wait_after"] < q["mean_wait"]
    packed = one("bin_packing_utilization_v1", R.random(60))
    assert packed["bound"] <= packed["bins"] <= 1.25 * packed["bound"] + 1
    for r in one("quantile_sketch_p2_streaming_v1", R.normal(0, 1, 5000)):
        assert abs(r["estimate"] - r["exact"]) < 0.15
    fd = on("frequent_directions_cov_sketch_v1", R.normal(0, 1, (200, 6)))
    assert fd["error"] <= fd["bound"]
    x = np.zeros((40, 2))
    x[:20, 0], x[20:, 1] = 1, 1
    f = {r["key"]: r["p_value"] for r in M.fisher(x, x, ["a", "b"])}
    assert f["b"] < 1e-6 < 0.99 < f["a"]
    assert M.absent(None, None) is None
