"""Fitted models, causal estimates, geometry and action search on the panel of time buckets by keys (see ``plans.bounded``).

The first key is the target or outcome; a key above its median is a treatment; the others are features."""

from __future__ import annotations

import numpy as np

from quarrystat.operators.panel import kmeans, pca, scaled
from quarrystat.operators.series import distances, scale_of
from quarrystat.plans.bounded import operator


def ols(x: np.ndarray, y: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    return np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]) + 1e-12 * np.eye(a.shape[1]), a.T @ y)


def predict(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return b[0] + x @ b[1:]


def r2(y: np.ndarray, f: np.ndarray) -> float:
    return float(1 - ((y - f) ** 2).sum() / max(((y - y.mean()) ** 2).sum(), 1e-300))


def logistic(x: np.ndarray, t: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probabilities of a ridge-damped logistic regression by Newton steps."""
    a, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(b)), a.T @ (t - p) - 1e-3 * b)
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))


def tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, r: np.random.Generator | None = None):
    """A regression tree as nested tuples; with ``r`` each split looks at a third of the columns. Leaves keep their rows' y."""
    cols = range(x.shape[1]) if r is None else r.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False)
    best = None
    for j in cols if depth and len(y) >= 2 * least else ():
        o = np.argsort(x[:, j], kind="stable")
        s, n, k = np.cumsum(y[o])[:-1], len(y), np.arange(1, len(y))
        gain = s * s / k + (y.sum() - s) ** 2 / (n - k)
        ok = (x[o[1:], j] > x[o[:-1], j]) & (k >= least) & (n - k >= least)
        if ok.any():
            i = int(np.argmax(np.where(ok, gain, -np.inf)))
            g = gain[i] - y.sum() ** 2 / n
            if g > 1e-12 and (best is None or g > best[0]):
                best = g, j, (x[o[i], j] + x[o[i + 1], j]) / 2
    if best is None:
        return y
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], tree(x[left], y[left], depth - 1, least, r), tree(x[~left], y[~left], depth - 1, least, r), best[0]


def leaf(node, row: np.ndarray) -> np.ndarray:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def fitted(node, x: np.ndarray, q: float | None = None) -> np.ndarray:
    return np.array([leaf(node, v).mean() if q is None else np.quantile(leaf(node, v), q) for v in x])


def importance(node, out: np.ndarray) -> np.ndarray:
    if isinstance(node, tuple):
        out[node[0]] += node[4]
        importance(node[2], out)
        importance(node[3], out)
    return out


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    return None if x.shape[1] < 2 else (scaled(x)[:, 1:], scaled(x)[:, 0])


@operator("panel", "gaussian_process_regression_v1", "mae double, mae_ratio double", 30, noise=0.5)
def gaussian_process(x, c, keys, noise):
    """Gaussian process with an RBF kernel at the median distance, fitted on even and judged on odd rows, against the mean."""
    if (d := split(x)) is None:
        return None
    f, y = d
    a, b = np.arange(0, len(y), 2), np.arange(1, len(y), 2)
    g = np.median(distances(f[a], f[a])) or 1.0
    k = lambda p, q: np.exp(-0.5 * (distances(p, q) / g) ** 2)
    m = y[a].mean()
    e = np.abs(y[b] - m - k(f[b], f[a]) @ np.linalg.solve(k(f[a], f[a]) + noise * np.eye(len(a)), y[a] - m)).mean()
    return {"mae": e, "mae_ratio": e / max(np.abs(y[b] - m).mean(), 1e-12)}


@operator("panel", "quantile_loss_boosting_v1", "pinball_50 double, pinball_90 double, q90_drift_scaled double", 40, rounds=60, rate=0.1)
def quantile_boosting(x, c, keys, rounds, rate):
    """Boosted stumps on the pinball loss; how the predicted 90th percentile moves between halves, in robust deviations."""
    if (d := split(x)) is None:
        return None
    f, y = d
    out = {}
    for q in (0.5, 0.9):
        p = np.full(len(y), np.quantile(y, q))
        for _ in range(rounds):
            node = tree(f, np.where(y > p, q, q - 1), 1, 10)
            if not isinstance(node, tuple):
                break
            left = f[:, node[0]] <= node[1]
            for side in (left, ~left):
                p[side] += rate * np.quantile(y[side] - p[side], q)
        out[q] = p, np.maximum(q * (y - p), (q - 1) * (y - p)).mean()
    p = out[0.9][0]
    return {"pinball_50": out[0.5][1], "pinball_90": out[0.9][1], "q90_drift_scaled": (np.median(p[len(p) // 2 :]) - np.median(p[: len(p) // 2])) / scale_of(y)}


@operator("panel", "quantile_regression_forest_v1", "at long, actual double, q90_pred double, residual double", 40, trees=25, depth=5, top=10, seed=21)
def quantile_forest(x, c, keys, trees, depth, top, seed):
    """90th percentile of the leaves' pooled values over a forest; rows farthest above it."""
    if (d := split(x)) is None:
        return None
    f, y = d
    r, pooled = np.random.default_rng(seed), [[] for _ in y]
    for _ in range(trees):
        i = r.choice(len(y), len(y))
        node = tree(f[i], y[i], depth, 5, r)
        for k, v in enumerate(f):
            pooled[k].append(leaf(node, v))
    q = np.array([np.quantile(np.concatenate(p), 0.9) for p in pooled])
    return [{"at": int(i), "actual": y[i], "q90_pred": q[i], "residual": y[i] - q[i]} for i in np.argsort(q - y, kind="stable")[:top]]


@operator("panel", "bart_uplift_surrogate_v1", "r2 double, trees long", 40, rounds=50, rate=0.1)
def boosted(x, c, keys, rounds, rate):
    """In-sample R² of boosted trees of depth two."""
    if (d := split(x)) is None:
        return None
    f, y = d
    p = np.full(len(y), y.mean())
    for _ in range(rounds):
        p = p + rate * fitted(tree(f, y - p, 2, 5), f)
    return {"r2": r2(y, p), "trees": rounds}


@operator("panel", "neural_additive_model_nam_v1", "key string, importance double, r2 double", 40, bins=8, rounds=10)
def additive(x, c, keys, bins, rounds):
    """Sum of one step function of quantile bins for each feature, by backfitting."""
    if (d := split(x)) is None:
        return None
    f, y = d
    place = [np.searchsorted(np.unique(np.quantile(v, np.arange(1, bins) / bins)), v, "right") for v in f.T]
    part = np.zeros(f.shape)
    for _ in range(rounds):
        for j, b in enumerate(place):
            e = y - y.mean() - part.sum(1) + part[:, j]
            s, n = np.bincount(b, weights=e), np.maximum(np.bincount(b), 1)
            part[:, j] = (s / n)[b] - e.mean()
    fit = r2(y, y.mean() + part.sum(1))
    return [{"key": k, "importance": np.abs(part[:, j]).mean(), "r2": fit} for j, k in enumerate(keys[1:])]


@operator("panel", "tabpfn_foundation_tabular_v1", "accuracy double, base_rate double", 40, folds=5, trees=20, seed=22)
def tabular(x, c, keys, folds, trees, seed):
    """Target above its median: logistic and forest probabilities averaged, cross-validated."""
    if (d := split(x)) is None:
        return None
    f, y = d
    t, r, right = (y > np.median(y)).astype(float), np.random.default_rng(seed), 0
    if t.min() == t.max():
        return None
    for k in range(folds):
        test = np.arange(len(t)) % folds == k
        a = np.column_stack([np.ones((~test).sum()), f[~test]])
        b = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            b = b + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(b)), a.T @ (t[~test] - p) - 1e-2 * b)
        lin = 1 / (1 + np.exp(-np.clip(predict(b, f[test]), -30, 30)))
        wood = np.zeros(test.sum())
        for _ in range(trees):
            i = r.choice(np.flatnonzero(~test), (~test).sum())
            wood += fitted(tree(f[i], t[i], 4, 5, r), f[test])
        right += int((((lin + wood / trees) / 2 > 0.5) == (t[test] > 0.5)).sum())
    return {"accuracy": right / len(t), "base_rate": max(t.mean(), 1 - t.mean())}


@operator("panel", "conformal_feature_prediction", "key string, width double, anomalies long, coverage double", 50, alpha=0.1)
def conformal(x, c, keys, alpha):
    """Each key from the others: fitted on 60, calibrated on 20, judged on the last 20 per cent."""
    z, out = scaled(x), []
    a, b = len(z) * 6 // 10, len(z) * 8 // 10
    for j, k in enumerate(keys):
        f = np.delete(z, j, axis=1)
        e = np.abs(z[:, j] - (predict(ols(f[:a], z[:a, j]), f) if f.shape[1] else z[:a, j].mean()))
        m = b - a
        width = np.sort(e[a:b])[min(m - 1, int(np.ceil((1 - alpha) * (m + 1))) - 1)]
        out.append({"key": k, "width": width, "anomalies": int((e[b:] > width).sum()), "coverage": float((e[b:] <= width).mean())})
    return out


@operator("panel", "bayesian_optimization_v1", "proposal long, expected_improvement double, surrogate double", 30, k=8, proposals=3)
def optimise(x, c, keys, k, proposals):
    """Settings (rows of the features) with the largest expected improvement of the smallest target under a nearest-neighbour surrogate."""
    from statistics import NormalDist

    if (d := split(x)) is None:
        return None
    f, y = d
    near = np.argsort(distances(f, f), axis=1, kind="stable")[:, 1 : k + 1]
    mean, sd = y[near].mean(1), y[near].std(1) + 1e-9
    u, n = (y.min() - mean) / sd, NormalDist()
    ei = np.array([s * (v * n.cdf(v) + n.pdf(v)) for v, s in zip(u, sd)])
    return [{"proposal": int(i), "expected_improvement": ei[i], "surrogate": mean[i]} for i in np.argsort(-ei, kind="stable")[:proposals]]


@operator("panel", "knockoff_wrapper_rf", "key string, w double, selected boolean", 40, trees=30, q=0.3, seed=23)
def wrapper(x, c, keys, trees, q, seed):
    """Forest importance of each feature less that of its shuffled copy."""
    if (d := split(x)) is None:
        return None
    f, y = d
    r, p = np.random.default_rng(seed), x.shape[1] - 1
    both, imp = np.column_stack([f, np.stack([r.permutation(v) for v in f.T], axis=1)]), np.zeros(2 * p)
    for _ in range(trees):
        i = r.choice(len(y), len(y))
        imp = importance(tree(both[i], y[i], 4, 5, r), imp)
    w = (imp[:p] - imp[p:]) / max(imp.sum(), 1e-12)
    limit = min((t for t in np.abs(w) if t > 0 and (1 + (w <= -t).sum()) / max((w >= t).sum(), 1) <= q), default=np.inf)
    return [{"key": k, "w": v, "selected": bool(v >= limit)} for k, v in zip(keys[1:], w)]


@operator("panel", "response_surface_interaction_v1", "r2 double, linear_r2 double, n_predictors long", 40)
def surface_fit(x, c, keys):
    """Quadratic regression with all interactions against the linear one."""
    if (d := split(x)) is None:
        return None
    f, y = d
    quad = np.column_stack([f, *(f[:, i] * f[:, j] for i in range(f.shape[1]) for j in range(i + 1))])
    return {"r2": r2(y, predict(ols(quad, y, 1e-9), quad)), "linear_r2": r2(y, predict(ols(f, y), f)), "n_predictors": quad.shape[1]}


# Causal


def _trial(x):
    """Outcome, treatment and covariates: the first key, the second above its median, the others."""
    if x.shape[1] < 3:
        return None
    z = scaled(x)
    return z[:, 0], (z[:, 1] > np.median(z[:, 1])).astype(float), z[:, 2:]


@operator("panel", "meta_learner_cate_v1", "learner string, ate double, spread double", 40)
def meta(x, c, keys):
    """Effects by S, T and X learners on linear models."""
    if (d := _trial(x)) is None or d[1].min() == d[1].max():
        return None
    y, t, f = d
    s = ols(np.column_stack([t, f, t[:, None] * f]), y)
    cs = s[1] + f @ s[2 + f.shape[1] :]
    b1, b0 = ols(f[t == 1], y[t == 1]), ols(f[t == 0], y[t == 0])
    ct = predict(b1, f) - predict(b0, f)
    d1, d0 = y[t == 1] - predict(b0, f[t == 1]), predict(b1, f[t == 0]) - y[t == 0]
    e = logistic(f, t)
    cx = e * predict(ols(f[t == 0], d0), f) + (1 - e) * predict(ols(f[t == 1], d1), f)
    return [{"learner": n, "ate": v.mean(), "spread": v.std()} for n, v in (("S", cs), ("T", ct), ("X", cx))]


@operator("panel", "propensity_score_matching_v1", "att double, matched long, worst_gap double", 40)
def matching(x, c, keys):
    """Each treated row against the untreated one of the nearest propensity, with replacement."""
    if (d := _trial(x)) is None or d[1].min() == d[1].max():
        return None
    y, t, f = d
    p = logistic(f, t)
    one, none = np.flatnonzero(t == 1), np.flatnonzero(t == 0)
    j = none[np.abs(p[one][:, None] - p[none][None, :]).argmin(1)]
    return {"att": (y[one] - y[j]).mean(), "matched": len(one), "worst_gap": np.abs(p[one] - p[j]).max()}


@operator("panel", "causal_forest_hte_v1", "leaf long, rows long, effect double, ate double", 60, depth=2, least=15)
def causal_tree(x, c, keys, depth, least):
    """Honest causal tree: split on the transformed outcome of even rows, effects of the leaves from odd rows, weighted by propensity."""
    if (d := _trial(x)) is None or d[1].min() == d[1].max():
        return None
    y, t, f = d
    e = np.clip(logistic(f, t), 0.01, 0.99)
    star = y * (t - e) / (e * (1 - e))
    a, b = np.arange(0, len(y), 2), np.arange(1, len(y), 2)
    node = tree(f[a], star[a], depth, least)
    groups: dict[int, list[float]] = {}
    for i in b:
        groups.setdefault(id(leaf(node, f[i])), []).append(star[i])
    found = sorted((float(np.mean(v)), len(v)) for v in groups.values())
    return [{"leaf": k, "rows": n, "effect": v, "ate": star[b].mean()} for k, (v, n) in enumerate(found)]


@operator("panel", "causal_recommendations_v1", "treatment string, ate double, placebo double, subset double", 40, seed=24)
def recommend(x, c, keys, seed):
    """Backdoor-adjusted effect of each treatment; refuted by a shuffled treatment and by a random half of the rows."""
    if x.shape[1] < 3:
        return None
    z, r, out = scaled(x), np.random.default_rng(seed), []
    for j in range(1, x.shape[1]):
        t, f = (z[:, j] > np.median(z[:, j])).astype(float), np.delete(z, [0, j], axis=1)
        effect = lambda t, i: ols(np.column_stack([t[i], f[i]]), z[i, 0])[1]
        every, half = np.arange(len(z)), np.sort(r.choice(len(z), len(z) // 2, replace=False))
        out.append({"treatment": keys[j], "ate": effect(t, every), "placebo": effect(r.permutation(t), every), "subset": effect(t, half)})
    return out


@operator("panel", "thompson_sampling_bandit_v1", "arm string, mean double, p_best double", 10, draws=10_000, seed=25)
def thompson(x, c, keys, draws, seed):
    """Beta posteriors of beating the panel's median, over the cells that have rows; how often each arm is the best."""
    r, seen = np.random.default_rng(seed), c > 0
    win = ((x > np.median(x[seen])) & seen).sum(0)
    theta = r.beta(1 + win, 1 + seen.sum(0) - win, (draws, len(keys)))
    best = np.bincount(theta.argmax(1), minlength=len(keys)) / draws
    return [{"arm": k, "mean": (1 + w) / (2 + n), "p_best": b} for k, w, n, b in zip(keys, win, seen.sum(0), best)]


# Geometry


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles by Bowyer and Watson's insertion."""
    mid, span = p.mean(0), 20 * max(np.ptp(p, axis=0).max(), 1e-9)
    q = np.vstack([p, mid + span * np.array([[-1, -1], [1, -1], [0, 1.5]])])
    n, tri = len(p), np.array([[len(p), len(p) + 1, len(p) + 2]])

    def circle(t):
        a, b, c = (q[t[:, i]] for i in range(3))
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        s = [(v * v).sum(1) for v in (a, b, c)]
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        m = np.stack([(s[0] * (b[:, 1] - c[:, 1]) + s[1] * (c[:, 1] - a[:, 1]) + s[2] * (a[:, 1] - b[:, 1])) / d, (s[0] * (c[:, 0] - b[:, 0]) + s[1] * (a[:, 0] - c[:, 0]) + s[2] * (b[:, 0] - a[:, 0])) / d], axis=1)
        return m, ((a - m) ** 2).sum(1)

    m, r = circle(tri)
    for i in range(n):
        bad = ((q[i] - m) ** 2).sum(1) < r * (1 - 1e-12)
        e = np.sort(np.vstack([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), axis=1)
        e, times = np.unique(e, axis=0, return_counts=True)
        new = np.column_stack([e[times == 1], np.full((times == 1).sum(), i)])
        nm, nr = circle(new)
        tri, m, r = np.vstack([tri[~bad], new]), np.vstack([m[~bad], nm]), np.concatenate([r[~bad], nr])
    return tri[(tri < n).all(1)]


@operator("panel", "delaunay_interpolation_v1", "mae double, n_simplices long", 20)
def interpolation(x, c, keys):
    """Third key at each point of the first two from the mean of its neighbours in the triangulation."""
    if x.shape[1] < 3:
        return None
    p, i = np.unique(scaled(x)[:, :2], axis=0, return_index=True)
    h = scaled(x)[i, 2]
    t = delaunay(p)
    near = np.zeros((len(p), len(p)), dtype=bool)
    for a, b in ((0, 1), (1, 2), (2, 0)):
        near[t[:, a], t[:, b]] = near[t[:, b], t[:, a]] = True
    ok = near.any(1)
    return {"mae": np.abs((near[ok] @ h) / near[ok].sum(1) - h[ok]).mean(), "n_simplices": len(t)}


def cell_area(p: np.ndarray, i: int, low: np.ndarray, high: np.ndarray) -> float:
    """Area of the Voronoi cell of point i in a box: the box cut by bisectors, nearest points first."""
    cell = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]])
    d = np.linalg.norm(p - p[i], axis=1)
    for j in np.argsort(d, kind="stable")[1:]:
        if d[j] > 2 * np.linalg.norm(cell - p[i], axis=1).max():
            break
        if d[j] == 0:
            continue
        side = (cell - (p[i] + p[j]) / 2) @ (p[j] - p[i])
        out = []
        for k in range(len(cell)):
            a, b, u, v = cell[k], cell[(k + 1) % len(cell)], side[k], side[(k + 1) % len(cell)]
            if u <= 0:
                out.append(a)
            if u * v < 0:
                out.append(a + (b - a) * u / (u - v))
        cell = np.array(out)
        if len(cell) < 3:
            return 0.0
    return 0.5 * abs(np.dot(cell[:, 0], np.roll(cell[:, 1], 1)) - np.dot(cell[:, 1], np.roll(cell[:, 0], 1)))


@operator("panel", "voronoi_resource_partition_v1", "cells long, cv_area double", 10)
def voronoi(x, c, keys):
    if x.shape[1] < 2:
        return None
    p = np.unique(scaled(x)[:, :2], axis=0)
    a = np.array([cell_area(p, i, p.min(0), p.max(0)) for i in range(len(p))])
    return {"cells": len(p), "cv_area": a.std() / max(a.mean(), 1e-300)}


# Clusters of keys and rows


@operator("panel", "density_clustering_hdbscan_v1", "clusters long, noise long, largest long", 30, least=8)
def hierarchy(x, c, keys, least):
    """Clusters that live longest in the tree of mutual reachability distances (condensed at ``least`` rows)."""
    z = scaled(x)
    d = distances(z, z)
    core = np.sort(d, axis=1)[:, min(least, len(z) - 1)]
    d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    n, near, left, edges = len(z), d[0].copy(), np.ones(len(z), dtype=bool), []
    left[0], frm = False, np.zeros(len(z), dtype=int)
    for _ in range(n - 1):
        i = int(np.argmin(np.where(left, near, np.inf)))
        edges.append((float(near[i]), int(frm[i]), i))
        left[i] = False
        frm = np.where(left & (d[i] < near), i, frm)
        near = np.minimum(near, d[i])
    group, member = np.arange(n), {i: [i] for i in range(n)}
    joined: dict[int, float] = {}  # of a cluster: the sum of 1 / distance at which its rows came in
    kept: dict[int, tuple[float, list[frozenset]]] = {}  # of a group: stability of the clusters chosen in it, and these
    for w, a, b in sorted(edges):
        ga, gb, lam = int(group[a]), int(group[b]), 1 / max(w, 1e-12)
        both = [kept.pop(g, (0.0, [])) for g in (ga, gb)]
        alive = [g in joined for g in (ga, gb)]
        if all(alive):  # two clusters end here, each itself or what was chosen inside it
            for i, g in enumerate((ga, gb)):
                own = joined.pop(g) - lam * len(member[g])
                if own >= both[i][0] or not both[i][1]:
                    both[i] = own, [frozenset(member[g])]
        rows = member[ga] + member.pop(gb)
        start = lam * len(rows) if all(alive) or not any(alive) else (joined.pop(ga) + lam * (len(rows) - len(member[ga])) if alive[0] else joined.pop(gb) + lam * len(member[ga]))
        if any(alive) or len(rows) >= least:
            joined[ga] = start
        member[ga], kept[ga] = rows, (both[0][0] + both[1][0], both[0][1] + both[1][1])
        group[rows] = ga
    chosen = kept[int(group[0])][1] or [frozenset(range(n))]
    sizes = [len(s) for s in chosen]
    return {"clusters": len(sizes), "noise": n - sum(sizes), "largest": max(sizes)}


@operator("panel", "constrained_clustering_cop_kmeans_v1", "cluster long, keys string, violations long", 2, clusters=2)
def constrained(x, c, keys, clusters):
    """Keys by their count profiles; the two keys that differ most must not be together (cannot-link), the two closest must be."""
    v = c.T / np.maximum(c.T.sum(1, keepdims=True), 1e-12)
    d = distances(v, v)
    far = np.unravel_index(np.argmax(d), d.shape)
    close = np.unravel_index(np.argmin(d + np.diag(np.full(len(d), np.inf))), d.shape) if len(d) > 2 else (0, 0)
    m = v[list(far)][:clusters]
    for _ in range(50):
        label = distances(v, m).argmin(1)
        label[far[0]], label[far[1]] = 0, min(1, clusters - 1)
        if set(close) != set(far):
            label[close[1]] = label[close[0]]
        new = np.stack([v[label == i].mean(0) if (label == i).any() else m[i] for i in range(len(m))])
        if np.allclose(new, m):
            break
        m = new
    bad = int(label[far[0]] == label[far[1]]) + int(set(close) != set(far) and label[close[0]] != label[close[1]])
    return [{"cluster": i, "keys": ",".join(k for k, g in zip(keys, label) if g == i), "violations": bad} for i in range(len(m))]


@operator("panel", "biclustering_cheng_church_v1", "cluster long, rows long, keys string", 20, clusters=2)
def coclusters(x, c, keys, clusters):
    """Spectral co-clustering of buckets and keys by their counts."""
    a = c / np.sqrt(np.maximum(c.sum(1), 1e-12))[:, None] / np.sqrt(np.maximum(c.sum(0), 1e-12))[None, :]
    u, _, v = np.linalg.svd(a, full_matrices=False)
    k = max(1, min(clusters - 1, len(keys) - 1))
    both = np.vstack([u[:, 1 : k + 1] / np.sqrt(np.maximum(c.sum(1), 1e-12))[:, None], v[1 : k + 1].T / np.sqrt(np.maximum(c.sum(0), 1e-12))[:, None]])
    label = kmeans(both, min(clusters, len(both)))
    return [{"cluster": i, "rows": int((label[: len(c)] == i).sum()), "keys": ",".join(q for q, g in zip(keys, label[len(c) :]) if g == i)} for i in range(clusters)]


@operator("panel", "daily_pattern_alignment_dtw_v1", "key string, distance double", 24)
def dtw_profiles(x, c, keys):
    """Each key's profile over 24 positions, warped onto the median profile."""
    prof = np.stack([[v[i::24].mean() for i in range(24)] for v in c.T])
    prof = prof / np.maximum(prof.sum(1, keepdims=True), 1e-12)
    mid = np.median(prof, axis=0)

    def dtw(a, b):
        cost = np.full((len(a) + 1, len(b) + 1), np.inf)
        cost[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
        return cost[-1, -1]

    return [{"key": k, "distance": dtw(p, mid)} for k, p in zip(keys, prof)]


# State space of energies and actions


def energies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled gaps of each row to the ideal (the 10th percentile of each key), and their weighted squares summed."""
    gap = np.maximum(0, x - np.quantile(x, 0.1, axis=0)) / np.maximum(x.std(0), 1e-12)
    return gap, (gap**2).sum(1)


@operator("panel", "kohonen_energy_map_v1", "side long, quantisation_error double, low_energy_share double", 30, rounds=2000, seed=26)
def som(x, c, keys, rounds, seed):
    """Self-organising map of the rows; share of its units whose mean energy is below the median's."""
    z, (_, e), r = scaled(x), energies(x), np.random.default_rng(seed)
    side = int(min(20, max(2, np.ceil(np.sqrt(5 * np.sqrt(len(z)))))))
    at = np.stack(np.meshgrid(np.arange(side), np.arange(side)), -1).reshape(-1, 2)
    v = pca(z)[0][:, :2]
    w = z.mean(0) + (at / max(side - 1, 1) - 0.5)[:, : v.shape[1]] @ (v.T * 2 * z.std())
    for t in range(rounds):
        row = z[r.integers(len(z))]
        hit = at[((w - row) ** 2).sum(1).argmin()]
        f = 1 - t / rounds
        h = np.exp(-((at - hit) ** 2).sum(1) / (2 * (side / 2 * f + 0.5) ** 2))
        w = w + 0.5 * f * h[:, None] * (row - w)
    d = distances(z, w)
    unit = d.argmin(1)
    mean = np.array([e[unit == u].mean() for u in np.unique(unit)])
    return {"side": side, "quantisation_error": d.min(1).mean(), "low_energy_share": float((mean < np.median(e)).mean())}


@operator("panel", "kona_3d_landscape_v1", "u double, v double, energy double", 30, grid=10)
def landscape_grid(x, c, keys, grid):
    """Energy over the plane of two components, by inverse distance on a grid with a margin of 15 per cent."""
    if x.shape[1] < 2:
        return None
    z, (_, e) = scaled(x), energies(x)
    p = (z - z.mean(0)) @ pca(z)[0][:, :2]
    low, high = p.min(0) - 0.15 * np.ptp(p, axis=0), p.max(0) + 0.15 * np.ptp(p, axis=0)
    out = []
    for u in np.linspace(low[0], high[0], grid):
        for v in np.linspace(low[1], high[1], grid):
            w = 1 / np.maximum(((p - [u, v]) ** 2).sum(1), 1e-9)
            out.append({"u": u, "v": v, "energy": (w * e).sum() / w.sum()})
    return out


@operator("panel", "kona_weight_learner_v1", "key string, weight double, objective double", 30, rounds=200, rate=0.5)
def weights(x, c, keys, rounds, rate):
    """Softmax weights under which a row's energy goes best with the events of the next bucket, by gradient ascent on the correlation."""
    gap, _ = energies(x)
    g, y, a = gap[:-1] ** 2, c[1:].sum(1), np.zeros(len(keys))
    score = lambda a: float(np.corrcoef(g @ (np.exp(a) / np.exp(a).sum()), y)[0, 1]) if np.std(y) > 0 else 0.0
    for _ in range(rounds):
        grad = np.array([(score(a + h) - score(a - h)) / 2e-4 for h in 1e-4 * np.eye(len(a))])
        if not np.isfinite(grad).all() or np.abs(grad).max() < 1e-7:
            break
        a = a + rate * grad
    w = np.exp(a) / np.exp(a).sum()
    return [{"key": k, "weight": v, "objective": score(a)} for k, v in zip(keys, w)]


def actions(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and cost of acting on each key: energy that falls when its gaps close by half, and its share of events."""
    gap, _ = energies(x)
    return 0.75 * (gap**2).sum(0), c.sum(0) / max(c.sum(), 1e-12)


@operator("panel", "ideaspace_action_planner", "key string, gap_pct double, gain double", 10, least=0.05)
def plan_actions(x, c, keys, least):
    """Actions on keys whose mean gap exceeds ``least`` of their mean, by gain."""
    gain, _ = actions(x, c)
    pct = np.maximum(0, x - np.quantile(x, 0.1, axis=0)).mean(0) / np.maximum(np.abs(x).mean(0), 1e-12)
    return [{"key": keys[i], "gap_pct": pct[i], "gain": gain[i]} for i in np.argsort(-gain, kind="stable") if pct[i] > least]


@operator("panel", "action_search_mip_batched_scheduler_v1", "chosen string, gain double, cost double", 2, budget=0.5)
def knapsack(x, c, keys, budget):
    """Best set of actions whose costs fit the budget: branch and bound on the relaxed rest."""
    gain, cost = actions(x, c)
    order = np.argsort(-gain / np.maximum(cost, 1e-12), kind="stable")
    best: list = [0.0, ()]

    def bound(k, room):
        total = 0.0
        for i in order[k:]:
            f = min(1.0, room / max(cost[i], 1e-12))
            total += f * gain[i]
            room -= f * cost[i]
            if room <= 1e-12:
                break
        return total

    def go(k, room, value, chosen):
        if value > best[0] + 1e-12:
            best[:] = [value, chosen]
        if k < len(order) and value + bound(k, room) > best[0] + 1e-12:
            i = int(order[k])
            if cost[i] <= room + 1e-12:
                go(k + 1, room - cost[i], value + gain[i], (*chosen, i))
            go(k + 1, room, value, chosen)

    go(0, budget, 0.0, ())
    return {"chosen": ",".join(sorted(keys[i] for i in best[1])), "gain": best[0], "cost": float(sum(cost[i] for i in best[1]))}


@operator("panel", "action_search_simulated_annealing_v1", "chosen string, gain double, cost double", 2, budget=0.5, rounds=5000, seed=27)
def annealing(x, c, keys, budget, rounds, seed):
    gain, cost = actions(x, c)
    r, on = np.random.default_rng(seed), np.zeros(len(keys), dtype=bool)
    best, value = on.copy(), 0.0
    top = gain.max() or 1.0
    for t in range(rounds):
        new = on.copy()
        new[r.integers(len(keys))] ^= True
        if cost[new].sum() > budget + 1e-12:
            continue
        v = gain[new].sum()
        if v >= value or r.random() < np.exp((v - value) / (top * (1 - t / rounds) + 1e-9)):
            on, value = new, v
            if value > gain[best].sum():
                best = on.copy()
    return {"chosen": ",".join(sorted(k for k, b in zip(keys, best) if b)), "gain": gain[best].sum(), "cost": cost[best].sum()}


# Counts and queues of single series


@operator("series", "zero_inflated_count_model_v1", "zero_share double, pi double, lambda double", 20, rounds=500)
def zip_em(y, c, rounds):
    """Expectation maximisation of a Poisson with extra zeros."""
    zero, mean = float((c == 0).mean()), float(c.mean())
    if mean == 0:
        return None
    pi, lam = 0.5 * zero, mean
    for _ in range(rounds):
        p0 = pi / max(pi + (1 - pi) * np.exp(-lam), 1e-300)
        pi, lam = zero * p0, mean / max(1 - zero * p0, 1e-12)
    return {"zero_share": zero, "pi": pi, "lambda": lam}


@operator("series", "hill_equation_dose_response_v1", "top double, ec50 double, hill double, r2 double", 20, rounds=200)
def dose_response(y, c, rounds):
    """Response of a bucket's mean to its count, a saturating curve over a floor, by damped Gauss-Newton steps."""
    d = c[c > 0][: len(y)]
    if len(np.unique(d)) < 4:
        return None
    f = lambda q: q[0] + q[1] * d ** q[3] / (abs(q[2]) ** q[3] + d ** q[3])
    q, damp = np.array([y.min(), max(np.ptp(y), 1e-9), float(np.median(d)), 1.0]), 1.0
    err = ((y - f(q)) ** 2).sum()
    for _ in range(rounds):
        j = np.stack([(f(q + h) - f(q - h)) / 2e-5 for h in 1e-5 * np.eye(4)], axis=1)
        step = np.linalg.solve(j.T @ j + damp * np.diag(np.maximum(np.diag(j.T @ j), 1e-9)), j.T @ (y - f(q)))
        new = q + step
        new[3] = np.clip(new[3], 0.1, 8)
        new[2] = max(abs(new[2]), 1e-6)
        e = ((y - f(new)) ** 2).sum()
        if np.isfinite(e) and e < err:
            done = err - e < 1e-12 * err
            q, err, damp = new, e, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return {"top": q[0] + q[1], "ec50": q[2], "hill": q[3], "r2": 1 - err / max(((y - y.mean()) ** 2).sum(), 1e-300)}


@operator("series", "discrete_event_queue_simulator_v1", "mean_wait double, p95_wait double, utilisation double, wait_after double", 20, service=0.8, lever=0.1, hours=2000, seed=28)
def simulate(y, c, service, lever, hours, seed):
    """One server, exponential arrivals at the series' rate and services at ``service`` of its capacity; again with services
    shorter by ``lever``. Waits follow Lindley's recursion."""
    lam, r = max(float(c.mean()), 1e-9), np.random.default_rng(seed)
    n = max(10, int(lam * hours))
    gaps, work = r.exponential(1 / lam, n), r.exponential(service / lam, n)

    def waits(s):
        w, out = 0.0, np.empty(n)
        for i in range(n):
            out[i] = w
            w = max(0.0, w + s[i] - gaps[i])
        return out

    w = waits(work)
    return {"mean_wait": w.mean(), "p95_wait": np.quantile(w, 0.95), "utilisation": work.sum() / max(gaps.sum(), work.sum()), "wait_after": waits(work * (1 - lever)).mean()}


@operator("series", "bin_packing_utilization_v1", "bins long, bound long, utilisation double", 10)
def first_fit(y, c):
    """Buckets' work into bins as large as its 95th percentile, largest first; larger work fills bins of its own."""
    size = np.sort(np.abs(y))[::-1]
    cap = float(np.quantile(size, 0.95)) or 1.0
    rest: list[float] = []
    for s in np.minimum(size, cap):
        k = next((i for i, v in enumerate(rest) if v >= s - 1e-12), None)
        if k is None:
            rest.append(cap - s)
        else:
            rest[k] -= s
    used = float(np.minimum(size, cap).sum())
    return {"bins": len(rest), "bound": int(np.ceil(used / cap - 1e-9)), "utilisation": used / (cap * len(rest))}


class P2:
    """Jain and Chlamtac's five markers of one quantile, without keeping values."""

    def __init__(self, p: float):
        self.p, self.q, self.n, self.want = p, [], [0, 1, 2, 3, 4], [0, 2 * p, 4 * p, 2 + 2 * p, 4]
        self.step = (0, p / 2, p, (1 + p) / 2, 1)

    def add(self, v: float) -> None:
        if len(self.q) < 5:
            self.q = sorted([*self.q, v])
            return
        q, n = self.q, self.n
        q[0], q[4] = min(q[0], v), max(q[4], v)
        k = sum(v >= m for m in q[1:4])
        for i in range(k + 1, 5):
            n[i] += 1
        self.want = [w + s for w, s in zip(self.want, self.step)]
        for i in (1, 2, 3):
            d = self.want[i] - n[i]
            if d >= 1 and n[i + 1] - n[i] > 1 or d <= -1 and n[i - 1] - n[i] < -1:
                s = 1 if d > 0 else -1
                up, down = (q[i + 1] - q[i]) / (n[i + 1] - n[i]), (q[i] - q[i - 1]) / (n[i] - n[i - 1])
                new = q[i] + s / (n[i + 1] - n[i - 1]) * ((n[i] - n[i - 1] + s) * up + (n[i + 1] - n[i] - s) * down)
                q[i] = new if q[i - 1] < new < q[i + 1] else q[i] + s * (up if s > 0 else down)
                n[i] += s

    def value(self) -> float | None:
        if len(self.q) < 5:
            return float(np.quantile(self.q, self.p)) if self.q else None
        return self.q[2]


@operator("series", "quantile_sketch_p2_streaming_v1", "p double, estimate double, exact double", 10)
def p2(y, c):
    out = []
    for p in (0.5, 0.9, 0.95, 0.99):
        s = P2(p)
        for v in y:
            s.add(float(v))
        out.append({"p": p, "estimate": s.value(), "exact": float(np.quantile(y, p))})
    return out


@operator("panel", "frequent_directions_cov_sketch_v1", "rows long, error double, bound double", 20, size=4)
def frequent_directions(x, c, keys, size):
    """Covariance sketch of ``size`` rows: largest error of xᵀx against its guarantee."""
    z = scaled(x)
    b = np.zeros((2 * size, z.shape[1]))
    used = 0
    for row in z:
        if used == 2 * size:
            _, s, v = np.linalg.svd(b, full_matrices=False)
            s = np.sqrt(np.maximum(s**2 - (s[size] ** 2 if len(s) > size else 0), 0))
            b = np.zeros_like(b)
            b[: len(s)] = s[:, None] * v
            used = int((s > 1e-12).sum())
        b[used] = row
        used += 1
    err = np.linalg.norm(z.T @ z - b.T @ b, 2)
    return {"rows": 2 * size, "error": err, "bound": (z * z).sum() / size}


@operator("panel", "fisher_exact_enrichment_v1", "key string, early long, late long, p_value double, significant boolean", 10)
def fisher(x, c, keys):
    """Right-tail Fisher test of each key's events in the second half of the time against all others'."""
    from math import exp, lgamma

    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    h = len(c) // 2
    early, late, out = c[:h].sum(0), c[h:].sum(0), []
    n, b = int(c.sum()), int(late.sum())
    for j, k in enumerate(keys):
        own, a = int(early[j] + late[j]), int(late[j])
        p = sum(exp(choose(own, i) + choose(n - own, b - i) - choose(n, b)) for i in range(a, min(own, b) + 1))
        out.append({"key": k, "early": int(early[j]), "late": a, "p_value": min(1.0, p), "significant": bool(p <= 0.05)})
    return out


@operator("series", "neural_ode_dynamics_v1", "reason string", 10**9)
@operator("series", "temporal_fusion_transformer_v1", "reason string", 10**9)
def absent(y, c):
    """These need a deep-learning library, as they do in the reference; without one the result is 'na'."""
    return None


