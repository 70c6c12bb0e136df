"""Matrix operators on the panel of time buckets by keys (see ``plans.bounded``): charts, outliers, dependence, topology,
clustering, embeddings. ``x`` holds the means of the cells, ``c`` their counts; kernels and distances are buckets squared."""

from __future__ import annotations

import numpy as np

from quarrystat.operators.series import distances, entropy, halves, pelt, robust, scale_of, slope
from quarrystat.plans.bounded import operator


def scaled(x: np.ndarray) -> np.ndarray:
    return np.stack([robust(v) for v in x.T], axis=1)


def pca(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes by falling variance, each with a positive largest entry, and the variances."""
    w, v = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    w, v = w[::-1], v[:, ::-1]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]), np.maximum(w, 0)


def mahalanobis(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d)


def _chart(t: np.ndarray, q: float) -> dict:
    limit = float(np.quantile(t, q))
    return {"largest": t.max(), "at": int(np.argmax(t)), "threshold": limit, "alarms": int((t > limit).sum())}


CHART = "largest double, at long, threshold double, alarms long"


@operator("panel", "multivariate_control_charts", "chart string, " + CHART, 50, q=0.995)
def mv_charts(x, c, keys, q):
    """T² of robust z rows, and the residual of all but the last component."""
    z = scaled(x)
    v, w = pca(z)
    k = max(1, len(w) - 1)
    res = ((z - z.mean(0)) - (z - z.mean(0)) @ v[:, :k] @ v[:, :k].T) ** 2
    return [{"chart": "t2"} | _chart(mahalanobis(z, z.mean(0), np.cov(z.T, bias=True)), q), {"chart": "spe"} | _chart(res.sum(1), q)]


@operator("panel", "multivariate_ewma_control", CHART, 50, lam=0.2, q=0.995)
def mewma(x, c, keys, lam, q):
    z, out = scaled(x) - scaled(x).mean(0), []
    s = np.zeros(z.shape[1])
    inv = np.linalg.pinv(np.cov(z.T, bias=True) * lam / (2 - lam))
    for r in z:
        s = lam * r + (1 - lam) * s
        out.append(s @ inv @ s)
    return _chart(np.array(out), q)


@operator("panel", "pca_control_chart", CHART, 50, components=2, q=0.995)
def pca_chart(x, c, keys, components, q):
    """Residuals from the components of the first 30 per cent."""
    z = scaled(x)
    base = z[: max(10, len(z) * 3 // 10)]
    v = pca(base)[0][:, :components]
    d = z - base.mean(0)
    return _chart(((d - d @ v @ v.T) ** 2).sum(1), q)


@operator("panel", "multivariate_changepoint_pelt", "at long, effect double, top_key string", 50, factor=3.0)
def mv_pelt(x, c, keys, factor):
    """Segmentation of the first component; the key whose mean moves most names the change."""
    z = scaled(x)
    y = robust(z @ pca(z)[0][:, 0])
    cuts = pelt(y, factor * np.log(len(y)))
    edges = [0, *cuts, len(y)]
    move = lambda v, a, k, b: v[k:b].mean(0) - v[a:k].mean(0)
    return [{"at": k, "effect": move(y, a, k, b), "top_key": keys[int(np.abs(move(z, a, k, b)).argmax())]} for a, k, b in zip(edges, cuts, edges[2:])]


def kernel(z: np.ndarray) -> tuple[np.ndarray, float]:
    d = distances(z, z)
    g = 1 / (2 * (np.median(d[np.triu_indices(len(d), 1)]) or 1.0) ** 2)
    return np.exp(-g * d * d), g


@operator("panel", "kernel_two_sample_mmd", "mmd2 double, gamma double, p_value double, sample_size long", 30, permutations=199, seed=2)
def mmd(x, c, keys, permutations, seed):
    """Maximum mean discrepancy of the halves, Gaussian kernel at the median distance, permutation p."""
    k, g = kernel(scaled(x))
    n, m = len(x), len(x) // 2

    def stat(i):
        a, b = i[:m], i[m:]
        kaa, kbb = k[np.ix_(a, a)], k[np.ix_(b, b)]
        return (kaa.sum() - m) / (m * (m - 1)) + (kbb.sum() - (n - m)) / ((n - m) * (n - m - 1)) - 2 * k[np.ix_(a, b)].mean()

    t, r = stat(np.arange(n)), np.random.default_rng(seed)
    more = sum(stat(r.permutation(n)) >= t - 1e-12 for _ in range(permutations))
    return {"mmd2": t, "gamma": g, "p_value": (more + 1) / (permutations + 1), "sample_size": n}


@operator("panel", "knn_graph_two_sample_test_v1", "cross_share double, expected double, p_value double", 30, k=5, permutations=199, seed=3)
def knn_test(x, c, keys, k, permutations, seed):
    d = distances(scaled(x), scaled(x))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    side = np.arange(len(x)) >= len(x) // 2
    cross = lambda s: float((s[near] != s[:, None]).mean())
    t, r = cross(side), np.random.default_rng(seed)
    draws = [cross(r.permutation(side)) for _ in range(permutations)]
    return {"cross_share": t, "expected": float(np.mean(draws)), "p_value": (sum(v <= t + 1e-12 for v in draws) + 1) / (permutations + 1)}


def ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, inverse, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[inverse]


def probit(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf(float(q)) for q in np.ravel(p)]).reshape(np.shape(p))


def gaussianised(x: np.ndarray) -> np.ndarray:
    return np.stack([probit(ranks(v) / (len(v) + 1)) for v in x.T], axis=1)


@operator("panel", "gaussian_copula_shift", "key_a string, key_b string, delta double, p_value double", 30, permutations=99, top=5, seed=6)
def copula_shift(x, c, keys, permutations, top, seed):
    """Largest changes between halves of correlations of normal scores, with permutation p."""
    g, h, r = gaussianised(x), len(x) // 2, np.random.default_rng(seed)
    delta = lambda z: np.corrcoef(z[h:].T) - np.corrcoef(z[:h].T)
    d = delta(g)
    draws = [np.abs(delta(g[r.permutation(len(g))])) for _ in range(permutations)]
    pairs = sorted(((i, j) for i in range(len(keys)) for j in range(i)), key=lambda p: -abs(d[p]))[:top]
    return [{"key_a": keys[j], "key_b": keys[i], "delta": d[i, j], "p_value": (sum(q[i, j] >= abs(d[i, j]) for q in draws) + 1) / (permutations + 1)} for i, j in pairs]


@operator("panel", "subspace_tracking_oja_v1", "max_angle_deg double", 40, components=2, rate=0.01)
def oja(x, c, keys, components, rate):
    """Largest principal angle between bases that Oja's rule learns on the halves."""

    def basis(z):
        w = np.eye(z.shape[1])[:, :components]
        for row in np.tile(z, (5, 1)):
            w, _ = np.linalg.qr(w + rate * np.outer(row, row @ w))
        return w

    z = scaled(x)
    s = np.linalg.svd(basis(halves(z)[0]).T @ basis(halves(z)[1]), compute_uv=False)
    return {"max_angle_deg": float(np.degrees(np.arccos(np.clip(s.min(), -1, 1))))}


@operator("panel", "dmd_koopman_modes_v1", "spectral_radius double, drift double, unstable long", 20)
def dmd(x, c, keys):
    z = scaled(x)
    lam = np.abs(np.linalg.eigvals(np.linalg.pinv(z[:-1]) @ z[1:]))
    return {"spectral_radius": lam.max(), "drift": np.maximum(lam - 1, 0).sum(), "unstable": int((lam > 1).sum())}


@operator("panel", "controllability_gramian_v1", "rank long, n_states long, n_dark_states long, spectral_radius double", 20)
def gramian(x, c, keys):
    """VAR(1) of the panel driven through its first key: rank of the controllability matrix."""
    z = scaled(x)
    a, p = np.linalg.lstsq(z[:-1], z[1:], rcond=None)[0].T, z.shape[1]
    b, blocks = np.eye(p)[:, :1], []
    for _ in range(p):
        blocks.append(b)
        b = a @ b
    rank = int(np.linalg.matrix_rank(np.hstack(blocks)))
    return {"rank": rank, "n_states": p, "n_dark_states": p - rank, "spectral_radius": np.abs(np.linalg.eigvals(a)).max()}


@operator("panel", "sindy_dynamics_discovery_v1", "key string, terms long, r2 double", 40, threshold=0.1, rounds=10)
def sindy(x, c, keys, threshold, rounds):
    """Sparse regression of the steps on a quadratic library, by sequentially thresholded least squares."""
    z = scaled(x)
    z = z / np.maximum(z.std(0), 1e-9)
    p = z.shape[1]
    lib = np.column_stack([np.ones(len(z)), z, *(z[:, i] * z[:, j] for i in range(p) for j in range(i, p))])[:-1]
    out = []
    for k, d in zip(keys, np.diff(z, axis=0).T):
        on, w = np.ones(lib.shape[1], dtype=bool), None
        for _ in range(rounds):
            w = np.zeros(lib.shape[1])
            w[on] = np.linalg.lstsq(lib[:, on], d, rcond=None)[0]
            keep = np.abs(w) >= threshold
            if (keep == on).all() or not keep.any():
                break
            on = keep
        w = np.where(on, w, 0)
        out.append({"key": k, "terms": int(on.sum()), "r2": 1 - ((d - lib @ w) ** 2).sum() / max(((d - d.mean()) ** 2).sum(), 1e-300)})
    return out


@operator("panel", "lee_carter_trend_decomp_v1", "explained_first double, trend_slope double", 20)
def lee_carter(x, c, keys):
    """First component of the centred log panel and the slope of its time index."""
    z = np.log(np.maximum(x, 1e-9))
    z = z - z.mean(0)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    k = u[:, 0] * s[0] * (np.sign(v[0].sum()) or 1.0)
    return {"explained_first": s[0] ** 2 / max((s**2).sum(), 1e-300), "trend_slope": slope(np.arange(len(k), dtype=float), k)}


def _pairs(x, keys, f):
    return [(keys[j], keys[i], f(x[:, j], x[:, i])) for i in range(len(keys)) for j in range(i)]


@operator("panel", "ekman_transport_indirect_v1", "key_a string, key_b string, direct double, best_lag long, lagged double, indirect boolean", 30, most=20, limit=0.3)
def ekman(x, c, keys, most, limit):
    """Pairs whose best lagged correlation exceeds the limit and the direct one."""
    corr = lambda a, b: float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0
    out = []
    for i, a in enumerate(keys):
        for j, b in enumerate(keys):
            if i != j:
                direct = corr(x[:, i], x[:, j])
                lag, r = max(((k, corr(x[:-k, i], x[k:, j])) for k in range(1, min(most, len(x) - 10) + 1)), key=lambda p: abs(p[1]))
                out.append({"key_a": a, "key_b": b, "direct": direct, "best_lag": lag, "lagged": r, "indirect": bool(abs(r) > limit and abs(r) > abs(direct))})
    return out


@operator("panel", "wigner_ville_coupling_v1", "key_a string, key_b string, mean_coherence double", 32, segments=4)
def wigner(x, c, keys, segments):
    """Coherence from cross-spectra averaged over segments."""

    def coherence(a, b):
        w = len(a) // segments
        f = [(np.fft.rfft(p - p.mean())[1:], np.fft.rfft(q - q.mean())[1:]) for p, q in ((a[i * w : (i + 1) * w], b[i * w : (i + 1) * w]) for i in range(segments))]
        cross = sum(p * np.conj(q) for p, q in f)
        power = sum(np.abs(p) ** 2 for p, _ in f) * sum(np.abs(q) ** 2 for _, q in f)
        return float(np.mean(np.abs(cross) ** 2 / np.maximum(power, 1e-300)))

    return [{"key_a": a, "key_b": b, "mean_coherence": v} for a, b, v in _pairs(x, keys, coherence)]


# Outliers


def forest(z: np.ndarray, trees: int, sample: int, seed: int) -> np.ndarray:
    """Isolation forest scores of all rows; every tree splits a sample of ``sample`` rows, as the method defines."""
    r, m = np.random.default_rng(seed), min(sample, len(z))
    norm = lambda n: np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))
    depth = np.zeros(len(z))
    for _ in range(trees):
        todo = [(r.choice(len(z), m, replace=False), np.arange(len(z)), 0)]
        while todo:
            own, rows, d = todo.pop()
            spread = np.ptp(z[own], axis=0) if len(own) else np.zeros(1)
            if len(own) <= 1 or d >= np.ceil(np.log2(m)) or not spread.any():
                depth[rows] += d + norm(np.array(len(own)))
                continue
            j = r.choice(np.flatnonzero(spread))
            cut = r.uniform(z[own, j].min(), z[own, j].max())
            todo += [(own[z[own, j] < cut], rows[z[rows, j] < cut], d + 1), (own[z[own, j] >= cut], rows[z[rows, j] >= cut], d + 1)]
    return 2 ** (-depth / trees / norm(np.array(m)))


def _top(score: np.ndarray, z: np.ndarray, keys: list[str], top: int) -> list[dict]:
    return [{"at": int(i), "score": score[i], "top_key": keys[int(np.abs(z[i]).argmax())]} for i in np.argsort(-score, kind="stable")[:top]]


TOP = "at long, score double, top_key string"


@operator("panel", "isolation_forest_anomaly", TOP, 30, trees=100, sample=256, top=10, seed=9)
def isolation(x, c, keys, trees, sample, top, seed):
    z = scaled(x)
    return _top(forest(z, trees, sample, seed), z, keys, top)


operator("panel", "isolation_forest", TOP, 30, trees=100, sample=256, top=10, seed=9)(isolation)


def lof(z: np.ndarray, k: int) -> np.ndarray:
    d = distances(z, z)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = np.take_along_axis(d, near, 1)
    reach = np.maximum(own, own[near, -1])
    density = 1 / np.maximum(reach.mean(1), 1e-12)
    return density[near].mean(1) / density


@operator("panel", "local_outlier_factor", TOP + ", outliers long", 20, k=20, limit=1.5, top=10)
def local_outliers(x, c, keys, k, limit, top):
    z = scaled(x)
    s = lof(z, min(k, len(z) - 1))
    return [r | {"outliers": int((s > limit).sum())} for r in _top(s, z, keys, top)]


@operator("panel", "one_class_svm", TOP + ", outliers long", 20, limit=3.5, top=10)
def one_class(x, c, keys, limit, top):
    """The documented fallback: rows whose largest robust z exceeds the limit."""
    z = scaled(x)
    s = np.abs(z).max(1)
    return [r | {"outliers": int((s > limit).sum())} for r in _top(s, z, keys, top)]


@operator("panel", "minimum_covariance_determinant_v1", "outliers long, threshold double, log_det double", 30, starts=20, seed=8)
def mcd(x, c, keys, starts, seed):
    """FastMCD: concentration steps from random subsets, the lowest determinant wins; outliers at the 95th percentile."""
    z, r = scaled(x), np.random.default_rng(seed)
    n, p = z.shape
    h, best = (n + p + 1) // 2, None
    for _ in range(starts):
        own = r.choice(n, p + 1, replace=False)
        for _ in range(30):
            cov = np.cov(z[own].T, bias=True) + 1e-9 * np.eye(p)
            new = np.sort(np.argsort(mahalanobis(z, z[own].mean(0), cov), kind="stable")[:h])
            if len(new) == len(own) and (new == own).all():
                break
            own = new
        det = np.linalg.slogdet(np.cov(z[own].T, bias=True) + 1e-9 * np.eye(p))[1]
        if best is None or det < best[0]:
            best = det, own
    d = mahalanobis(z, z[best[1]].mean(0), np.cov(z[best[1]].T, bias=True) + 1e-9 * np.eye(p))
    limit = float(np.quantile(d, 0.95))
    return {"outliers": int((d >= limit).sum()), "threshold": limit, "log_det": best[0]}


def pcp(z: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse parts by principal component pursuit (augmented Lagrangian)."""
    lam, mu = 1 / np.sqrt(max(z.shape)), z.size / (4 * max(np.abs(z).sum(), 1e-12))
    s, y = np.zeros_like(z), np.zeros_like(z)
    soft = lambda v, t: np.sign(v) * np.maximum(np.abs(v) - t, 0)
    for _ in range(rounds):
        u, w, v = np.linalg.svd(z - s + y / mu, full_matrices=False)
        low = (u * soft(w, 1 / mu)) @ v
        s = soft(z - low + y / mu, lam / mu)
        gap = z - low - s
        y = y + mu * gap
        if np.linalg.norm(gap) < 1e-7 * max(np.linalg.norm(z), 1e-12):
            break
    return low, s


@operator("panel", "robust_pca_sparse_outliers", TOP + ", rank long", 30, top=10)
def rpca(x, c, keys, top):
    z = scaled(x)
    low, s = pcp(z)
    rank = int(np.linalg.matrix_rank(low, tol=1e-6 * max(np.abs(low).max(), 1e-12)))
    return [r | {"rank": rank} for r in _top(np.linalg.norm(s, axis=1), s, keys, top)]


operator("panel", "robust_pca_pcp", TOP + ", rank long", 30, top=10)(rpca)


@operator("panel", "autoencoder_anomaly_v1", TOP + ", outliers long", 30, components=2, top=10)
def autoencoder(x, c, keys, components, top):
    """Linear autoencoder, that is reconstruction from the leading components; anomalies beyond mean + 2σ."""
    z = scaled(x)
    v = pca(z)[0][:, :components]
    e = (z - z.mean(0)) - (z - z.mean(0)) @ v @ v.T
    s = (e * e).mean(1)
    return [r | {"outliers": int((s > s.mean() + 2 * s.std()).sum())} for r in _top(s, e, keys, top)]


@operator("panel", "normalizing_flow_density_v1", "threshold double, lowest double, at long, outliers long", 30)
def flow(x, c, keys):
    """Gaussian log density of the rank-transformed rows; the lowest five per cent."""
    g = gaussianised(x)
    cov = np.cov(g.T, bias=True)
    logp = -0.5 * (mahalanobis(g, g.mean(0), cov) + np.linalg.slogdet(cov + 1e-9 * np.eye(len(cov)))[1] + len(cov) * np.log(2 * np.pi))
    t = float(np.quantile(logp, 0.05))
    return {"threshold": t, "lowest": logp.min(), "at": int(logp.argmin()), "outliers": int((logp <= t).sum())}


@operator("panel", "ksd_stein_discrepancy_anomaly_v1", "early double, late double, ratio double", 30)
def ksd(x, c, keys):
    """Kernel Stein discrepancy of either half from a normal fitted on the first."""
    z = scaled(x)
    a, b = halves(z)
    mean, inv = a.mean(0), np.linalg.pinv(np.cov(a.T, bias=True))

    def stat(v):
        s = -(v - mean) @ inv
        k, g = kernel(v)
        d = v[:, None, :] - v[None, :, :]
        sq = (d * d).sum(2)
        u = k * (s @ s.T + 2 * g * (np.einsum("id,ijd->ij", s, d) - np.einsum("jd,ijd->ij", s, d)) + 2 * g * v.shape[1] - 4 * g * g * sq)
        return float(u.mean())

    e, t = stat(a), stat(b)
    return {"early": e, "late": t, "ratio": t / e if e > 0 else None}


@operator("panel", "geometric_median_multivariate_location_v1", TOP, 20, top=10, rounds=500)
def geometric(x, c, keys, top, rounds):
    """Weiszfeld's point; the rows farthest from it."""
    z = scaled(x)
    m = np.median(z, axis=0)
    for _ in range(rounds):
        w = 1 / np.maximum(np.linalg.norm(z - m, axis=1), 1e-9)
        new = (w[:, None] * z).sum(0) / w.sum()
        if np.linalg.norm(new - m) < 1e-10:
            break
        m = new
    return _top(np.linalg.norm(z - m, axis=1), z - m, keys, top)


@operator("panel", "robust_regression_huber_ransac_v1", "slope_huber double, slope_ols double, slope_ransac double, outliers long", 30, trials=200, seed=12)
def huber(x, c, keys, trials, seed):
    """Second key on the first: Huber weights, and the largest consensus within 2.5 MADs."""
    if x.shape[1] < 2:
        return None
    a, b, r = x[:, 0], x[:, 1], np.random.default_rng(seed)
    w = np.ones(len(a))
    for _ in range(50):
        ma, mb = (w * a).sum() / w.sum(), (w * b).sum() / w.sum()
        k = (w * (a - ma) * (b - mb)).sum() / max((w * (a - ma) ** 2).sum(), 1e-300)
        e = b - mb - k * (a - ma)
        w = np.minimum(1, 1.345 * scale_of(e) / np.maximum(np.abs(e), 1e-12))
    tol, best = 2.5 * scale_of(b), None
    for _ in range(trials):
        i, j = r.choice(len(a), 2, replace=False)
        if a[i] != a[j]:
            t = (b[j] - b[i]) / (a[j] - a[i])
            near = np.abs(b - b[i] - t * (a - a[i])) <= tol
            if best is None or near.sum() > best.sum():
                best = near
    if best is None:
        return None
    return {"slope_huber": k, "slope_ols": slope(a, b), "slope_ransac": slope(a[best], b[best]), "outliers": int((~best).sum())}


@operator("panel", "conditional_density_estimation_v1", "key_a string, key_b string, js double", 20, bandwidth=0.5, grid=200)
def density(x, c, keys, bandwidth, grid):
    """Jensen-Shannon divergence in bits of the keys' kernel densities on one grid."""
    z = (x - x.mean()) / (x.std() or 1.0)
    g = np.linspace(z.min() - 1, z.max() + 1, grid)
    d = np.exp(-0.5 * ((g[:, None, None] - z[None]) / bandwidth) ** 2).sum(1)
    d = d / d.sum(0)

    def js(p, q):
        m = (p + q) / 2
        kl = lambda u: float((u[u > 0] * np.log2(u[u > 0] / m[u > 0])).sum())
        return (kl(p) + kl(q)) / 2

    return [{"key_a": keys[j], "key_b": keys[i], "js": js(d[:, j], d[:, i])} for i in range(len(keys)) for j in range(i)]


# Dependence


def centred(v: np.ndarray) -> np.ndarray:
    d = np.abs(v[:, None] - v[None, :])
    return d - d.mean(0) - d.mean(1)[:, None] + d.mean()


def dcov2(a: np.ndarray, b: np.ndarray) -> float:
    return float((centred(a) * centred(b)).mean())


def dcor(a: np.ndarray, b: np.ndarray) -> float:
    v = np.sqrt(dcov2(a, a) * dcov2(b, b))
    return float(np.sqrt(max(dcov2(a, b), 0) / v)) if v > 0 else 0.0


@operator("panel", "distance_correlation_screen_v1", "key_a string, key_b string, distance_correlation double", 20)
def dcor_screen(x, c, keys):
    return [{"key_a": a, "key_b": b, "distance_correlation": v} for a, b, v in _pairs(x, keys, dcor)]


@operator("panel", "distance_covariance_dependence_v1", "key_a string, key_b string, dcov double, dcor double, p_value double", 20, permutations=99, seed=13)
def dcov_test(x, c, keys, permutations, seed):
    r, out = np.random.default_rng(seed), []
    for i in range(len(keys)):
        for j in range(i):
            a, b = centred(x[:, j]), centred(x[:, i])
            t = float((a * b).mean())
            draws = [p for p in (r.permutation(len(x)) for _ in range(permutations))]
            more = sum(float((a * b[np.ix_(p, p)]).mean()) >= t - 1e-12 for p in draws)
            out.append({"key_a": keys[j], "key_b": keys[i], "dcov": np.sqrt(max(t, 0)), "dcor": dcor(x[:, j], x[:, i]), "p_value": (more + 1) / (permutations + 1)})
    return out


@operator("panel", "hsic_independence_screen_v1", "key_a string, key_b string, hsic double", 20)
def hsic(x, c, keys):
    def stat(a, b):
        ka, kb = (kernel(robust(v)[:, None])[0] for v in (a, b))
        centre = lambda k: k - k.mean(0) - k.mean(1)[:, None] + k.mean()
        return float((centre(ka) * centre(kb)).mean())

    return [{"key_a": a, "key_b": b, "hsic": v} for a, b, v in _pairs(x, keys, stat)]


@operator("panel", "lingam_causal_discovery_v1", "cause string, effect string, weight double", 40, limit=0.05)
def lingam(x, c, keys, limit):
    """Keys by falling excess kurtosis; each is regressed on those before it."""
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
    order = np.argsort(-np.abs((z**4).mean(0) - 3), kind="stable")
    out = []
    for k in range(1, len(order)):
        w = np.linalg.lstsq(z[:, order[:k]], z[:, order[k]], rcond=None)[0]
        out += [{"cause": keys[order[i]], "effect": keys[order[k]], "weight": w[i]} for i in range(k) if abs(w[i]) > limit]
    return out


@operator("panel", "causal_cross_validation_v1", "key_a string, key_b string, early double, late double, agrees boolean, ratio double", 30)
def cross_validation(x, c, keys):
    """Effect of each key on the next bucket of another, in either half: same sign, and the ratio of sizes."""
    out = []
    for i, a in enumerate(keys):
        for j, b in enumerate(keys):
            if i != j:
                e, t = (slope(h[:-1, i], h[1:, j]) for h in halves(x))
                out.append({"key_a": a, "key_b": b, "early": e, "late": t, "agrees": bool(e * t > 0), "ratio": min(abs(e), abs(t)) / max(abs(e), abs(t), 1e-12)})
    return out


@operator("panel", "synthetic_control_v1", "weight_key string, weight double, pre_rmse double, effect double", 30, rounds=3000)
def synthetic(x, c, keys, rounds):
    """First key by convex weights of the others on the first half (projected gradient); mean gap on the second."""
    if x.shape[1] < 2:
        return None
    (a, b), p = halves(x), x.shape[1] - 1
    d, y, w = a[:, 1:], a[:, 0], np.full(p, 1 / p)
    step = 1 / max(np.linalg.norm(d.T @ d, 2), 1e-12)
    for _ in range(rounds):
        v = w - step * d.T @ (d @ w - y)
        u = np.sort(v)[::-1]
        s = (np.cumsum(u) - 1) / np.arange(1, p + 1)
        w = np.maximum(v - s[np.flatnonzero(u > s)[-1]], 0)
    rmse, effect = np.sqrt(((d @ w - y) ** 2).mean()), (b[:, 0] - b[:, 1:] @ w).mean()
    return [{"weight_key": k, "weight": v, "pre_rmse": rmse, "effect": effect} for k, v in zip(keys[1:], w)]


@operator("panel", "maxwell_demon_monitoring_v1", "entropy_reduction double, monitoring_cost double, net_value double", 20, bins=8)
def demon(x, c, keys, bins):
    """Entropy of all cells against that of the cells sorted in halves, less the bits to name a key."""
    v = np.sort(x.ravel())
    h = lambda q: entropy(np.histogram(q, bins, (v[0], v[-1] + 1e-9))[0])
    gain = h(v) - np.mean([h(q) for q in halves(v)])
    return {"entropy_reduction": gain, "monitoring_cost": np.log2(max(len(keys), 1)), "net_value": gain - np.log2(max(len(keys), 1)) / len(x)}


# Topology


def mst(d: np.ndarray) -> np.ndarray:
    """Lengths of the edges of a minimum spanning tree, ascending: the deaths of components."""
    n = len(d)
    near, out, left = d[0].copy(), [], np.ones(n, dtype=bool)
    left[0] = False
    for _ in range(n - 1):
        i = int(np.argmin(np.where(left, near, np.inf)))
        out.append(near[i])
        left[i] = False
        near = np.minimum(near, d[i])
    return np.sort(out)


@operator("panel", "persistent_homology_regimes_v1", "lifetimes long, long_lived long, largest double, median double", 20)
def homology(x, c, keys):
    life = mst(distances(scaled(x), scaled(x)))
    return {"lifetimes": len(life), "long_lived": int((life > 2 * np.median(life)).sum()), "largest": life[-1], "median": np.median(life)}


operator("panel", "tda_persistent_homology", "lifetimes long, long_lived long, largest double, median double", 20)(homology)


def landscape(life: np.ndarray, grid: int) -> np.ndarray:
    """First landscape function of bars from 0 to each death: the highest tent."""
    t = np.linspace(0, life[-1], grid)
    return np.maximum(np.minimum(t[None, :], life[:, None] - t[None, :]), 0).max(0)


@operator("panel", "persistence_landscape_features_v1", "mean double, largest double, area double", 20, grid=100)
def landscapes(x, c, keys, grid):
    life = mst(distances(scaled(x), scaled(x)))
    f = landscape(life, grid)
    return {"mean": f.mean(), "largest": f.max(), "area": np.trapezoid(f, dx=life[-1] / (grid - 1))}


@operator("panel", "tda_persistence_landscapes", "mean double, largest double, area double", 20, grid=40)
def landscapes_40(x, c, keys, grid):
    return landscapes(x, c, keys, grid)


@operator("panel", "vietoris_rips_higher_order_v1", "quantile double, edges long, triangles long, ratio double", 20)
def rips(x, c, keys):
    """Edges and triangles of the keys' correlation metric at the quartiles of its distances."""
    d = np.sqrt(np.maximum(2 * (1 - np.corrcoef(x.T).reshape(len(keys), -1)), 0))
    upper = d[np.triu_indices(len(d), 1)]
    out = []
    for q in (0.25, 0.5, 0.75) if len(upper) else ():
        a = (d <= np.quantile(upper, q)) & ~np.eye(len(d), dtype=bool)
        e, t = int(a.sum()) // 2, int(np.trace(np.linalg.matrix_power(a.astype(int), 3))) // 6
        out.append({"quantile": q, "edges": e, "triangles": t, "ratio": t / max(e, 1)})
    return out


def euler(d: np.ndarray, eps: float) -> int:
    """Vertices less edges plus triangles of the Rips complex."""
    a = ((d <= eps) & ~np.eye(len(d), dtype=bool)).astype(np.float64)
    return round(len(d) - a.sum() / 2 + np.sum((a @ a) * a) / 6)


@operator("panel", "euler_characteristic_curve_v1", "eps double, chi long", 20, steps=30)
def euler_curve(x, c, keys, steps):
    d = distances(scaled(x), scaled(x))
    return [{"eps": e, "chi": euler(d, e)} for e in np.linspace(0, np.median(d), steps)]


@operator("panel", "graph_topology_curves", "eps double, components long", 20, steps=10)
def topology_curves(x, c, keys, steps):
    """Components of the rows linked within a distance, at rising distances."""
    life = mst(distances(scaled(x), scaled(x)))
    return [{"eps": e, "components": 1 + int((life > e).sum())} for e in np.linspace(0, life[-1], steps)]


def betti1(d: np.ndarray, k: int) -> int:
    """Cycle rank of the symmetric k-nearest-neighbour graph."""
    near = np.argsort(d + np.diag(np.full(len(d), np.inf)), axis=1, kind="stable")[:, :k]
    a = np.zeros(d.shape, dtype=bool)
    a[np.arange(len(d))[:, None], near] = True
    a |= a.T
    label = np.arange(len(d))
    while True:
        new = np.array([min(label[i], label[a[i]].min()) if a[i].any() else label[i] for i in range(len(d))])
        if (new == label).all():
            break
        label = new
    return int(a.sum()) // 2 - len(d) + len(np.unique(label))


@operator("panel", "tda_betti_curve_changepoint", "at long, betti1 long, z double", 60, window=48, k=8, limit=3.0)
def betti_curve(x, c, keys, window, k, limit):
    z = scaled(x)
    at = range(0, len(z) - window + 1, window // 2)
    b = np.array([betti1(distances(z[i : i + window], z[i : i + window]), k) for i in at])
    jump = robust(np.diff(b).astype(float)) if len(b) > 2 else np.zeros(0)
    return [{"at": at[i + 1], "betti1": int(b[i + 1]), "z": v} for i, v in enumerate(jump) if abs(v) > limit]


def kmeans(z: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Labels; centres start at farthest points, so the result is the same each time."""
    centres = [int(np.argmin(np.linalg.norm(z - z.mean(0), axis=1)))]
    while len(centres) < k:
        centres.append(int(np.argmax(distances(z, z[centres]).min(1))))
    m, label = z[centres], None
    for _ in range(rounds):
        new = distances(z, m).argmin(1)
        if label is not None and (new == label).all():
            break
        label = new
        m = np.stack([z[label == i].mean(0) if (label == i).any() else m[i] for i in range(k)])
    return label


def mapper(z: np.ndarray, lens: np.ndarray, intervals: int, overlap: float, clusters: int, least: int) -> tuple[int, int]:
    """Nodes and edges of the mapper graph: clusters within overlapping lens intervals, linked by shared rows."""
    w = np.ptp(lens) / intervals or 1.0
    nodes = []
    for i in range(intervals):
        lo, hi = lens.min() + (i - overlap) * w, lens.min() + (i + 1 + overlap) * w
        rows = np.flatnonzero((lens >= lo) & (lens <= hi))
        if len(rows) >= least:
            label = kmeans(z[rows], min(clusters, len(rows)))
            nodes += [set(rows[label == j].tolist()) for j in np.unique(label)]
    return len(nodes), sum(bool(nodes[i] & nodes[j]) for i in range(len(nodes)) for j in range(i))


@operator("panel", "mapper_subpopulations_v1", "nodes long, edges long", 30, intervals=8, overlap=0.3, clusters=2)
def mapper_first(x, c, keys, intervals, overlap, clusters):
    z = scaled(x)
    n, e = mapper(z, z[:, 0], intervals, overlap, clusters, 2)
    return {"nodes": n, "edges": e}


@operator("panel", "tda_mapper_graph", "nodes long, edges long", 30, intervals=8, overlap=0.3, clusters=3)
def mapper_pca(x, c, keys, intervals, overlap, clusters):
    z = scaled(x)
    n, e = mapper(z, z @ pca(z)[0][:, 0], intervals, overlap, clusters, 5)
    return {"nodes": n, "edges": e}


@operator("panel", "topographic_tanova_permutation", "key_a string, key_b string, dissimilarity double, p_value double", 30, permutations=199, seed=14)
def tanova(x, c, keys, permutations, seed):
    """One less the cosine of the keys' median profiles by hour position, against shuffled keys."""
    z, r = scaled(x).T, np.random.default_rng(seed)
    profile = lambda v: np.array([np.median(v[i::24]) for i in range(min(24, len(v)))])
    cosine = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12))
    out = []
    for i in range(len(keys)):
        for j in range(i):
            t, more = 1 - cosine(profile(z[j]), profile(z[i])), 0
            for _ in range(permutations):
                swap = r.random(z.shape[1]) < 0.5
                a, b = np.where(swap, z[i], z[j]), np.where(swap, z[j], z[i])
                more += 1 - cosine(profile(a), profile(b)) >= t - 1e-12
            out.append({"key_a": keys[j], "key_b": keys[i], "dissimilarity": t, "p_value": (more + 1) / (permutations + 1)})
    return out


@operator("panel", "monte_carlo_surface_uncertainty", "roughness double, low double, high double", 30, draws=200, noise=0.1, seed=15)
def surface(x, c, keys, draws, noise, seed):
    """Roughness of the surface of buckets by keys under added noise: its 90 per cent interval."""
    z, r = scaled(x), np.random.default_rng(seed)
    rough = lambda v: float(np.sqrt((np.diff(v, axis=0) ** 2).mean()))
    low, high = np.quantile([rough(z + r.normal(0, noise, z.shape)) for _ in range(draws)], [0.05, 0.95])
    return {"roughness": rough(z), "low": low, "high": high}


@operator("panel", "surface_hydrology_flow_watershed", "basins long, largest_share double", 20, k=8)
def watershed(x, c, keys, k):
    """Steepest descent among the k nearest rows by all keys but the last, whose value is the height."""
    if x.shape[1] < 2:
        return None
    z = scaled(x)
    d, h = distances(z[:, :-1], z[:, :-1]), z[:, -1]
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    steep = (h[:, None] - h[near]) / np.maximum(np.take_along_axis(d, near, 1), 1e-9)
    down = np.where(steep.max(1) > 0, np.take_along_axis(near, steep.argmax(1)[:, None], 1)[:, 0], np.arange(len(h)))
    while (down[down] != down).any():
        down = down[down]
    n = np.bincount(down)
    return {"basins": int((n > 0).sum()), "largest_share": n.max() / len(h)}


@operator("panel", "fitness_landscape_mapping_v1", "n_optima long, ruggedness double", 20, k=8)
def fitness(x, c, keys, k):
    """Rows lower than all their k nearest in the other keys."""
    if x.shape[1] < 2:
        return None
    z = scaled(x)
    d = distances(z[:, 1:], z[:, 1:])
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    n = int((z[:, 0] < z[near, 0].min(1)).sum())
    return {"n_optima": n, "ruggedness": n / len(z)}


@operator("panel", "kriging_missing_data_v1", "smoothness double, missing_frac double, mae double", 20)
def kriging(x, c, keys):
    """Inverse squared distance over time fills the empty cells; error when each full cell is left out."""
    t, err, size = np.arange(len(x)), [], []
    for j in range(x.shape[1]):
        full = np.flatnonzero(c[:, j] > 0)
        d = 1.0 / np.maximum((t[full][:, None] - t[full][None, :]) ** 2.0, 1e-9)
        np.fill_diagonal(d, 0)
        if len(full) > 1:
            err.append(np.abs(d @ x[full, j] / d.sum(1) - x[full, j]))
            size.append(np.abs(np.diff(x[full, j])).mean() / scale_of(x[full, j]))
    if not err:
        return None
    return {"smoothness": 1 / (1 + np.mean(size)), "missing_frac": float((c == 0).mean()), "mae": np.concatenate(err).mean()}


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Corners in order, by the monotone chain."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def chain(points):
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


@operator("panel", "convex_hull_operating_envelope_v1", "fill_ratio double, n_hull long, area double", 10)
def hull(x, c, keys):
    """Area of the hull of the first two keys against their bounding box."""
    if x.shape[1] < 2:
        return None
    h = convex_hull(x[:, :2])
    area = 0.5 * abs(np.dot(h[:, 0], np.roll(h[:, 1], 1)) - np.dot(h[:, 1], np.roll(h[:, 0], 1)))
    box = float(np.prod(np.ptp(x[:, :2], axis=0)))
    return {"fill_ratio": area / box if box else None, "n_hull": len(h), "area": area}


# Clusters and embeddings


def silhouette(z: np.ndarray, label: np.ndarray) -> float:
    d, own = distances(z, z), np.unique(label)
    if len(own) < 2:
        return 0.0
    mean = np.stack([d[:, label == g].sum(1) for g in own], axis=1)
    n = np.array([(label == g).sum() for g in own])
    i = np.searchsorted(own, label)
    a = mean[np.arange(len(z)), i] / np.maximum(n[i] - 1, 1)
    other = np.where(np.arange(len(own))[None, :] == i[:, None], np.inf, mean / n)
    b = other.min(1)
    return float(np.where(n[i] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def diffusion(z: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    k, _ = kernel(z)
    s = 1 / np.sqrt(k.sum(1))
    w, v = np.linalg.eigh(s[:, None] * k * s[None, :])
    w, v = w[::-1][: components + 1], v[:, ::-1][:, : components + 1] * s[:, None]
    return w, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


@operator("panel", "diffusion_maps_manifold_v1", "lambda_1 double, lambda_2 double, eigengap double", 30)
def diffusion_maps(x, c, keys):
    w, _ = diffusion(scaled(x), 3)
    return {"lambda_1": w[1], "lambda_2": w[2], "eigengap": w[1] - w[2]}


@operator("panel", "phate_trajectory_embedding_v1", "volatility double, stress double", 30, steps=5)
def phate(x, c, keys, steps):
    """Classical scaling of distances between log transition probabilities; mean step of the trajectory in time."""
    k, _ = kernel(scaled(x))
    p = np.linalg.matrix_power(k / k.sum(1, keepdims=True), steps)
    d = distances(-np.log(p + 1e-7), -np.log(p + 1e-7))
    n = len(d)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    y = v[:, ::-1][:, :2] * np.sqrt(np.maximum(w[::-1][:2], 0))
    e = distances(y, y)
    return {"volatility": np.linalg.norm(np.diff(y, axis=0), axis=1).mean() / max(np.linalg.norm(y, axis=1).mean(), 1e-12), "stress": np.sqrt(((d - e) ** 2).sum() / max((d * d).sum(), 1e-300))}


@operator("panel", "tsne_embedding_v1", "silhouette double, kl double", 30, perplexity=15.0, rounds=250, clusters=3, seed=16)
def tsne(x, c, keys, perplexity, rounds, clusters, seed):
    """Exact t-SNE from the two leading components; silhouette of k-means in the plane."""
    z = scaled(x)
    d, n = distances(z, z) ** 2, len(z)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, b, row = 0.0, np.inf, 1.0, np.delete(d[i], i)
        for _ in range(50):
            e = np.exp(-(row - row.min()) * b)
            q = e / e.sum()
            h = -(q * np.log(np.maximum(q, 1e-300))).sum() - np.log(perplexity)
            if abs(h) < 1e-5:
                break
            lo, hi = (b, hi) if h > 0 else (lo, b)
            b = b * 2 if np.isinf(hi) else (lo + hi) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = (z - z.mean(0)) @ pca(z)[0][:, :2] if z.shape[1] > 1 else np.column_stack([z, 0 * z])
    y = 1e-4 * y / max(y.std(), 1e-12)
    step = np.zeros_like(y)
    for t in range(rounds):
        w = 1 / (1 + distances(y, y) ** 2)
        np.fill_diagonal(w, 0)
        q = np.maximum(w / w.sum(), 1e-12)
        g = (p * (4 if t < 50 else 1) - q) * w
        grad = 4 * (g.sum(1)[:, None] * y - g @ y)
        step = (0.5 if t < 50 else 0.8) * step - 50 * grad
        y = y + step
    return {"silhouette": silhouette(y, kmeans(y, clusters)), "kl": float((p * np.log(p / q)).sum())}


@operator("panel", "umap_embedding_v1", "silhouette double, mode string", 30, clusters=3)
def umap(x, c, keys, clusters):
    """The documented fallback: two components, k-means, silhouette."""
    z = scaled(x)
    y = (z - z.mean(0)) @ pca(z)[0][:, :2]
    return {"silhouette": silhouette(y, kmeans(y, clusters)), "mode": "pca"}


@operator("panel", "seriation_ordering_v1", "jumps_before double, jumps_after double, improvement_pct double", 20)
def seriation(x, c, keys):
    """Rows in the order of the similarity graph's second eigenvector: how much shorter the path through them is."""
    z = scaled(x)
    _, v = diffusion(z, 1)
    path = lambda q: float(np.linalg.norm(np.diff(q, axis=0), axis=1).sum())
    a, b = path(z), path(z[np.argsort(v[:, 1], kind="stable")])
    return {"jumps_before": a, "jumps_after": b, "improvement_pct": 100 * (a - b) / max(a, 1e-12)}


@operator("panel", "similarity_graph_spectral_clustering_v1", "cluster long, keys string", 2, clusters=2)
def spectral(x, c, keys, clusters):
    """Keys by the cosine of their count profiles, spectral embedding, k-means."""
    v = c.T / np.maximum(np.linalg.norm(c.T, axis=1, keepdims=True), 1e-12)
    a = v @ v.T
    np.fill_diagonal(a, 0)
    s = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
    _, e = np.linalg.eigh(s[:, None] * a * s[None, :])
    u = e[:, ::-1][:, :clusters]
    label = kmeans(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12), min(clusters, len(keys)))
    groups = sorted(",".join(k for k, g in zip(keys, label) if g == i) for i in np.unique(label))
    return [{"cluster": i, "keys": g} for i, g in enumerate(groups)]


@operator("panel", "nonnegative_matrix_factorization_v1", "rank long, error_ratio double", 20, rank=2, rounds=300)
def nmf(x, c, keys, rank, rounds):
    """Multiplicative updates on the shifted panel, started at the absolute singular vectors."""
    z = x - x.min(0)
    rank = min(rank, z.shape[1])
    u, s, v = np.linalg.svd(z, full_matrices=False)
    w, h = np.abs(u[:, :rank]) * np.sqrt(s[:rank]) + 1e-6, np.abs(v[:rank]) * np.sqrt(s[:rank])[:, None] + 1e-6
    for _ in range(rounds):
        h *= (w.T @ z) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (z @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return {"rank": rank, "error_ratio": np.linalg.norm(z - w @ h) / max(np.linalg.norm(z), 1e-12)}


@operator("panel", "ica_source_separation_v1", "component long, kurtosis double", 30, rounds=300)
def ica(x, c, keys, rounds):
    """Symmetric FastICA with the cubic contrast on whitened rows."""
    z = scaled(x) - scaled(x).mean(0)
    v, w = pca(z)
    ok = w > 1e-9
    z = z @ v[:, ok] / np.sqrt(w[ok])
    b = np.eye(z.shape[1])
    for _ in range(rounds):
        new = (z.T @ (z @ b.T) ** 3).T / len(z) - 3 * b
        u, _, t = np.linalg.svd(new)
        new = u @ t
        done = np.max(np.abs(np.abs((new * b).sum(1)) - 1)) < 1e-9
        b = new
        if done:
            break
    k = np.sort(((z @ b.T) ** 4).mean(0) - 3)[::-1]
    return [{"component": i, "kurtosis": v} for i, v in enumerate(k)]


@operator("panel", "cur_decomposition_explain_v1", "key string, leverage double, error double", 20, rank=2)
def cur(x, c, keys, rank):
    """Leverage of each key in the leading singular vectors; error when the panel is rebuilt from the top keys."""
    z = scaled(x)
    lev = (np.linalg.svd(z, full_matrices=False)[2][:rank] ** 2).sum(0) / rank
    top = np.sort(np.argsort(-lev, kind="stable")[:rank])
    cols = z[:, top]
    err = np.linalg.norm(z - cols @ np.linalg.pinv(cols) @ z) / max(np.linalg.norm(z), 1e-12)
    return [{"key": k, "leverage": v, "error": err} for k, v in zip(keys, lev)]


@operator("panel", "tensor_cp_parafac_decomp_v1", "rank long, fit double", 48, rank=2, rounds=200, seed=17)
def parafac(x, c, keys, rank, rounds, seed):
    """Rank-R alternating least squares on the tensor of day, hour of day and key counts."""
    days = len(c) // 24
    t = c[: days * 24].reshape(days, 24, -1).astype(float)
    r = np.random.default_rng(seed)
    f = [r.random((s, rank)) for s in t.shape]
    for _ in range(rounds):
        for m in range(3):
            a, b = (f[i] for i in range(3) if i != m)
            kr = (a[:, None, :] * b[None, :, :]).reshape(-1, rank)
            f[m] = np.moveaxis(t, m, 0).reshape(t.shape[m], -1) @ kr @ np.linalg.pinv((a.T @ a) * (b.T @ b))
    e = t - np.einsum("ir,jr,kr->ijk", *f)
    return {"rank": rank, "fit": 1 - np.linalg.norm(e) / max(np.linalg.norm(t), 1e-12)}


@operator("panel", "functional_data_analysis_v1", "mean_norm double, variance double, outliers long, lowest_depth double", 10)
def functional(x, c, keys):
    """Rows as curves over the keys: modified band depth with pairs of curves; outliers below the lower quartile."""
    n = len(x)
    below = np.stack([np.searchsorted(np.sort(v), v, "left") for v in x.T], axis=1)
    above = np.stack([n - np.searchsorted(np.sort(v), v, "right") for v in x.T], axis=1)
    depth = ((n * (n - 1) / 2 - below * (below - 1) / 2 - above * (above - 1) / 2) / (n * (n - 1) / 2)).mean(1)
    return {"mean_norm": np.linalg.norm(x.mean(0)), "variance": x.var(0).mean(), "outliers": int((depth < np.quantile(depth, 0.25)).sum()), "lowest_depth": depth.min()}


@operator("panel", "hmm_workflow_state_v1", "best_n_states long, bic double", 40, most=4, rounds=40)
def hmm(x, c, keys, most, rounds):
    """Gaussian hidden Markov models of the rows by expectation maximisation; the lowest BIC names the number of states."""
    z = scaled(x)
    n, p, best = *z.shape, None
    for k in range(1, most + 1):
        label = kmeans(z, k)
        mu = np.stack([z[label == i].mean(0) for i in range(k)])
        var = np.stack([z[label == i].var(0) + 1e-2 for i in range(k)])
        a, pi = np.full((k, k), 0.2 / k) + 0.8 * np.eye(k), np.full(k, 1 / k)
        for _ in range(rounds):
            lb = -0.5 * (((z[:, None] - mu) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)
            shift = lb.max(1)
            b = np.exp(lb - shift[:, None])
            f, s = np.zeros((n, k)), np.zeros(n)
            f[0] = pi * b[0]
            for t in range(n):
                if t:
                    f[t] = (f[t - 1] @ a) * b[t]
                s[t] = max(f[t].sum(), 1e-300)
                f[t] /= s[t]
            g = np.ones((n, k))
            for t in range(n - 2, -1, -1):
                g[t] = a @ (b[t + 1] * g[t + 1]) / s[t + 1]
            like = float((np.log(s) + shift).sum())
            r = f * g
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            xi = sum(a * np.outer(f[t], b[t + 1] * g[t + 1]) / s[t + 1] for t in range(n - 1))
            a = (xi + 1e-6) / (xi + 1e-6).sum(1, keepdims=True)
            pi = r[0]
            w = r.sum(0)[:, None] + 1e-9
            mu = (r.T @ z) / w
            var = np.maximum(np.stack([(r[:, i : i + 1] * (z - mu[i]) ** 2).sum(0) for i in range(k)]) / w, 1e-2)
        bic = -2 * like + (k * k - 1 + 2 * k * p) * np.log(n)
        if best is None or bic < best[1] - 1e-9:
            best = k, bic
    return {"best_n_states": best[0], "bic": best[1]}
