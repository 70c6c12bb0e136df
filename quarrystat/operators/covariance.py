"""Operators on the exact moments of numeric columns over all rows (see ``plans.bounded``): any number of columns."""

from __future__ import annotations

import numpy as np

from quarrystat.plans.bounded import operator


def correlation(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    r = cov / np.outer(s, s)
    np.fill_diagonal(r, 1.0)
    return r


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values falling; vectors with a positive largest entry."""
    w, v = np.linalg.eigh(a)
    w, v = w[::-1], v[:, ::-1]
    return w, v * np.sign(v[np.abs(v).argmax(0), np.arange(len(a))])


@operator("moments", "cca_crossblock_association_v1", "top_corr double, second_corr double", 20)
def cca(n, mean, cov, columns):
    """Canonical correlations of the first and the second half of the columns."""
    h = len(columns) // 2
    if h < 1:
        return None
    root = lambda a: np.linalg.pinv(np.linalg.cholesky(a + 1e-10 * np.trace(a) * np.eye(len(a))))
    s = np.linalg.svd(root(cov[:h, :h]) @ cov[:h, h:] @ root(cov[h:, h:]).T, compute_uv=False)
    return {"top_corr": s[0], "second_corr": s[1] if len(s) > 1 else None}


def ols(cov: np.ndarray, y: int, x: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients and residual variance of column y on columns x."""
    if not x:
        return np.zeros(0), float(cov[y, y])
    b = np.linalg.lstsq(cov[np.ix_(x, x)], cov[x, y], rcond=None)[0]
    return b, max(float(cov[y, y] - b @ cov[x, y]), 1e-300)


@operator("moments", "ges_score_based_causal_v1", "source string, target string, gain double", 30)
def ges(n, mean, cov, columns):
    """Greedy additions, then removals, of edges while the Gaussian BIC of an acyclic graph grows."""
    p = len(columns)
    parents: list[list[int]] = [[] for _ in range(p)]
    score = lambda y, x: -0.5 * n * np.log(ols(cov, y, x)[1]) - 0.5 * np.log(n) * len(x)

    def leads(a, b):  # whether a path leads from a to b
        return a == b or any(leads(a, q) for q in parents[b])

    while True:
        moves = [(score(y, [*parents[y], x]) - score(y, parents[y]), x, y) for x in range(p) for y in range(p) if x != y and x not in parents[y] and not leads(y, x)]
        gain, x, y = max(moves, default=(0, 0, 0))
        if gain <= 1e-9:
            break
        parents[y].append(x)
    while True:
        moves = [(score(y, [q for q in parents[y] if q != x]) - score(y, parents[y]), x, y) for y in range(p) for x in parents[y]]
        gain, x, y = max(moves, default=(0, 0, 0))
        if gain <= 1e-9:
            break
        parents[y].remove(x)
    return [{"source": columns[x], "target": columns[y], "gain": score(y, parents[y]) - score(y, [q for q in parents[y] if q != x])} for y in range(p) for x in sorted(parents[y])]


def varimax(v: np.ndarray, rounds: int = 200) -> np.ndarray:
    r = np.eye(v.shape[1])
    for _ in range(rounds):
        w = v @ r
        u, _, t = np.linalg.svd(v.T @ (w**3 - w * (w * w).mean(0)))
        new = u @ t
        if np.abs(new - r).max() < 1e-12:
            break
        r = new
    return v @ r


@operator("moments", "factor_rotation_varimax_v1", "column string, factor_1 double, factor_2 double, sparsity double", 20)
def rotation(n, mean, cov, columns):
    """Varimax of the two leading loadings of the correlation matrix."""
    w, v = eigen(correlation(cov))
    k = min(2, len(columns))
    f = varimax(v[:, :k] * np.sqrt(np.maximum(w[:k], 0)))
    f = f[:, np.argsort(-(f * f).sum(0), kind="stable")]
    f = f * np.sign(f[np.abs(f).argmax(0), np.arange(k)])
    return [{"column": c, "factor_1": r[0], "factor_2": r[1] if k > 1 else None, "sparsity": float((np.abs(f) < 0.1).mean())} for c, r in zip(columns, f)]


@operator("moments", "sparse_pca_interpretable_components_v1", "component long, column string, loading double", 20, share=0.3)
def sparse_pca(n, mean, cov, columns, share):
    """Leading axes of the correlation matrix with loadings under a share of the largest set to zero."""
    _, v = eigen(correlation(cov))
    out = []
    for k in range(min(2, len(columns))):
        u = np.where(np.abs(v[:, k]) >= share * np.abs(v[:, k]).max(), v[:, k], 0)
        u = u / np.linalg.norm(u)
        out += [{"component": k, "column": c, "loading": x} for c, x in zip(columns, u) if x]
    return out


def glasso(s: np.ndarray, lam: float, rounds: int = 200) -> np.ndarray:
    """Precision matrix of the penalised likelihood by block coordinate descent."""
    p, w = len(s), s + lam * np.eye(len(s))
    beta = np.zeros((p, p))
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            o = np.arange(p) != j
            a, b, x = w[np.ix_(o, o)], s[o, j], beta[o, j]
            for _ in range(100):
                old = x.copy()
                for i in range(p - 1):
                    r = b[i] - a[i] @ x + a[i, i] * x[i]
                    x[i] = np.sign(r) * max(abs(r) - lam, 0) / a[i, i]
                if np.abs(x - old).max(initial=0) < 1e-10:
                    break
            beta[o, j] = x
            w[o, j] = w[j, o] = a @ x
        if np.abs(w - before).max() < 1e-8:
            break
    return np.linalg.inv(w)


@operator("moments", "graphical_lasso_dependency_network", "column_a string, column_b string, partial double", 20, lam=0.05, limit=0.05)
def glasso_edges(n, mean, cov, columns, lam, limit):
    k = glasso(correlation(cov), lam)
    d = np.sqrt(np.diag(k))
    part = -k / np.outer(d, d)
    return [{"column_a": columns[j], "column_b": columns[i], "partial": part[i, j]} for i in range(len(k)) for j in range(i) if abs(part[i, j]) >= limit]


@operator("moments", "gaussian_knockoffs", "column string, w double, selected boolean", 50, q=0.1, seed=19)
def knockoffs(n, mean, cov, columns, q, seed):
    """Equicorrelated knockoffs of the columns after the first, drawn in the space of moments; the statistic is the
    difference of squared partial covariances with the first column, the threshold keeps the false share under q."""
    r = correlation(cov)
    x, p = r[1:, 1:], len(columns) - 1
    if p < 1:
        return None
    s = min(1.0, 2 * max(float(np.linalg.eigvalsh(x).min()), 0)) * 0.999
    both = np.block([[x, x - s * np.eye(p)], [x - s * np.eye(p), x]]) + 1e-8 * np.eye(2 * p)
    # a knockoff's correlation with the target is what its original's leaves, plus sampling noise of n rows
    noise = np.random.default_rng(seed).normal(0, 1 / np.sqrt(n), p)
    to = np.concatenate([r[1:, 0], (x - s * np.eye(p)) @ np.linalg.pinv(x) @ r[1:, 0] + np.sqrt(max(s, 1e-9)) * noise])
    b = np.linalg.solve(both, to)
    w = np.abs(b[:p]) - np.abs(b[p:])
    limits = sorted(t for t in np.abs(w) if t > 0 and (1 + (w <= -t).sum()) / max((w >= t).sum(), 1) <= q)
    limit = limits[0] if limits else np.inf
    return [{"column": c, "w": v, "selected": bool(v >= limit)} for c, v in zip(columns[1:], w)]


@operator("moments", "shap_feature_attribution_v1", "column string, importance double, r2 double", 20)
def linear_shap(n, mean, cov, columns):
    """Attributions of the linear model of the first column: |coefficient| times the mean absolute deviation under normality."""
    x = list(range(1, len(columns)))
    b, v = ols(cov, 0, x)
    mad = np.sqrt(2 / np.pi) * np.sqrt(np.diag(cov)[x])
    return [{"column": columns[i], "importance": abs(b[k]) * mad[k], "r2": 1 - v / cov[0, 0]} for k, i in enumerate(x)]


@operator("moments", "shapley_interactions_v1", "column_a string, column_b string, interaction double", 20)
def shapley(n, mean, cov, columns):
    """Shapley interaction of pairs in explained variance of the first column: exact over all subsets of the others."""
    from itertools import combinations
    from math import factorial

    x, p = list(range(1, len(columns))), len(columns) - 1
    if p < 2 or p > 12:
        return None
    value = {s: 1 - ols(cov, 0, list(s))[1] / cov[0, 0] for k in range(p + 1) for s in combinations(x, k)}
    get = lambda *s: value[tuple(sorted(s))]
    out = []
    for i, j in combinations(x, 2):
        rest, total = [q for q in x if q not in (i, j)], 0.0
        for k in range(p - 1):
            c = factorial(k) * factorial(p - k - 2) / factorial(p - 1)
            total += sum(c * (get(*s, i, j) - get(*s, i) - get(*s, j) + get(*s)) for s in combinations(rest, k))
        out.append({"column_a": columns[i], "column_b": columns[j], "interaction": total})
    return out


@operator("moments", "regression_auto", "column string, coefficient double, standardised double, r2 double", 20, ridge=1e-3)
def regression(n, mean, cov, columns, ridge):
    """Ridge regression of the first column on the others, exact from moments; drivers by standardised coefficient."""
    x = list(range(1, len(columns)))
    s = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    r = correlation(cov)
    b = np.linalg.solve(r[np.ix_(x, x)] + ridge * np.eye(len(x)), r[x, 0])
    r2 = 2 * b @ r[x, 0] - b @ r[np.ix_(x, x)] @ b
    order = np.argsort(-np.abs(b), kind="stable")
    return [{"column": columns[x[k]], "coefficient": b[k] * s[0] / s[x[k]], "standardised": b[k], "r2": r2} for k in order]


@operator("moments", "mice_imputation_chained_equations_v1", "column string, r2 double, stability double", 20, rounds=20)
def chained(n, mean, cov, columns, rounds):
    """Each column regressed on all others: explained share, and how little the chained coefficients still move."""
    out = []
    for j, c in enumerate(columns):
        o = [i for i in range(len(columns)) if i != j]
        b, v = ols(cov, j, o)
        x = np.zeros(len(o))
        for _ in range(rounds):
            before = x.copy()
            for k, i in enumerate(o):
                x[k] += (cov[i, j] - cov[i, o] @ x) / max(cov[i, i], 1e-300)
        out.append({"column": c, "r2": 1 - v / max(cov[j, j], 1e-300), "stability": 1 / (1 + np.abs(x - before).sum())})
    return out
