"""Sequential, spectral and state-space operators on bucketed series (see ``plans.bounded``).

``y`` are the means of a key's time buckets in time order, ``c`` the counts of all its buckets, empty ones included.
"""

from __future__ import annotations

import zlib

import numpy as np

from quarrystat.plans.bounded import operator


def scale_of(x: np.ndarray) -> float:
    """1.4826 times the median absolute deviation; the standard deviation, then 1, where that is zero."""
    s = 1.4826 * np.median(np.abs(x - np.median(x)))
    return float(s or np.std(x) or 1.0)


def robust(x: np.ndarray) -> np.ndarray:
    return (x - np.median(x)) / scale_of(x)


def spikes(x: np.ndarray, limit: float) -> np.ndarray:
    return np.flatnonzero(np.abs(robust(x)) > limit)


def moving(x: np.ndarray, w: int) -> np.ndarray:
    """Means of all windows of w values."""
    s = np.concatenate(([0.0], np.cumsum(x)))
    return (s[w:] - s[:-w]) / w


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[: len(x) // 2], x[len(x) // 2 :]


def ewma(x: np.ndarray, lam: float, start: float) -> np.ndarray:
    out, z = np.empty(len(x)), start
    for i, v in enumerate(x):
        z = lam * v + (1 - lam) * z
        out[i] = z
    return out


def embed(x: np.ndarray, dim: int, delay: int) -> np.ndarray:
    n = len(x) - (dim - 1) * delay
    return np.stack([x[i * delay : i * delay + n] for i in range(dim)], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def slope(x: np.ndarray, y: np.ndarray) -> float:
    v = np.var(x)
    return float(np.cov(x, y, bias=True)[0, 1] / v) if v > 0 else 0.0


def spectrum(x: np.ndarray) -> np.ndarray:
    """Power of frequencies 1, 2, … cycles a series, the mean taken out."""
    return np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


# Control charts


@operator("series", "r2r_ewma_control_v1", "ooc long, ooc_pct double, limit_width double", 30, lam=0.2)
def r2r(y, c, lam):
    """Share of the EWMA outside mean ± 3σ·sqrt(λ/(2−λ))."""
    width = 3 * np.std(y) * np.sqrt(lam / (2 - lam))
    out = int((np.abs(ewma(y, lam, y.mean()) - y.mean()) > width).sum())
    return {"ooc": out, "ooc_pct": out / len(y), "limit_width": width}


@operator("series", "state_space_kalman_residuals", "max_residual_z double, at long, gain double", 20)
def kalman(y, c):
    """One-step residuals of a local-level filter whose level variance is a tenth of the noise's."""
    r = scale_of(y) ** 2
    level, p, res = y[0], r, []
    for v in y[1:]:
        p += 0.1 * r
        res.append((v - level) / np.sqrt(p + r))
        g = p / (p + r)
        level, p = level + g * (v - level), (1 - g) * p
    z = robust(np.array(res))
    i = int(np.argmax(np.abs(z)))
    return {"max_residual_z": abs(z[i]), "at": i + 1, "gain": g}


@operator("series", "state_space_smoother_level_shift_v1", "max_level_shift double, at long, shifted long", 20, lam=0.3)
def smoother(y, c, lam):
    """Largest step of the level smoothed forwards and backwards, against 2.5 MADs of its steps."""
    level = (ewma(y, lam, y[0]) + ewma(y[::-1], lam, y[-1])[::-1]) / 2
    d = np.abs(np.diff(level))
    i = int(np.argmax(d))
    return {"max_level_shift": d[i], "at": i + 1, "shifted": int((d > 2.5 * scale_of(np.diff(level))).sum())}


# Changepoints


def best_split(y: np.ndarray, edge: int) -> tuple[int, float]:
    """Split with the largest fall of the squared error, and that fall."""
    n = len(y)
    if n < 2 * edge:
        return 0, 0.0
    s, k = np.cumsum(y)[:-1], np.arange(1, n)
    gain = s * s / k + (y.sum() - s) ** 2 / (n - k) - y.sum() ** 2 / n
    gain[: edge - 1] = gain[n - edge :] = -1
    i = int(np.argmax(gain))
    return i + 1, float(gain[i])


def pelt(y: np.ndarray, penalty: float, edge: int = 5) -> list[int]:
    """Exact optimal segmentation by mean with pruning: ends of segments but the last.

    A start is dropped once its cost without a further penalty can't win, ``edge`` steps after that was found."""
    s, q = np.concatenate(([0.0], np.cumsum(y))), np.concatenate(([0.0], np.cumsum(y * y)))
    n = len(y)
    best, back, starts = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.array([0])
    best[0] = -penalty
    doomed: list[tuple[int, int]] = []
    for t in range(edge, n + 1):
        ok = starts[(t - starts >= edge) & np.isfinite(best[starts])]
        cost = best[ok] + q[t] - q[ok] - (s[t] - s[ok]) ** 2 / (t - ok)
        i = int(np.argmin(cost))
        best[t], back[t] = cost[i] + penalty, ok[i]
        doomed += [(t, int(x)) for x in ok[cost > best[t]]]
        gone = {x for at, x in doomed if t - at >= edge}
        starts = np.append(starts[~np.isin(starts, list(gone))], t)
    out, t = [], n
    while back[t] > 0:
        t = int(back[t])
        out.append(t)
    return out[::-1]


def energy(a: np.ndarray, b: np.ndarray) -> float:
    """Energy distance of two samples on a line."""
    pooled = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), pooled, "right") / len(a)
    fb = np.searchsorted(np.sort(b), pooled, "right") / len(b)
    return float(2 * (((fa - fb)[:-1] ** 2) * np.diff(pooled)).sum())


@operator("series", "changepoint_pelt", "at long, effect double", 50, factor=3.0)
def changepoint_pelt(y, c, factor):
    """Every mean shift of the best penalised segmentation."""
    z = robust(y)
    cuts = pelt(z, factor * np.log(len(z)))
    edges = [0, *cuts, len(z)]
    return [{"at": k, "effect": z[k:b].mean() - z[a:k].mean()} for a, k, b in zip(edges, cuts, edges[2:])]


@operator("series", "changepoint_energy_edivisive", "at long, energy double, confidence double", 40, permutations=99, seed=11)
def edivisive(y, c, permutations, seed):
    """Split with the largest energy statistic, and the share of permutations below it."""
    n = len(y)
    cuts = np.unique(np.linspace(n // 10, n - n // 10, 40).astype(int))

    def top(x):
        stats = [k * (n - k) / n * energy(x[:k], x[k:]) for k in cuts]
        i = int(np.argmax(stats))
        return int(cuts[i]), stats[i]

    at, e = top(y)
    r = np.random.default_rng(seed)
    below = sum(top(r.permutation(y))[1] < e for _ in range(permutations))
    return {"at": at, "energy": e, "confidence": below / permutations}


def bocpd(y: np.ndarray, hazard: float) -> np.ndarray:
    """Probability at each step that a new run began there: normal data with normal-inverse-gamma prior."""
    from math import lgamma

    mu, kappa, alpha, beta = np.zeros(1), np.ones(1), np.ones(1), np.ones(1)
    logr, out = np.zeros(1), np.zeros(len(y))
    gammas = np.array([lgamma(a + 0.5) - lgamma(a) for a in 1 + np.arange(len(y) + 1) / 2])
    for i, v in enumerate(y):
        scale = beta * (kappa + 1) / (alpha * kappa)
        k = np.round((alpha - 1) * 2).astype(int)
        pred = gammas[k] - 0.5 * np.log(2 * np.pi * alpha * scale) - (alpha + 0.5) * np.log1p((v - mu) ** 2 / (2 * alpha * scale))
        grow, new = logr + pred + np.log(1 - 1 / hazard), np.logaddexp.reduce(logr + pred) - np.log(hazard)
        logr = np.concatenate(([new], grow))
        logr -= np.logaddexp.reduce(logr)
        # the run length falls to a few steps after a change: mass on runs younger than five steps
        out[i] = np.exp(np.logaddexp.reduce(logr[1:6])) if i >= 10 else 0.0
        mu, kappa, alpha, beta = (
            np.concatenate(([0.0], (kappa * mu + v) / (kappa + 1))),
            np.concatenate(([1.0], kappa + 1)),
            np.concatenate(([1.0], alpha + 0.5)),
            np.concatenate(([1.0], beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1)))),
        )
    return out


def _peaks(prob: np.ndarray, limit: float) -> list[dict]:
    over = prob > limit
    starts = np.flatnonzero(over & ~np.concatenate(([False], over[:-1])))
    return [{"at": int(i), "probability": prob[i]} for i in starts]


@operator("series", "bocpd_gaussian", "at long, probability double", 30, hazard=200.0, limit=0.3)
def bocpd_gaussian(y, c, hazard, limit):
    return _peaks(bocpd(robust(y), hazard), limit)


@operator("series", "event_count_bocpd_poisson", "at long, probability double", 30, hazard=200.0, limit=0.3)
def bocpd_counts(y, c, hazard, limit):
    """The same detector on counts of all buckets, variance-stabilised by the square root."""
    return _peaks(bocpd(robust(2 * np.sqrt(c + 0.375)), hazard), limit)


def adwin(x: np.ndarray, delta: float) -> list[tuple[int, float, float]]:
    """Adaptive window: cuts (place, left mean, right mean) where two parts differ by more than the bound."""
    start, cuts = 0, []
    s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    for t in range(10, len(x) + 1):
        while t - start >= 10:
            k = np.arange(start + 5, t - 4)
            n0, n1 = k - start, t - k
            a, b = (s[k] - s[start]) / n0, (s[t] - s[k]) / n1
            var = max((q[t] - q[start]) / (t - start) - ((s[t] - s[start]) / (t - start)) ** 2, 0)
            m, d = 1 / (1 / n0 + 1 / n1), np.log(2 * np.log(max(t - start, 2)) / delta)
            over = np.abs(a - b) - (np.sqrt(2 / m * var * d) + 2 / (3 * m) * d)
            i = int(np.argmax(over))
            if over[i] <= 0:
                break
            cuts.append((int(k[i]), float(a[i]), float(b[i])))
            start = int(k[i])
    return cuts


@operator("series", "drift_adwin", "at long, mean_left double, mean_right double, diff double", 100, delta=0.002)
def drift_adwin(y, c, delta):
    z = (y - y.min()) / ((y.max() - y.min()) or 1.0)
    return [{"at": i, "mean_left": a, "mean_right": b, "diff": b - a} for i, a, b in adwin(z, delta)]


@operator("series", "concept_drift_ddm_v1", "at long, rate double, level string", 30)
def ddm(y, c):
    """Drift detection on the indicator value > median: warning at 2, drift at 3 deviations above the lowest rate."""
    e, out, n, p, low, low_s = y > np.median(y), [], 0, 0.0, np.inf, np.inf
    warned = False
    for i, v in enumerate(e):
        n += 1
        p += (v - p) / n
        s = np.sqrt(p * (1 - p) / n)
        if n < 30:
            continue
        if p + s < low + low_s:
            low, low_s = p, s
        if p + s > low + 3 * low_s:
            out.append({"at": i, "rate": p, "level": "drift"})
            n, p, low, low_s, warned = 0, 0.0, np.inf, np.inf, False
        elif p + s > low + 2 * low_s and not warned:
            out.append({"at": i, "rate": p, "level": "warning"})
            warned = True
    return out


def wbs(y: np.ndarray, intervals: int, seed: int, limit: float) -> list[int]:
    """Wild binary segmentation: the best CUSUM over random intervals, again on both sides while it exceeds the limit."""
    r, n = np.random.default_rng(seed), len(y)
    ends = np.sort(r.integers(0, n + 1, (intervals, 2)), axis=1)
    out: list[int] = []
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        inside = [(a, b) for a, b in ends.tolist() if lo <= a and b <= hi and b - a >= 10] + ([(lo, hi)] if hi - lo >= 10 else [])
        best = max(((g, a + k) for a, b in inside for k, g in [best_split(y[a:b], 3)]), default=(0.0, 0))
        if best[0] > limit:
            out.append(best[1])
            todo += [(lo, best[1]), (best[1], hi)]
    return sorted(out)


@operator("series", "wild_binary_segmentation_v1", "at long, effect double", 40, intervals=200, seed=5, factor=3.0)
def wild(y, c, intervals, seed, factor):
    z = robust(y)
    cuts = wbs(z, intervals, seed, factor * 2 * np.log(len(z)))
    edges = [0, *cuts, len(z)]
    return [{"at": k, "effect": z[k:b].mean() - z[a:k].mean()} for a, k, b in zip(edges, cuts, edges[2:])]


@operator("series", "changepoint_method_survey_guided", "at long, methods string", 100, tolerance=5)
def survey(y, c, tolerance):
    """Changes of PELT, the energy split and ADWIN; those within the tolerance of each other are one."""
    z = robust(y)
    e = edivisive(y, c, 99, 11)
    found = [(k, "pelt") for k in pelt(z, 3 * np.log(len(z)))] + ([(e["at"], "energy")] if e["confidence"] >= 0.95 else [])
    found += [(r["at"], "adwin") for r in drift_adwin(y, c, 0.002)]
    out: list[tuple[int, set]] = []
    for at, m in sorted(found):
        if out and at - out[-1][0] <= tolerance:
            out[-1][1].add(m)
        else:
            out.append((at, {m}))
    return [{"at": a, "methods": ",".join(sorted(m))} for a, m in out]


@operator("series", "change_score_consensus_v1", "at long, votes long, score double", 40, window=8, tolerance=4)
def consensus(y, c, window, tolerance):
    """Places on which window shifts, the slope of the rolling mean, and wild segmentation agree, two of three at least."""
    z = robust(y)
    m = moving(z, window)
    shift = np.abs(m[window:] - m[:-window])
    steep = np.abs(np.gradient(m))
    votes = {}
    for name, s, at in (("shift", shift, window), ("slope", steep, window // 2)):
        for i in np.flatnonzero(s > s.mean() + 2 * s.std()):
            votes.setdefault(name, []).append(int(i) + at)
    votes["wild"] = wbs(z, 200, 5, 6 * np.log(len(z)))
    every = sorted({i for v in votes.values() for i in v})
    out, last = [], None
    for i in every:
        n = sum(any(abs(i - j) <= tolerance for j in v) for v in votes.values())
        if n >= 2 and (last is None or i - last > 2 * tolerance):
            out.append({"at": i, "votes": n, "score": n / 3})
            last = i
    return out


@operator("series", "piecewise_linear_trend_changepoints_v1", "segments long, at string, sse double, bic double", 30, most=4)
def piecewise(y, c, most):
    """Best number of connected-free linear segments by BIC; exact cuts by dynamic programming."""
    n, edge = len(y), 5
    x = np.arange(n, dtype=float)
    sums = [np.concatenate(([0.0], np.cumsum(v))) for v in (x, x * x, y, x * y, y * y)]

    def cost(a, b):
        k = b - a
        sx, sxx, sy, sxy, syy = (s[b] - s[a] for s in sums)
        v = sxx - sx * sx / k
        return np.maximum(syy - sy * sy / k - (sxy - sx * sy / k) ** 2 / v, 0)

    best = np.full((most + 1, n + 1), np.inf)
    back = np.zeros((most + 1, n + 1), dtype=int)
    best[0, 0] = 0
    for m in range(1, most + 1):
        for b in range(edge, n + 1):
            a = np.arange(0, b - edge + 1)
            v = best[m - 1, a] + cost(a, b)
            i = int(np.argmin(v))
            best[m, b], back[m, b] = v[i], a[i]
    bic = [n * np.log(max(best[m, n], 1e-12) / n) + 3 * m * np.log(n) for m in range(1, most + 1)]
    m = int(np.argmin(bic)) + 1
    cuts, b = [], n
    for k in range(m, 1, -1):
        b = int(back[k, b])
        cuts.append(b)
    return {"segments": m, "at": ",".join(map(str, cuts[::-1])), "sse": best[m, n], "bic": bic[m - 1]}


@operator("series", "bsts_intervention_counterfactual_v1", "t0 long, delta double, effect double, pre_mean double", 30, window=8, lam=0.2)
def intervention(y, c, window, lam):
    """The steepest place of the rolling mean splits; what follows is compared with the EWMA level before it."""
    m = moving(y, window)
    t0 = int(np.argmax(np.abs(np.gradient(m)))) + window // 2
    t0 = min(max(t0, 5), len(y) - 5)
    level = ewma(y[:t0], lam, y[0])[-1]
    delta = y[t0:].mean() - level
    return {"t0": t0, "delta": delta, "effect": delta / scale_of(y[:t0]), "pre_mean": y[:t0].mean()}


# Two halves


@operator("series", "randomization_test_median_shift_v1", "delta double, p_value double", 20, permutations=999, seed=3)
def median_shift(y, c, permutations, seed):
    """Permutation p of the difference of the halves' medians."""
    a, b = halves(y)
    d, r = np.median(b) - np.median(a), np.random.default_rng(seed)
    more = 0
    for _ in range(permutations):
        z = r.permutation(y)
        more += abs(np.median(z[len(a) :]) - np.median(z[: len(a)])) >= abs(d) - 1e-12
    return {"delta": d, "p_value": (more + 1) / (permutations + 1)}


@operator("series", "bootstrap_ci_effect_sizes_v1", "effect double, low double, high double", 20, draws=500, seed=4)
def bootstrap(y, c, draws, seed):
    """Difference of the halves' means in pooled deviations, with its 95 per cent bootstrap interval."""
    a, b = halves(y)

    def effect(p, q):
        s = np.sqrt(((p.var() * len(p)) + (q.var() * len(q))) / (len(p) + len(q)))
        return (q.mean() - p.mean()) / s if s > 0 else 0.0

    r = np.random.default_rng(seed)
    got = [effect(r.choice(a, len(a)), r.choice(b, len(b))) for _ in range(draws)]
    low, high = np.quantile(got, [0.025, 0.975])
    return {"effect": effect(a, b), "low": low, "high": high}


@operator("series", "sinkhorn_ot_drift_v1", "cost double, iterations long", 20, bins=24, epsilon=0.05, rounds=2000)
def sinkhorn(y, c, bins, epsilon, rounds):
    """Entropic transport cost between the halves' histograms, on values scaled to 0…1."""
    edges = np.linspace(y.min(), y.max() + 1e-9, bins + 1)
    a, b = (np.histogram(h, edges)[0] + 1e-9 for h in halves(y))
    a, b = a / a.sum(), b / b.sum()
    mid = (np.arange(bins) + 0.5) / bins
    d = np.abs(mid[:, None] - mid[None, :])
    k, v = np.exp(-d / epsilon), np.ones(bins)
    for i in range(rounds):
        u = a / (k @ v)
        new = b / (k.T @ u)
        done = np.max(np.abs(new - v) / np.maximum(v, 1e-12)) < 1e-9
        v = new
        if done:
            break
    return {"cost": float((u[:, None] * k * v[None, :] * d).sum()), "iterations": i + 1}


@operator("series", "sliced_wasserstein_drift_v1", "distance double, scaled double", 20, quantiles=99)
def wasserstein(y, c, quantiles):
    """In one dimension every slice is the sample itself: mean difference of the halves' quantiles."""
    q = np.arange(1, quantiles + 1) / (quantiles + 1)
    d = float(np.mean(np.abs(np.quantile(halves(y)[0], q) - np.quantile(halves(y)[1], q))))
    return {"distance": d, "scaled": d / scale_of(y)}


def sampen(x: np.ndarray, m: int = 2, r: float = 0.2) -> float | None:
    """Sample entropy: −ln of the share of matches of m values that still match at m + 1."""
    tol, n = r * (np.std(x) or 1.0), len(x) - m
    if n < 5:
        return None
    near = lambda w: (np.max(np.abs(w[:, None, :] - w[None, :, :]), axis=2) <= tol).sum() - len(w)
    long, short = embed(x, m + 1, 1), embed(x, m, 1)[:n]
    a, b = near(long), near(short)
    return float(-np.log(a / b)) if a and b else None


def _delta(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else b - a


@operator("series", "sample_entropy_irregularity_v1", "sampen_pre double, sampen_post double, delta double", 40)
def sample_entropy(y, c):
    a, b = map(sampen, halves(y))
    return {"sampen_pre": a, "sampen_post": b, "delta": _delta(a, b)}


@operator("series", "multiscale_entropy_mse_v1", "scales long, mse_pre double, mse_post double, delta double", 80, most=4)
def multiscale(y, c, most):
    def mean(x):
        got = [v for s in range(1, most + 1) if (v := sampen(x[: len(x) // s * s].reshape(-1, s).mean(1))) is not None]
        return float(np.mean(got)) if got else None

    a, b = map(mean, halves(y))
    return {"scales": most, "mse_pre": a, "mse_post": b, "delta": _delta(a, b)}


# Forecasts


@operator("series", "seasonal_holt_winters_forecast_residuals_v1", "spikes long, rmse double, max_z double", 72, period=24, a=0.3, b=0.05, g=0.2)
def holt_winters(y, c, period, a, b, g):
    """One-step errors of additive Holt-Winters; spikes are errors beyond four robust deviations."""
    level, trend = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
    season, errors = list(y[:period] - level), []
    for t in range(period, len(y)):
        s = season[t - period]
        errors.append(y[t] - level - trend - s)
        new = a * (y[t] - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        level = new
        season.append(g * (y[t] - level) + (1 - g) * s)
    e = np.array(errors)
    return {"spikes": len(spikes(e, 4.0)), "rmse": np.sqrt((e * e).mean()), "max_z": np.abs(robust(e)).max()}


@operator("series", "reservoir_computing_esn_v1", "rmse double, mae double, naive_rmse double", 60, units=60, radius=0.9, ridge=1e-4, seed=7)
def reservoir(y, c, units, radius, ridge, seed):
    """Echo state network with a ridge readout, one step ahead on the last quarter."""
    r, z = np.random.default_rng(seed), robust(y)
    w = r.normal(size=(units, units)) * (r.random((units, units)) < 0.1)
    w *= radius / max(np.abs(np.linalg.eigvals(w)).max(), 1e-9)
    win, state, states = r.uniform(-0.5, 0.5, (units, 2)), np.zeros(units), []
    for v in z[:-1]:
        state = np.tanh(w @ state + win @ np.array([1.0, v]))
        states.append(np.concatenate(([1.0, v], state)))
    x, t, cut = np.array(states), z[1:], len(z) * 3 // 4
    beta = np.linalg.solve(x[:cut].T @ x[:cut] + ridge * np.eye(x.shape[1]), x[:cut].T @ t[:cut])
    e = t[cut:] - x[cut:] @ beta
    naive = t[cut:] - z[cut:-1]
    return {"rmse": np.sqrt((e * e).mean()), "mae": np.abs(e).mean(), "naive_rmse": np.sqrt((naive * naive).mean())}


@operator("series", "banister_fitness_fatigue_v1", "fatigue_dominant_pct double, last_form double", 20, fitness=42.0, fatigue=7.0)
def banister(y, c, fitness, fatigue):
    """Two exponential memories of the load; share of time in which the short one is larger."""
    p, q, over = 0.0, 0.0, 0
    for v in y:
        p, q = p * np.exp(-1 / fitness) + v / fitness, q * np.exp(-1 / fatigue) + v / fatigue
        over += q > p
    return {"fatigue_dominant_pct": over / len(y), "last_form": p - q}


@operator("series", "pulsar_timing_residual_v1", "jitter_ratio double, periodic_lag long, acf double", 30)
def pulsar(y, c):
    """Residuals of a cubic trend; their strongest autocorrelation."""
    x = np.linspace(-1, 1, len(y))
    e = y - np.polyval(np.polyfit(x, y, 3), x)
    v = (e * e).sum() or 1.0
    lags = range(2, len(y) // 3)
    acf = [(e[k:] * e[:-k]).sum() / v for k in lags]
    i = int(np.argmax(acf))
    return {"jitter_ratio": e.std() / (abs(y.mean()) or 1.0), "periodic_lag": lags[i], "acf": acf[i]}


# Spectra


@operator("series", "cepstral_decomposition_v1", "peaks long, envelope_ratio double", 32)
def cepstrum(y, c):
    """Peaks of the real cepstrum beyond mean + 2σ, and the share of its low quarter."""
    log = np.log(np.abs(np.fft.fft(y - y.mean())) + 1e-12)
    q = np.abs(np.real(np.fft.ifft(log)))[1 : len(y) // 2]
    return {"peaks": int((q > q.mean() + 2 * q.std()).sum()), "envelope_ratio": q[: len(q) // 4].sum() / q.sum()}


@operator("series", "synchrosqueezing_drift_v1", "freq_first double, freq_last double, freq_shift double", 64, windows=8)
def synchrosqueeze(y, c, windows):
    """Drift of the power-weighted mean frequency over windows."""
    w = len(y) // windows
    f = np.arange(1, w // 2 + 1) / w
    mean = [float((f * p).sum() / p.sum()) if (p := spectrum(y[i * w : (i + 1) * w])).sum() > 0 else 0.0 for i in range(windows)]
    return {"freq_first": mean[0], "freq_last": mean[-1], "freq_shift": mean[-1] - mean[0]}


@operator("series", "polyrhythm_contention_v1", "rhythms long, cycle long, collision_density double", 32, most=5)
def polyrhythm(y, c, most):
    """Spectral peaks beyond mean + 2σ as whole periods, and the least common multiple of the strongest."""
    p = spectrum(y)
    top = np.flatnonzero(p > p.mean() + 2 * p.std())
    top = top[np.argsort(-p[top], kind="stable")][:most]
    periods = sorted({max(1, round(len(y) / (k + 1))) for k in top})
    if not periods:
        return {"rhythms": 0, "cycle": None, "collision_density": 0.0}
    cycle = int(np.lcm.reduce(np.array(periods, dtype=object)))
    return {"rhythms": len(periods), "cycle": min(cycle, 2**62), "collision_density": float(sum(1 / q for q in periods))}


@operator("series", "matched_filter_anomaly_v1", "template string, detections long, peak double", 30, width=8, limit=3.0)
def matched(y, c, width, limit):
    """Correlation with a spike, a step and a ramp; detections beyond mean + 3σ."""
    z, half = robust(y), width // 2
    shapes = {"spike": np.eye(1, width, half)[0], "step": np.repeat([-1.0, 1.0], half), "ramp": np.linspace(-1, 1, width)}
    out = []
    for name, s in shapes.items():
        s = (s - s.mean()) / np.linalg.norm(s - s.mean())
        r = np.correlate(z, s, "valid")
        out.append({"template": name, "detections": int((r > r.mean() + limit * r.std()).sum()), "peak": r.max()})
    return out


@operator("series", "self_similarity_matrix_v1", "best_lag long, best_sim double", 32, width=8)
def self_similarity(y, c, width):
    """Lag at which windows resemble each other most, by mean cosine; beyond one window's width."""
    w = embed(robust(y), width, 1)
    w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    lags = range(width, len(w) // 2 + 1)
    sim = [float((w[k:] * w[:-k]).sum(1).mean()) for k in lags]
    i = int(np.argmax(sim))
    return {"best_lag": lags[i], "best_sim": sim[i]}


@operator("series", "matrix_profile_motifs_discords", "discord_at long, discord_distance double, motif_a long, motif_b long, motif_distance double", 40, window=12)
def matrix_profile(y, c, window):
    """Nearest neighbour of every z-normalised window outside its own quarter; blocks of rows bound the memory."""
    w = embed(y, window, 1)
    s = w.std(1, keepdims=True)
    w = np.where(s > 1e-12, (w - w.mean(1, keepdims=True)) / np.where(s > 1e-12, s, 1), 0)
    n, near, best = len(w), np.empty(len(w)), np.empty(len(w), dtype=int)
    for lo in range(0, n, 512):
        d = distances(w[lo : lo + 512], w)
        i = np.arange(lo, min(lo + 512, n))
        d[np.abs(i[:, None] - np.arange(n)[None, :]) < max(1, window // 4)] = np.inf
        near[i], best[i] = d.min(1), d.argmin(1)
    m, k = int(np.argmin(near)), int(np.argmax(near))
    return {"discord_at": k, "discord_distance": near[k], "motif_a": min(m, best[m]), "motif_b": max(m, best[m]), "motif_distance": near[m]}


@operator("series", "ssa_decomposition_changepoint_v1", "at long, step double, explained double", 40, window=12, components=2, top=5)
def ssa(y, c, window, components, top):
    """Steepest places of the reconstruction from the leading components of the trajectory matrix."""
    t = embed(y - y.mean(), window, 1)
    u, s, v = np.linalg.svd(t, full_matrices=False)
    low = (u[:, :components] * s[:components]) @ v[:components]
    level, n = np.zeros(len(y)), np.zeros(len(y))
    for j in range(window):
        level[j : j + len(t)] += low[:, j]
        n[j : j + len(t)] += 1
    d = np.abs(np.diff(level / n))
    at = np.argsort(-d, kind="stable")[:top]
    return [{"at": int(i) + 1, "step": d[i], "explained": (s[:components] ** 2).sum() / max((s**2).sum(), 1e-300)} for i in sorted(at)]


# States and chaos


@operator("series", "markov_harmonic_progression_v1", "states long, norm_entropy double, release double", 40, bins=5)
def harmonic(y, c, bins):
    """Transitions among percentile states; entropy of the transition rows, and P(from the top state to the lower half)."""
    s = np.searchsorted(np.quantile(y, np.arange(1, bins) / bins), y, "right")
    t = np.zeros((bins, bins))
    np.add.at(t, (s[:-1], s[1:]), 1)
    rows = t.sum(1)
    h = sum(r / rows.sum() * entropy(t[i]) for i, r in enumerate(rows) if r)
    return {"states": bins, "norm_entropy": h / np.log2(bins), "release": t[-1, : bins // 2].sum() / max(rows[-1], 1)}


def _delay(y: np.ndarray) -> int:
    """First lag at which the autocorrelation is lowest or falls below 1/e."""
    z = y - y.mean()
    v = (z * z).sum() or 1.0
    acf = np.array([(z[k:] * z[: len(z) - k]).sum() / v for k in range(1, max(3, min(50, len(z) // 4)))])
    below = np.flatnonzero(acf < 1 / np.e)
    return int(below[0]) + 1 if len(below) else int(np.argmin(acf)) + 1


@operator("series", "takens_embedding_v1", "delay long, dimension long, false_share double", 60, most=8)
def takens(y, c, most):
    """Delay and the smallest dimension with under 10 per cent false nearest neighbours."""
    tau, share = _delay(y), 1.0
    for dim in range(1, most + 1):
        if len(y) - dim * tau < 20:
            break
        nxt = y[dim * tau :]
        e = embed(y, dim, tau)[: len(nxt)]
        d = distances(e, e)
        np.fill_diagonal(d, np.inf)
        j = d.argmin(1)
        ratio = np.abs(nxt - nxt[j]) / np.maximum(d[np.arange(len(e)), j], 1e-9)
        share = float((ratio > 10).mean())
        if share < 0.1:
            break
    return {"delay": tau, "dimension": dim, "false_share": share}


def divergence(y: np.ndarray, dim: int, steps: int) -> np.ndarray:
    """Mean log distance of nearest neighbours after 1, 2, … steps."""
    e = embed(y, dim, 1)
    n = len(e) - steps
    d = distances(e[:n], e[:n])
    i = np.arange(n)
    d[np.abs(i[:, None] - i[None, :]) <= dim] = np.inf
    j = d.argmin(1)
    return np.array([np.log(np.maximum(np.linalg.norm(e[i + k] - e[j + k], axis=1), 1e-12)).mean() for k in range(1, steps + 1)])


@operator("series", "lyapunov_exponent_chaos_v1", "exponent double, chaotic boolean", 60, dim=3, steps=5)
def lyapunov(y, c, dim, steps):
    d = divergence(y, dim, steps)
    v = float((d[-1] - d[0]) / (steps - 1))
    return {"exponent": v, "chaotic": bool(v > 0.01)}


@operator("series", "lyapunov_stability_v1", "lyapunov_exponent double", 60, dim=2, steps=10)
def lyapunov_slope(y, c, dim, steps):
    return {"lyapunov_exponent": slope(np.arange(1, steps + 1.0), divergence(y, dim, steps))}


@operator("series", "fractal_dimension_attractor_v1", "dimension double, radii long", 60, dim=3, radii=10)
def correlation_dimension(y, c, dim, radii):
    """Slope of log C(r) over radii between the 5th and 50th percentile of distances."""
    e = embed(y, dim, _delay(y)) if len(y) > 3 * _delay(y) + 20 else embed(y, dim, 1)
    d = distances(e, e)[np.triu_indices(len(e), 1)]
    low, high = np.quantile(d, [0.05, 0.5])
    if low <= 0 or high <= low:
        return None
    r = np.geomspace(low, high, radii)
    return {"dimension": slope(np.log(r), np.log([(d <= x).mean() for x in r])), "radii": radii}


@operator("series", "recurrence_quantification_rqa_v1", "recurrence_rate double, determinism double, laminarity double, early_rr double, late_rr double", 40, share=0.1)
def rqa(y, c, share):
    """Recurrences of a two-step embedding within the ``share`` quantile of distances; lines of two or more."""
    e = embed(robust(y), 2, 1)
    d = distances(e, e)
    r = d <= np.quantile(d[np.triu_indices(len(e), 1)], share)
    np.fill_diagonal(r, False)

    def lines(get):
        total = inside = 0
        for line in get:
            total += line.sum()
            pad = np.concatenate(([False], line, [False]))
            inside += (line & (pad[:-2] | pad[2:])).sum()
        return inside / total if total else 0.0

    n, h = len(e), len(e) // 2
    rate = lambda q: q.sum() / (len(q) * (len(q) - 1))
    return {
        "recurrence_rate": rate(r), "determinism": lines(np.diagonal(r, k) for k in range(1, n)), "laminarity": lines(r[:, j] for j in range(n)),
        "early_rr": rate(r[:h, :h]), "late_rr": rate(r[h:, h:]),
    }


@operator("series", "excess_entropy_memory_v1", "entropy_rate double, excess double", 60, bins=3, longest=4)
def excess_entropy(y, c, bins, longest):
    """Block entropies of the series in percentile symbols: slope and intercept at the longest blocks."""
    s = np.searchsorted(np.quantile(y, np.arange(1, bins) / bins), y, "right")
    h = []
    for k in range(1, longest + 1):
        code = sum(s[i : len(s) - k + 1 + i] * bins**i for i in range(k))
        h.append(entropy(np.bincount(code)))
    rate = h[-1] - h[-2]
    return {"entropy_rate": rate, "excess": h[-1] - longest * rate}


@operator("series", "kolmogorov_complexity_ncd_v1", "mean_ncd double, max_ncd double, at long", 64, windows=8)
def ncd(y, c, windows):
    """Compression distance of consecutive windows, on values in 256 ranks."""
    q = np.searchsorted(np.quantile(y, np.arange(1, 256) / 256), y).astype(np.uint8)
    parts = [p.tobytes() for p in np.array_split(q, windows)]
    z = lambda b: len(zlib.compress(b, 9))
    d = [(z(a + b) - min(z(a), z(b))) / max(z(a), z(b)) for a, b in zip(parts, parts[1:])]
    return {"mean_ncd": np.mean(d), "max_ncd": max(d), "at": int(np.argmax(d)) + 1}


# Extremes and points


@operator("series", "return_period_evt_v1", "shape double, location double, scale double, level_10 double, level_100 double", 40, block=12)
def gev(y, c, block):
    """GEV of block maxima by probability-weighted moments; return levels of 10 and 100 blocks."""
    from math import gamma, log

    x = np.sort([b.max() for b in np.array_split(y, len(y) // block)])
    n = len(x)
    if n < 3:
        return None
    i = np.arange(n)
    b0, b1, b2 = x.mean(), (i * x).sum() / (n * (n - 1)), (i * (i - 1) * x).sum() / (n * (n - 1) * (n - 2))
    if 3 * b2 - b0 == 0 or 2 * b1 - b0 <= 0:
        return None
    d = (2 * b1 - b0) / (3 * b2 - b0) - log(2) / log(3)
    k = 7.859 * d + 2.9554 * d * d
    k = k if abs(k) > 1e-6 else 1e-6
    scale = (2 * b1 - b0) * k / (gamma(1 + k) * (1 - 2**-k))
    loc = b0 + scale * (gamma(1 + k) - 1) / k
    level = lambda t: loc + scale / k * (1 - (-log(1 - 1 / t)) ** k)
    return {"shape": -k, "location": loc, "scale": scale, "level_10": level(10), "level_100": level(100)}


@operator("series", "ripley_k_temporal_clustering_v1", "radius long, k_ratio double, clustered boolean", 20, radii=10)
def ripley(y, c, radii):
    """Pairs of events within r buckets against those of a steady rate, both from bucket counts."""
    n, t = c.sum(), len(c)
    out = []
    for r in range(1, min(radii, t // 2) + 1):
        own = float((c * (c - 1)).sum())
        pairs = own + 2 * sum(float((c[k:] * c[:-k]).sum()) for k in range(1, r + 1))
        # ordered pairs of buckets at most r apart, of all t² pairs
        share = (t + 2 * sum(t - k for k in range(1, r + 1))) / t**2
        ratio = pairs / (n * (n - 1) * share)
        out.append({"radius": r, "k_ratio": ratio, "clustered": bool(ratio > 1 + 2 / np.sqrt(n))})
    return out


@operator("series", "epicurve_classification_v1", "onsets long, peak_ratio double, kind string", 40, bins=12, limit=3.0)
def epicurve(y, c, bins, limit):
    """Onsets of anomalous buckets over time: one peak is a point source, even spread is continuous, several peaks propagate."""
    z = np.abs(robust(y)) > limit
    starts = np.flatnonzero(z & ~np.concatenate(([False], z[:-1])))
    if not len(starts):
        return {"onsets": 0, "peak_ratio": 0.0, "kind": "none"}
    h = np.histogram(starts, bins, (0, len(y)))[0]
    pad = np.concatenate(([0], h, [0]))
    peaks = int(((h > pad[:-2]) & (h >= pad[2:]) & (h > h.mean())).sum())
    ratio = h.max() / len(starts)
    return {"onsets": len(starts), "peak_ratio": ratio, "kind": "point" if ratio > 0.5 else "propagated" if peaks > 1 else "continuous"}


@operator("series", "dp_gmm", "components long, largest double, separation double", 40, most=6, rounds=200)
def mixture(y, c, most, rounds):
    """Gaussian mixture on a line started at quantiles; components of weight over 0.01 by the lowest BIC."""
    z, n, best = robust(y), len(y), None
    for k in range(1, most + 1):
        mu, var, w = np.quantile(z, (np.arange(k) + 0.5) / k), np.full(k, z.var() or 1.0), np.full(k, 1 / k)
        for _ in range(rounds):
            logp = np.log(w) - 0.5 * np.log(2 * np.pi * var) - (z[:, None] - mu) ** 2 / (2 * var)
            r = np.exp(logp - np.logaddexp.reduce(logp, axis=1)[:, None])
            s = r.sum(0) + 1e-12
            w, mu = s / s.sum(), (r * z[:, None]).sum(0) / s
            var = np.maximum((r * (z[:, None] - mu) ** 2).sum(0) / s, 1e-3)
        bic = -2 * np.logaddexp.reduce(logp, axis=1).sum() + (3 * k - 1) * np.log(n)
        if best is None or bic < best[0] - 1e-9:
            best = bic, w, mu
    _, w, mu = best
    kept = np.sort(mu[w > 0.01])
    return {"components": len(kept), "largest": w.max(), "separation": float(np.diff(kept).min()) if len(kept) > 1 else None}
