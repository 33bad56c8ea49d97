"""Per-series numerics over numpy arrays: trend tests, peaks, curves and their bounded fits, F tests."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from ..schema import PARAMS

#: Seed fraction of the closed-form epidemic curve (fixed value).
ETA = 1e-4


def peaks(y: np.ndarray, least: float = -math.inf) -> np.ndarray:
    """Middles of interior runs of equal values that are higher than both neighbours, of at least `least`."""
    y = np.asarray(y, float)
    if len(y) < 3:
        return np.zeros(0, int)
    starts = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    ends = np.append(starts[1:], len(y)) - 1
    v = y[starts]
    inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    inner = inner[v[inner] >= least]
    return (starts[inner] + ends[inner]) // 2


def shape_facts(y: np.ndarray) -> dict:
    """Sum, peak, days to it, days of at least half of it, and waves (half-height peaks, one at least)."""
    y = np.asarray(y, float)
    top = float(y.max()) if len(y) else 0.0
    if top <= 0:
        return {"total_volume": float(y.sum()), "peak_volume": 0.0, "time_to_peak_days": 0.0, "active_days": 0, "wave_count": 0}
    return {
        "total_volume": float(y.sum()),
        "peak_volume": top,
        "time_to_peak_days": float(np.argmax(y)),
        "active_days": int((y >= top / 2).sum()),
        "wave_count": max(1, len(peaks(y, top / 2))),
    }


def theil_sen(y: np.ndarray) -> float:
    """Median of all pairwise slopes."""
    i, j = np.triu_indices(len(y), 1)
    return float(np.median((y[j] - y[i]) / (j - i))) if len(i) else 0.0


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return ((2 * last - counts + 1) / 2)[inverse]


def mann_kendall(y: np.ndarray, alpha: float = PARAMS.trend_alpha) -> dict:
    """The rank trend test with ties and with serial correlation of detrended ranks in its variance."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 4:
        return {"trend": "no trend", "p": 1.0, "z": 0.0, "s": 0.0, "slope": 0.0, "ties": 0.0}
    i, j = np.triu_indices(n, 1)
    s = float(np.sign(y[j] - y[i]).sum())
    counts = np.unique(y, return_counts=True)[1].astype(float)
    ties = float((counts * (counts - 1) * (2 * counts + 5)).sum())
    variance = (n * (n - 1) * (2 * n + 5) - ties) / 18
    ranks = average_ranks(y - theil_sen(y) * np.arange(n))
    ranks = ranks - ranks.mean()
    own = float(ranks @ ranks)
    lags = np.arange(1, n)
    r = np.array([ranks[: n - k] @ ranks[k:] for k in lags]) / own if own > 0 else np.zeros(n - 1)
    r[np.abs(r) <= NormalDist().inv_cdf(1 - alpha / 2) / math.sqrt(n)] = 0
    m = n - lags.astype(float)
    variance *= 1 + 2 / (n * (n - 1) * (n - 2)) * float((m * (m - 1) * (m - 2) * r).sum())
    z = (s - np.sign(s)) / math.sqrt(variance) if variance > 0 and s else 0.0
    p = 2 * (1 - NormalDist().cdf(abs(z)))
    trend = "no trend" if p >= alpha or z == 0 else "increasing" if z > 0 else "decreasing"
    return {"trend": trend, "p": p, "z": float(z), "s": s, "slope": theil_sen(np.log1p(np.maximum(y, 0))), "ties": ties}


def faded(y: np.ndarray, w: int, fraction: float = PARAMS.dormant_fraction) -> tuple[bool, float, float | None]:
    """Whether the last w values' mean fell under a fraction of the loudest w before them, the ratio and that level."""
    y = np.asarray(y, float)
    n = len(y)
    if w >= n or w <= 0:
        return False, 1.0, None
    if n >= 2 * w:
        sums = np.convolve(y[: n - w], np.ones(w), "valid")
        at = int(np.argmax(np.round(sums, 9)))
        level = float(y[at : at + w].mean())
    else:
        level = float(y[: n - w].mean())
    if level <= 0:
        return False, 1.0, None
    ratio = float(y[-w:].mean()) / level
    return ratio < fraction, ratio, level


def wave_slope(y: np.ndarray, fraction: float = PARAMS.dormant_fraction) -> float | None:
    """Daily log1p rate along the last half-height wave: from its peak to the first day under a fraction of it (or the end);
    where the peak is the end, along the climb to it; null where there's none."""
    y = np.asarray(y, float)
    if len(y) < 4 or y.max() <= 0:
        return None
    tops = peaks(y, y.max() / 2)
    top = int(tops[-1]) if len(tops) else int(np.argmax(y))
    line = fraction * y[top]
    after = np.flatnonzero(y[top + 1 :] < line)
    a, b = top, top + 1 + int(after[0]) if len(after) else len(y) - 1
    if b <= a:
        before = np.flatnonzero(y[:top] < line)
        a, b = int(before[-1]) + 1 if len(before) else 0, top
        if b <= a:
            return None
    return float((np.log1p(max(y[b], 0)) - np.log1p(max(y[a], 0))) / (b - a))


def classify(y: np.ndarray, days_silent: int, p=PARAMS) -> dict:
    """growth, decay, stable or dormant: by the recent weeks' trend, else by whether they faded; long silence is dormant."""
    w = min(7 * p.recent_weeks, len(y))
    trend = mann_kendall(y[-w:] if w else y, p.trend_alpha)
    gone, ratio, level = faded(y, w, p.dormant_fraction)
    stage = {"increasing": "growth", "decreasing": "decay"}.get(trend["trend"], "dormant" if gone else "stable")
    stale = days_silent > 7 * p.stale_weeks
    slope = wave_slope(y, p.dormant_fraction)
    return {
        "stage": "dormant" if stale else stage, "trend": trend["trend"], "trend_p": trend["p"], "trend_z": trend["z"], "slope": trend["slope"] if slope is None else slope,
        "recent_peak_ratio": ratio, "peak_level": level, "near_peak": not gone, "stale": stale, "elapsed_days": len(y), "smoothed_volume": int(np.sum(y)),
    }


# --- curves -------------------------------------------------------------------------------------------------------------


def logistic(t, top, k, t0):
    return top / (1 + np.exp(np.clip(-k * (t - t0), -700, 700)))


def sir_shape(k0: float) -> tuple[float, float, float, float]:
    """umax, kappa, phi, tau_u of the closed form."""
    k0 = min(max(k0, 1e-3), 1 - 1e-3)
    imax = 1 - k0 - k0 * math.log((1 - ETA) / k0)
    umax = math.log(imax / ETA)
    kappa = 1 / math.expm1(imax / k0)
    phi = math.atanh(min(math.sqrt(max(1 - kappa * imax / k0, 0)), 1 - 1e-15))
    return umax, kappa, phi, umax * k0 / (1 - k0)


def sir(t, height, peak, k0, timescale):
    """An exponential rise that meets a shifted sech-square decay at the peak."""
    k0 = min(max(k0, 1e-3), 1 - 1e-3)
    umax, kappa, phi, tau_u = sir_shape(k0)
    d = (np.asarray(t, float) - peak) / timescale
    rise = height * np.exp(np.clip(np.minimum(d, 0) * umax / tau_u, -700, 0))
    down = np.cosh(phi) / np.cosh(np.clip(k0 * np.maximum(d, 0) / (2 * math.sqrt(1 + kappa)) + phi, 0, 300))
    return np.where(d < 0, rise, height * down * down)


def bass(t, m, p, q, launch):
    """Adoption rate since the launch; zero before it."""
    p = max(p, 1e-9)
    t = np.asarray(t, float) - launch
    e = np.exp(np.clip(-(p + q) * np.maximum(t, 0), -700, 0))
    return np.where(t >= 0, m * (p + q) ** 2 / p * e / (1 + q / p * e) ** 2, 0)


def least_squares(f, x0, low, high, steps: int = 200) -> tuple[np.ndarray, bool]:
    """A projected Levenberg-Marquardt: f gives residuals; parameters stay within their bounds."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(x0, float), low, high)
    r = f(x)
    cost, damp = float(r @ r), 1e-2
    for _ in range(steps):
        scale = np.maximum(np.abs(x), 1e-4)
        jac = np.empty((len(r), len(x)))
        for i in range(len(x)):
            h = 1e-6 * scale[i] * (1 if x[i] + 1e-6 * scale[i] <= high[i] else -1)
            z = x.copy()
            z[i] += h
            jac[:, i] = (f(z) - r) / h
        g, a = jac.T @ r, jac.T @ jac
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or not np.isfinite(a).all():
            return x, bool(np.isfinite(cost))
        for _ in range(12):
            d = np.zeros_like(x)
            own = a[np.ix_(free, free)]
            d[free] = np.linalg.lstsq(own + damp * np.diag(np.diag(own) + 1e-12), -g[free], rcond=None)[0]
            z = np.clip(x + d, low, high)
            new = f(z)
            value = float(new @ new)
            if value < cost:
                break
            damp *= 4
        else:
            return x, True
        done = cost - value <= 1e-10 * max(cost, 1e-300)
        x, r, cost, damp = z, new, value, max(damp / 5, 1e-12)
        if done:
            return x, True
    return x, False


def fit_lens(name: str, t: np.ndarray, y: np.ndarray) -> tuple[dict, bool, np.ndarray]:
    """Parameters, success and the fitted curve of one lens; starts and bounds follow the data."""
    span = max(float(t.max() - t.min()), 2.0 if name == "sir" else 1.0)
    top, first, last = max(float(y.max()), 1.0), float(t.min()), float(t.max())
    at = float(t[int(np.argmax(y))])
    if name == "logistic":
        curve = lambda p: logistic(t, *p)
        x, ok = least_squares(lambda p: curve(p) - y, [top, 0.1, t.mean()], [1e-6, 1e-4, first], [top * 10 + 1, 5, last])
        out = {"L": x[0], "k": x[1], "t0": x[2], "doubling_time": math.log(2) / x[1], "peak_time": x[2]}
    elif name == "sir":
        scale = lambda p: (1 - p[2]) / (p[2] * max(p[3], 1e-9))
        curve = lambda p: sir(t, p[0], p[1], p[2], scale(p))
        x, ok = least_squares(lambda p: curve(p) - y, [top, at, 0.5, 6 / span], [1e-6, first, 0.02, 1e-4], [top * 10 + 1, last, 0.98, 5])
        kappa = sir_shape(x[2])[1]
        rise, decay = (1 - x[2]) / x[2] / scale(x), x[2] / (math.sqrt(1 + kappa) * scale(x))
        out = {"height": x[0], "peak_time": x[1], "k0": x[2], "rise_rate": rise, "decay_rate": decay, "doubling_time": math.log(2) / rise, "half_life": math.log(2) / decay, "asymmetry": rise / decay}
    else:
        step = float(t[1] - t[0]) if len(t) > 1 else 1.0
        m0 = max(float(y.sum()) * step, 1.0)
        p0, q0 = math.exp(-3.5), math.exp(-0.97)  # fixed values: mean adoption rates
        rate = math.log(q0 / p0) / ((p0 + q0) * max(at - first, step))
        curve = lambda p: bass(t, *p)
        x, ok = least_squares(lambda p: curve(p) - y, [m0, p0 * rate, q0 * rate, first], [1e-6, 1e-7, 1e-7, first - span], [m0 * 10 + 1, 2, 5, last])
        peak = math.log(x[2] / x[1]) / (x[1] + x[2]) if x[2] > x[1] else 0.0
        out = {"m": x[0], "p": x[1], "q": x[2], "t_launch": x[3], "peak_time": x[3] + peak}
    fitted = curve(x)
    left, total = float(((y - fitted) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
    out["r2"] = 1 - left / total if total > 0 else 0.0
    n, k = len(y), 3 if name == "logistic" else 4
    sigma = float(np.std(y - fitted)) + 1e-6
    loglik = float(-0.5 * n * math.log(2 * math.pi * sigma * sigma) - left / (2 * sigma * sigma))
    out["aicc"] = -2 * loglik + 2 * k + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf
    return {a: float(b) for a, b in out.items()}, bool(ok), fitted


def windows(n: int, anchors: int = PARAMS.anchors, least: int = PARAMS.min_span_days) -> list[tuple[int, int]]:
    marks = sorted({*range(0, n, max(n // (anchors - 1), 1)), n - 1})
    return [(a, b) for a in marks for b in marks if b - a >= max(n // 3, least)]


def best_window(name: str, y: np.ndarray, p=PARAMS) -> dict:
    """A lens's best fit over the candidate windows: on weekly blocks where there are ten or more, else on days. With no usable
    window the days of central mass serve."""
    y = np.asarray(y, float)
    n = len(y)
    blocks = -(-n // 7)
    weekly = blocks >= p.min_weekly_blocks
    edges = [(7 * i, min(7 * i + 7, n)) for i in range(blocks)]
    grid = np.array([y[a:b].mean() for a, b in edges]) if weekly else y
    at = np.array([(a + b - 1) / 2 for a, b in edges]) if weekly else np.arange(n, dtype=float)
    best, score = None, -math.inf
    for a, b in windows(len(grid), p.anchors, -(-p.min_span_days // 7) if weekly else p.min_span_days):
        own = grid[a : b + 1]
        if (own > 0).sum() < 5 or own.max() <= 0:
            continue
        d0, d1 = (edges[a][0], edges[b][1] - 1) if weekly else (a, b)
        out, ok, _ = fit_lens(name, at[a : b + 1] - d0, own)
        good = ok and out["r2"] >= p.min_r2
        if (value := out["r2"] if good else -2.0) > score:
            best, score = out | {"converged": good, "i0": d0, "i1": d1, "peak_time": out["peak_time"] + d0}, value
    if best is None:
        run, total = np.cumsum(y), float(y.sum())
        a, b = (int(np.searchsorted(run, q * total)) for q in (p.mass_alpha / 2, 1 - p.mass_alpha / 2)) if total > 0 else (0, n - 1)
        a, b = (a, min(b, n - 1)) if b > a else (0, n - 1)
        if b - a < 3:
            return {"converged": False, "i0": a, "i1": b, "peak_time": math.nan, "r2": 0.0, "aicc": math.inf}
        out, ok, _ = fit_lens(name, np.arange(b - a + 1, dtype=float), y[a : b + 1])
        best = out | {"converged": ok and out["r2"] >= p.min_r2, "i0": a, "i1": b, "peak_time": out["peak_time"] + a}
    return best


# --- regressions --------------------------------------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return 1.0 if not f > 0 else beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def rss(x: np.ndarray, y: np.ndarray) -> float:
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return float(e @ e)


def granger(y: np.ndarray, x: np.ndarray, lags: int = PARAMS.granger_lags, per_lag: int = PARAMS.granger_obs_per_lag) -> tuple[float, int, float] | None:
    """(p, lag, F) of x leading y: the smallest p over lags of the F test on first differences; null with too few rows."""
    y, x = np.diff(np.asarray(y, float)), np.diff(np.asarray(x, float))
    n = len(y)
    if n < per_lag * lags:
        return None
    best = None
    for lag in range(1, lags + 1):
        rows = n - lag
        own = np.column_stack([np.ones(rows), *(y[lag - k : n - k] for k in range(1, lag + 1))])
        both = np.column_stack([own, *(x[lag - k : n - k] for k in range(1, lag + 1))])
        free = rows - (2 * lag + 1)
        full = rss(both, y[lag:])
        f = (rss(own, y[lag:]) - full) / lag / (full / free) if free > 0 and full > 0 else 0.0
        p = f_tail(f, lag, free)
        if best is None or p < best[0]:
            best = (p, lag, f)
    return best


def arx(y: np.ndarray, s: np.ndarray) -> dict:
    """y_t on 1, y_{t-1}, s_{t-1}: coefficients, and F tests of s against the model without it and with a trend."""
    y, s = np.asarray(y, float), np.asarray(s, float)
    n = len(y) - 1
    if n < 6:
        return {"phi": math.nan, "lam": math.nan, "p_ar": 1.0, "p_trend": 1.0}
    one, lag, lead = np.ones(n), y[:-1], s[:-1]
    full = np.column_stack([one, lag, lead])
    b = np.linalg.lstsq(full, y[1:], rcond=None)[0]
    tests = []
    for base, extra in ((np.column_stack([one, lag]), full), (np.column_stack([one, lag, np.arange(n)]), np.column_stack([full, np.arange(n)]))):
        r0, r1 = rss(base, y[1:]), rss(extra, y[1:])
        free = n - extra.shape[1]
        tests.append(f_tail((r0 - r1) / (r1 / free), 1, free) if r1 > 0 and free > 0 else 1.0)
    return {"phi": float(b[1]), "lam": float(b[2]), "p_ar": tests[0], "p_trend": tests[1]}
