"""Numerical routines for grouped Arrow functions: distributions, tail fits.

Each takes the arrays of one series or pair, which are bounded by the number of days.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def normal_cdf(x: np.ndarray | float) -> np.ndarray:
    """By the series of positive terms for small |x| and a continued fraction beyond, on whole arrays; exact to some 1e-15."""
    x = np.asarray(x, float)
    z = np.minimum(np.abs(x), 40.0)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    small = np.minimum(z, 3.5)
    term, total = small.copy(), small.copy()
    for k in range(1, 80):
        term = term * small * small / (2 * k + 1)
        total += term
    large, tail = np.maximum(z, 3.5), np.maximum(z, 3.5)
    for k in range(80, 0, -1):
        tail = large + k / tail
    upper = np.where(z <= 3.5, 0.5 - density * total, density / tail)
    return np.where(x > 0, 1 - upper, upper)


def black_scholes(kind: np.ndarray, spot: np.ndarray, strike: np.ndarray, years: np.ndarray, rate: float, sigma: np.ndarray) -> np.ndarray:
    sd = sigma * np.sqrt(years)
    d1 = (np.log(spot / strike) + (rate + sigma**2 / 2) * years) / sd
    d2 = d1 - sd
    call = spot * normal_cdf(d1) - strike * np.exp(-rate * years) * normal_cdf(d2)
    return np.where(kind == "call", call, call - spot + strike * np.exp(-rate * years))


def implied_vol(kind: np.ndarray, price: np.ndarray, spot: np.ndarray, strike: np.ndarray, years: np.ndarray, rate: float, steps: int = 100, tol: float = 1e-8) -> np.ndarray:
    """Bisection between 1e-4 and 5 on whole arrays; NaN outside the no-arbitrage bounds."""
    lo, hi = np.full(len(price), 1e-4), np.full(len(price), 5.0)
    low = black_scholes(kind, spot, strike, years, rate, lo)
    high = black_scholes(kind, spot, strike, years, rate, hi)
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = black_scholes(kind, spot, strike, years, rate, mid) < price
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        if (hi - lo).max(initial=0) < tol:
            break
    return np.where((price >= low) & (price <= high), (lo + hi) / 2, np.nan)


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 300, size: float = 0.1, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Minimum of f by the simplex method with the usual coefficients."""
    n = len(start)
    simplex = [np.array(start, float)] + [np.array(start, float) + size * max(1.0, abs(start[k])) * np.eye(n)[k] for k in range(n)]
    values = [f(p) for p in simplex]
    for _ in range(steps):
        by = np.argsort(values)
        simplex, values = [simplex[k] for k in by], [values[k] for k in by]
        if values[-1] - values[0] < tol:
            break
        centre = np.mean(simplex[:-1], 0)
        reach = lambda t: centre + t * (simplex[-1] - centre)  # noqa: E731, B023
        r = reach(-1.0)
        fr = f(r)
        if fr < values[0]:
            e = reach(-2.0)
            fe = f(e)
            simplex[-1], values[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < values[-2]:
            simplex[-1], values[-1] = r, fr
        else:
            c = reach(-0.5 if fr < values[-1] else 0.5)
            fc = f(c)
            if fc < min(fr, values[-1]):
                simplex[-1], values[-1] = c, fc
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:]]
                values = [values[0]] + [f(p) for p in simplex[1:]]
    k = int(np.argmin(values))
    return simplex[k], values[k]


def gpd_fit(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution by maximum likelihood."""
    mean = excess.mean()

    def loss(p: np.ndarray) -> float:
        xi, scale = p[0], math.exp(p[1])
        if abs(xi) < 1e-6:
            return len(excess) * p[1] + excess.sum() / scale
        z = 1 + xi * excess / scale
        return len(excess) * p[1] + (1 + 1 / xi) * np.log(z).sum() if (z > 0).all() else 1e12

    best, _ = nelder_mead(loss, np.array([0.1, math.log(mean)]))
    return float(best[0]), float(math.exp(best[1]))


def gpd_tail(losses: np.ndarray, threshold_q: float, level: float) -> dict[str, float]:
    """VaR and ES at the level from a generalised Pareto fit above a quantile of the losses."""
    u = float(np.quantile(losses, threshold_q))
    excess = losses[losses > u] - u
    xi, scale = gpd_fit(excess)
    share = len(excess) / len(losses)
    ratio = (1 - level) / share
    var = u + (scale / xi * (ratio**-xi - 1) if abs(xi) > 1e-6 else -scale * math.log(ratio))
    es = (var + scale - xi * u) / (1 - xi) if xi < 1 else float("nan")
    return {"threshold": u, "exceedances": float(len(excess)), "xi": xi, "scale": scale, "var": var, "es": max(es, var) if es == es else es}


def expectile(x: np.ndarray, tau: float, steps: int = 80) -> float:
    lo, hi = float(x.min()), float(x.max())
    for _ in range(steps):
        mid = (lo + hi) / 2
        balance = tau * np.maximum(x - mid, 0).sum() - (1 - tau) * np.maximum(mid - x, 0).sum()
        lo, hi = (mid, hi) if balance > 0 else (lo, mid)
    return (lo + hi) / 2


def hill(losses: np.ndarray, k: int) -> float:
    top = np.sort(losses[losses > 0])[::-1][: k + 1]
    return float(np.log(top[:k]).mean() - math.log(top[k]))


def dedh(losses: np.ndarray, k: int) -> float:
    """Moment estimator of the extreme-value index."""
    top = np.log(np.sort(losses[losses > 0])[::-1][: k + 1])
    e = top[:k] - top[k]
    m1, m2 = e.mean(), (e * e).mean()
    return float(m1 + 1 - 0.5 / (1 - m1 * m1 / m2))


def plateau_shape(losses: np.ndarray, sizes: list[int]) -> float:
    """Slope of log median block maximum on log block size: the shape by maxima of sliding blocks."""
    points = []
    for b in sizes:
        m = np.lib.stride_tricks.sliding_window_view(losses, b).max(1)
        med = np.quantile(m, 0.5, method="median_unbiased")
        if med > 0:
            points.append((math.log(b), math.log(med)))
    x, y = np.array(points).T
    return float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


def block_grid(n: int) -> np.ndarray:
    """Block sizes between n**0.2 and the smaller of n**0.55 and n / 15, evenly spaced in logarithms."""
    low = max(5, math.ceil(n**0.2))
    high = min(n, max(low + 4, min(int(n**0.55), n // 15)))
    return np.unique(np.rint(np.geomspace(low, high, min(32, max(10, high - low + 1)))).astype(int))


def ols_hc0(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept, slope and the slope's heteroscedasticity-robust (HC0) standard error."""
    c = x - x.mean()
    s = (c * c).sum()
    slope = (c * y).sum() / s
    e = y - y.mean() - slope * c
    return float(y.mean() - slope * x.mean()), float(slope), float(math.sqrt((c * c * e * e).sum()) / s)


def plateau_window(x: np.ndarray, y: np.ndarray, least: int = 5, trim: float = 0.15, bend: float = 2.0) -> tuple[int, int, float]:
    """(start, stop, score) of the window of points that lies best on one line: least (mean squared residual
    + bend * mean change of slope) / sqrt(points), all windows at once from running sums."""
    n = len(x)
    cut = min(int(n * trim), max(n - least, 0))
    low, high = (cut, n - cut) if n - 2 * cut >= least else (0, n)
    total = lambda v: np.append(0.0, np.cumsum(v))
    sx, sy, sxx, sxy, syy = (total(v) for v in (x, y, x * x, x * y, y * y))
    turns = total(np.abs(np.diff(np.diff(y) / np.diff(x))))
    a, b = np.array([(i, j) for i in range(low, high - least + 1) for j in range(i + least, high + 1)]).T
    k = b - a
    of = lambda t: t[b] - t[a]
    vx, vy, vxy = of(sxx) - of(sx) ** 2 / k, of(syy) - of(sy) ** 2 / k, of(sxy) - of(sx) * of(sy) / k
    score = (np.maximum(vy - vxy**2 / vx, 0) / k + bend * (turns[b - 2] - turns[a]) / (k - 2)) / np.sqrt(k)
    best = int(score.argmin())
    return int(a[best]), int(b[best]), float(score[best])


def shape_of_medians(points: list[tuple[float, float]]) -> dict[str, float]:
    """Shape from (block size, median of its maxima): slope of the logarithms over the plateau window."""
    x, y = np.array([(math.log(b), math.log(m)) for b, m in points if m > 0]).T
    start, stop, score = plateau_window(x, y)
    _, slope, se = ols_hc0(x[start:stop], y[start:stop])
    low, high = float(round(math.exp(x[start]))), float(round(math.exp(x[stop - 1])))
    return {"shape": slope, "standard_error": se, "score": score, "points": float(stop - start), "low_block": low, "high_block": high}


def block_shape(losses: np.ndarray) -> dict[str, float]:
    """Shape by block maxima: slope of log median sliding maximum on log block size over the plateau window."""
    maxima = lambda b: np.lib.stride_tricks.sliding_window_view(losses, b).max(1)
    return shape_of_medians([(b, float(np.median(maxima(b)))) for b in block_grid(len(losses))])


def gpd_scale(excess: np.ndarray, xi: float, steps: int = 100) -> tuple[float, bool]:
    """Scale of greatest likelihood of a generalised Pareto distribution of fixed shape, by golden section on its
    logarithm, and whether all excesses lie inside the support."""

    def loss(t: float) -> float:
        scale = math.exp(t)
        if abs(xi) < 1e-6:
            return len(excess) * t + excess.sum() / scale
        z = 1 + xi * excess / scale
        return len(excess) * t + (1 + 1 / xi) * np.log(z).sum() if (z > 0).all() else math.inf

    low, high = math.log(excess.mean()) - 5, math.log(excess.mean()) + 5
    if xi < 0:
        low = max(low, math.log(-xi * excess.max() * (1 + 1e-9)))
    g = (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    scale = math.exp((low + high) / 2)
    return scale, xi >= 0 or bool(excess.max() < -scale / xi)


def gpd_quantiles(u: float, xi: float, scale: float, share: float, level: float) -> tuple[float, float]:
    """VaR and ES at the level of a generalised Pareto tail that holds `share` of the losses above u."""
    ratio = (1 - level) / share
    var = u + (scale / xi * (ratio**-xi - 1) if abs(xi) > 1e-6 else -scale * math.log(ratio))
    return var, max(var, (var + scale - xi * u) / (1 - xi)) if xi < 1 else math.nan
