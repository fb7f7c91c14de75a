"""Tail models of one series of losses: fits, filters and one-step forecasts of VaR and ES.

A model is fitted to the losses before a refit day and then filtered through the days after it
without another look at the parameters.  Recursions that are linear in their state (GARCH,
CAViaR, CARE) run as a doubling scan over the whole array; those of score-driven scales step
from day to day.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .numerics import expectile, gpd_fit, gpd_quantiles, gpd_scale, nelder_mead

#: Exceedances from which a VaR's ES multiplier, or a generalised Pareto tail, is estimated.
LEAST_EXCEEDANCES = 50
#: Degrees of freedom that the profile of score-driven scales tries.
NU_GRID = (4.0, 6.0, 8.0, 12.0)
TAU_GRID = (0.95, 0.97, 0.98, 0.985, 0.99, 0.995)
THRESHOLD = 0.9
COLD, WARM = 200, 40


@dataclass
class Fit:
    """Parameters, how the search ended, and what a forecast needs beside them."""

    params: np.ndarray
    status: str = "ok"
    value: float = math.nan
    extra: dict[str, float] = field(default_factory=dict)


def decayed(push: np.ndarray, decay: float) -> np.ndarray:
    """Sum over j <= i of decay**(i - j) * push[j], by doubling: each pass adds what lies twice as far back."""
    y, step, weight = push.astype(float), 1, float(decay)
    while step < len(y) and abs(weight) > 1e-20:
        y[step:] = y[step:] + weight * y[:-step]
        step, weight = 2 * step, weight * weight
    return y


def linear_path(push: np.ndarray, decay: float, start: float) -> np.ndarray:
    """The state before each push and one more after the last: v' = decay * v + push."""
    return np.append(start, decayed(push, decay) + start * float(decay) ** np.arange(1, len(push) + 1))


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int, size: float = 0.1, rounds: int = 2) -> tuple[np.ndarray, float, str]:
    """The best point found, its value, and how it ended: simplex searches, each from the best point of the one before until one
    gains next to nothing, then a search along the axes, which confirms the point or goes on from a better one."""
    best, value = np.array(start, float), f(np.array(start, float))
    status = "step_limit"
    for k in range(rounds):
        found, low = nelder_mead(f, best, steps, size / (k + 1))
        gain, best, value = value - low, found if low <= value else best, min(low, value)
        if gain < 1e-7 * (1 + abs(value)):
            status = "ok"
            break
    for width in (size / 4, size / 16):
        for axis in np.eye(len(best)):
            for sign in (1, -1):
                at = best + sign * width * np.maximum(np.abs(best), 0.05) * axis
                if (low := f(at)) < value - 1e-9 * (1 + abs(value)):
                    best, value, status = at, low, "ok" if status == "ok" and value - low < 1e-5 * (1 + abs(value)) else "step_limit"
    return best, value, status if value < 1e9 else "no_valid_parameters"


# Student t


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d)
            c = 1 + t / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * _beta_share(nu / (nu + x * x), nu / 2, 0.5)
    return 1 - tail if x > 0 else tail


def t_tail(level: float, nu: float) -> tuple[float, float]:
    """Quantile at the level and mean above it of a Student t with unit variance."""
    lo, hi = 0.0, 1e3
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, nu) < level else (lo, mid)
    q = (lo + hi) / 2
    density = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * math.log1p(q * q / nu))
    unit = math.sqrt((nu - 2) / nu)
    return q * unit, unit * density / (1 - level) * (nu + q * q) / (nu - 1)


def t_cost(z2: np.ndarray, log_scale: np.ndarray, nu: float) -> float:
    """Minus the log likelihood of squared standardised values under a unit-variance Student t."""
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return float(((nu + 1) / 2 * np.log1p(z2 / (nu - 2)) + log_scale).sum() - c * len(z2))


# models: fit(history, level, first, extra) -> Fit; forecast(history, month, level, fit) -> {name: (var, es)} before each loss of the month.
# A model may give several forecasts of one fit, whose tails differ; a tail without enough exceedances is NaN.


def pot_tail(z: np.ndarray, level: float, threshold: float = THRESHOLD) -> tuple[float, float, int]:
    """VaR and ES at the level by a generalised Pareto tail above the threshold quantile, and its exceedances."""
    u = float(np.quantile(z, threshold))
    excess = z[z > u] - u
    if len(excess) < LEAST_EXCEEDANCES:
        return math.nan, math.nan, len(excess)
    xi = float(np.clip(gpd_fit(excess)[0], -0.5, 0.9))
    scale, _ = gpd_scale(excess, xi)
    return (*gpd_quantiles(u, xi, scale, len(excess) / len(z), level), len(excess))


def tails_of(names: dict[str, str], z: np.ndarray, level: float, nu: float) -> dict[str, float]:
    """VaR and ES of standardised losses by each tail that is asked for, and the shape of the Pareto one."""
    out = {}
    if "t" in names:
        out["t_var"], out["t_es"] = t_tail(level, nu)
    if "evt" in names:
        out["evt_var"], out["evt_es"], out["exceedances"] = pot_tail(z, level)
    return out


class Garch:
    """GARCH(1,1) or, with leverage, GJR-GARCH(1,1), with Student-t errors on returns of -100 x loss; names by tail: "t" for the Student
    t, "evt" for a generalised Pareto tail of the standardised losses."""

    def __init__(self, leverage: bool, **names: str):
        self.leverage, self.names = leverage, names

    def unpack(self, p: np.ndarray) -> tuple[float, float, float, float, float]:
        share = lambda v: 1 / (1 + math.exp(-min(max(v, -40.0), 40.0)))
        return math.exp(min(p[0], 20.0)), 0.3 * share(p[1]), 0.3 * share(p[2]) if self.leverage else 0.0, share(p[3]), 2.1 + math.exp(min(p[4], 4.0))

    def variances(self, e: np.ndarray, p: np.ndarray, start: float) -> np.ndarray:
        omega, a, g, b, _ = self.unpack(p)
        return linear_path(omega + (a + g * (e < 0)) * e * e, b, start)

    def fit(self, x: np.ndarray, level: float, first: np.ndarray | None, extra: dict[str, float]) -> Fit:
        r = -100 * x
        e, v = r - r.mean(), float(r.var())
        if not v > 0:
            return Fit(np.zeros(5), "no_variation")

        def cost(p: np.ndarray) -> float:
            omega, a, g, b, nu = self.unpack(p)
            if a + g / 2 + b >= 0.9999:
                return 1e10
            h = self.variances(e, p, v)[:-1]
            return t_cost(e * e / h, 0.5 * np.log(h), nu)

        start = np.array([math.log(0.05 * v), -1.0, -1.0, 1.7, 1.5]) if first is None else first
        p, value, status = minimise(cost, start, COLD if first is None else WARM)
        omega, a, g, b, nu = self.unpack(p)
        out = {"mu": float(r.mean()), "start": v, "nu": nu, "persistence": a + g / 2 + b}
        z = -e / np.sqrt(self.variances(e, p, v)[:-1])
        return Fit(p, status, value, out | tails_of(self.names, z, level, nu))

    def forecast(self, x: np.ndarray, month: np.ndarray, level: float, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        e = -100 * np.append(x, month) - fit.extra["mu"]
        sd = np.sqrt(self.variances(e, fit.params, fit.extra["start"])[len(x) : -1])
        return {name: tuple((-fit.extra["mu"] + sd * fit.extra[f"{tail}_{k}"]) / 100 for k in ("var", "es")) for tail, name in self.names.items()}


class Score:
    """Location and a log scale that the Student-t score drives, f' = w + b f + a s; names as for Garch."""

    def __init__(self, **names: str):
        self.names = names

    def path(self, x: np.ndarray, p: np.ndarray, nu: float, start: float) -> np.ndarray:
        mu, w, b, a = (float(v) for v in p)
        f, out = start, [start]
        for z2 in ((x - mu) ** 2).tolist():
            z2 *= math.exp(-2 * f)
            f = w + b * f + a * ((nu + 1) * z2 / (nu - 2 + z2) - 1)
            f = min(max(f, -50.0), 50.0)
            out.append(f)
        return np.array(out)

    def fit(self, x: np.ndarray, level: float, first: np.ndarray | None, extra: dict[str, float]) -> Fit:
        sd = float(x.std(ddof=1))
        if not sd > 0:
            return Fit(np.zeros(4), "no_variation")
        start = math.log(sd)
        begin = np.array([x.mean(), 0.05 * start, 0.95, 0.05]) if first is None else first

        def cost(p: np.ndarray, nu: float) -> float:
            if not (0 <= p[2] < 0.999 and 0 <= p[3] < 0.5):
                return 1e10
            f = self.path(x, p, nu, start)[:-1]
            return t_cost((x - p[0]) ** 2 * np.exp(-2 * f), f, nu)

        if "nu" in extra:  # the profile is taken once a year
            nu = extra["nu"]
        else:
            rough = [(minimise(lambda p, nu=nu: cost(p, nu), begin, 40, 0.05, 1)[1], nu) for nu in NU_GRID]
            nu = min(rough)[1]
        p, value, status = minimise(lambda p: cost(p, nu), begin, COLD // 2 if first is None else WARM // 2, 0.05)
        z = (x - p[0]) * np.exp(-self.path(x, p, nu, start)[:-1])
        return Fit(p, status, value, {"nu": nu, "start": start} | tails_of(self.names, z, level, nu))

    def forecast(self, x: np.ndarray, month: np.ndarray, level: float, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        sd = np.exp(self.path(np.append(x, month), fit.params, fit.extra["nu"], fit.extra["start"])[len(x) : -1])
        return {name: tuple(fit.params[0] + sd * fit.extra[f"{tail}_{k}"] for k in ("var", "es")) for tail, name in self.names.items()}


class Recursive:
    """VaR that follows the size of losses, v' = p0 + p1 v + p2 |x| (or p2 x+ + p3 x-), fitted by quantile or expectile loss; ES is VaR times
    the mean ratio of exceedances, of LEAST_EXCEEDANCES at least."""

    def __init__(self, name: str, asymmetric: bool, by_expectile: bool = False):
        self.names, self.asymmetric, self.by_expectile = {"ratio": name}, asymmetric, by_expectile

    def path(self, x: np.ndarray, p: np.ndarray, start: float) -> np.ndarray:
        push = p[2] * np.maximum(x, 0) + p[3] * np.maximum(-x, 0) if self.asymmetric else p[2] * np.abs(x)
        return linear_path(p[0] + push, float(p[1]), start)

    def fit(self, x: np.ndarray, level: float, first: np.ndarray | None, extra: dict[str, float]) -> Fit:
        head = x[: max(50, len(x) // 10)]
        tau = level
        if self.by_expectile:  # the expectile whose breach rate is nearest to the target
            tau = extra.get("tau") or min(TAU_GRID, key=lambda t: abs(float((x > expectile(x, t)).mean()) - (1 - level)))
        start = expectile(head, tau) if self.by_expectile else float(np.quantile(head, level))

        def cost(p: np.ndarray) -> float:
            if not -0.99 < p[1] < 0.999:
                return 1e10
            e = x - self.path(x, p, start)[:-1]
            if not np.isfinite(e).all():
                return 1e10
            if self.by_expectile:
                return float((np.where(e > 0, tau, 1 - tau) * e * e).mean())
            return float(((level - (e < 0)) * e).mean())

        begin = np.array([0.1 * start, 0.8, 0.2, 0.2] if self.asymmetric else [0.1 * start, 0.8, 0.2]) if first is None else first
        p, value, status = minimise(cost, begin, COLD if first is None else WARM)
        v = self.path(x, p, start)[:-1]
        hit = (x > v) & (v > 0)
        times = max(1.0, float((x[hit] / v[hit]).mean())) if int(hit.sum()) >= LEAST_EXCEEDANCES else math.nan
        return Fit(p, status, value, {"start": start, "times": times, "tau": tau, "breach_rate": float((x > v).mean())})

    def forecast(self, x: np.ndarray, month: np.ndarray, level: float, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        v = self.path(np.append(x, month), fit.params, fit.extra["start"])[len(x) : -1]
        return {self.names["ratio"]: (v, v * fit.extra["times"])}


class Static:
    """A generalised Pareto tail on the losses themselves."""

    def __init__(self, name: str):
        self.names = {"evt": name}

    def fit(self, x: np.ndarray, level: float, first: np.ndarray | None, extra: dict[str, float]) -> Fit:
        return Fit(np.zeros(0), "ok", math.nan, tails_of(self.names, x, level, math.nan))

    def forecast(self, x: np.ndarray, month: np.ndarray, level: float, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        return {self.names["evt"]: tuple(np.full(len(month), fit.extra[f"evt_{k}"]) for k in ("var", "es"))}


MODELS = {
    "garch": Garch(False, t="garch_t"), "gjr_garch": Garch(True, t="gjr_garch_t", evt="gjr_garch_evt"), "score": Score(t="gas_t", evt="gas_t_evt"),
    "caviar_sav": Recursive("caviar_sav", False), "caviar_as": Recursive("caviar_as", True), "care_sav": Recursive("care_sav", False, True),
    "pot": Static("pot_gpd"),
}
