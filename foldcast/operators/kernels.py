"""Numeric kernels on one series or one design matrix, in NumPy. Missing values are NaN here.

The recurrences that promise equal bits (EWMA, GARCH filter) run in order, one step at a time, and all callers
(batch, continuation, stream) use the same step. Fits evaluate their likelihood by blocks, which is much faster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

from ..contract import GARCH_MAX_PERSISTENCE, GARCH_MIN_SAMPLE, SMALLEST_NORMAL, DomainError

NAN, INF = math.nan, math.inf


def square_if_usable(r: float) -> float:
    """r * r, or NaN where r or its square isn't finite."""
    s = r * r
    return s if s < INF else NAN  # comparison with NaN is false


def ewma(returns: np.ndarray, lam: float, var: float | None = None) -> tuple[np.ndarray, float | None]:
    """Forecasts before each return, and the state after the last (None until a return was usable)."""
    out, rest = np.full(len(returns), NAN), 1 - lam
    for t, r in enumerate(returns.tolist()):
        if var is not None:
            out[t] = math.sqrt(var)
        s = r * r
        if s < INF:
            var = s if var is None else lam * var + rest * r * r
    return out, var


def garch_seed(omega: float, alpha: float, beta: float, backcast: float) -> float:
    """First variance from the variance before the sample (0: the unconditional one)."""
    before = backcast if backcast > 0 else omega / (1 - (alpha + beta))
    return omega + (alpha + beta) * before


def garch_filter(returns: np.ndarray, omega: float, alpha: float, beta: float, s2: float) -> tuple[np.ndarray, float]:
    """Volatility forecasts before each return, and the variance after the last; a missing return counts as s2."""
    out = np.empty(len(returns))
    for t, r in enumerate(returns.tolist()):
        if not s2 < INF:
            raise DomainError("the variance grows over all bounds")
        out[t] = math.sqrt(s2)
        r2 = r * r
        if not r2 < INF:
            r2 = s2
        s2 = omega + alpha * r2 + beta * s2
    if not s2 < INF:
        raise DomainError("the variance grows over all bounds")
    return out, s2


def garch_forecast(omega: float, alpha: float, beta: float, s2: float, horizon: int) -> np.ndarray:
    """Volatility of each of the next periods."""
    if not 0 < s2 < INF:
        raise DomainError("no forecast without a current variance")
    p = alpha + beta
    u = omega / (1 - p)
    steps = u + np.cumprod(np.concatenate(([1.0], np.full(max(horizon - 1, 0), p))))[:horizon] * (s2 - u)
    if not np.isfinite(steps).all():
        raise DomainError("the forecast is not finite")
    return np.sqrt(steps)


def parts(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Views of so many elements at most, in order."""
    return (x[i : i + size] for i in range(0, len(x), size))


class Likelihood:
    """Gaussian negative log-likelihood of GARCH(1,1) on finite returns, without its constant.

    The variance is a first-order linear recurrence in beta. Within blocks of SIDE it is a product with the lower
    triangular matrix of powers of beta; the values at block ends are a recurrence of the same form. PART returns are
    evaluated at a time, so that a long series needs little memory besides the returns themselves.
    """

    SIDE, PART = 64, 2**18

    def __init__(self, returns: np.ndarray, backcast: float):
        self.returns = returns
        self.backcast = backcast
        i = np.arange(self.SIDE)
        self.gap = i[:, None] - i[None, :]

    def scan(self, u: np.ndarray, beta: float, first: float) -> np.ndarray:
        """y[0] = first, y[t] = beta * y[t-1] + u[t] for t >= 1 (u[0] is not read)."""
        n, k = len(u), self.SIDE
        x = u.copy()
        x[0] = first
        if n <= k:
            m = np.where(self.gap[:n, :n] >= 0, beta ** np.maximum(self.gap[:n, :n], 0).astype(float), 0.0)
            return m @ x
        blocks = -(-n // k)
        pad = np.zeros(blocks * k)
        pad[:n] = x
        m = np.where(self.gap >= 0, beta ** np.maximum(self.gap, 0).astype(float), 0.0)
        y = pad.reshape(blocks, k) @ m.T
        ends = self.scan(y[:, -1].copy(), beta**k, y[0, -1])
        y[1:] += ends[:-1, None] * beta ** np.arange(1, k + 1)[None, :]
        return y.reshape(-1)[:n]

    def __call__(self, p: np.ndarray) -> float:
        omega, alpha, beta = float(p[0]), float(p[1]), float(p[2])
        if not (0 < omega < INF and alpha >= 0 and beta >= 0 and alpha + beta < GARCH_MAX_PERSISTENCE):
            return INF
        out, first = 0.0, garch_seed(omega, alpha, beta, self.backcast)
        with np.errstate(all="ignore"):
            for x in parts(self.returns, self.PART):
                r2 = x * x
                u = np.empty_like(r2)
                u[1:] = omega + alpha * r2[:-1]
                s2 = self.scan(u, beta, first)
                out += 0.5 * float((np.log(s2) + r2 / s2).sum())
                first = omega + alpha * float(r2[-1]) + beta * float(s2[-1])
        return out if out < INF else INF


def simplex_search(f: Callable[[np.ndarray], float], start: np.ndarray, scale: np.ndarray, limit: int = 2000) -> tuple[np.ndarray, float, bool]:
    """Minimum of f by the Nelder-Mead simplex (reflection 1, expansion 2, contraction and shrinking 1/2).

    It stops when the simplex is within 1e-10 (in units of ``scale``) and its values within 1e-12 of the best.
    """
    d = len(start)
    points = np.tile(start, (d + 1, 1))
    for i in range(d):
        points[i + 1, i] += 0.1 * start[i] if start[i] else 1e-6
    values = np.array([f(p) for p in points])
    for _ in range(limit):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        wide = (np.abs(points[1:] - points[0]) / scale).max()
        if wide <= 1e-10 and values[-1] - values[0] <= 1e-12 * (abs(values[0]) + 1):
            return points[0], float(values[0]), True
        centre = points[:-1].mean(axis=0)
        away = centre - points[-1]
        x = centre + away
        fx = f(x)
        if fx < values[0]:
            far = centre + 2 * away
            ff = f(far)
            x, fx = (far, ff) if ff < fx else (x, fx)
        elif fx >= values[-2]:
            near = centre + 0.5 * away if fx < values[-1] else centre - 0.5 * away
            fn = f(near)
            if fn < min(fx, values[-1]):
                x, fx = near, fn
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = x, fx
    best = int(np.argmin(values))
    return points[best], float(values[best]), False


#: Starting grid of the fit, and from which beta on a start counts as persistent.
GRID_ALPHA, GRID_BETA, PERSISTENT = (0.02, 0.05, 0.10, 0.15), (0.0, 0.5, 0.80, 0.88, 0.94), 0.8


def garch_fit(returns: np.ndarray) -> dict:
    """Maximum likelihood GARCH(1,1): the best of four searches, three from persistent starts and one from others."""
    x = np.asarray(returns, float)
    if len(x) < GARCH_MIN_SAMPLE:
        raise ValueError(f"a fit needs at least {GARCH_MIN_SAMPLE} returns")
    if not np.isfinite(x).all():
        raise ValueError("a fit needs finite returns")
    with np.errstate(over="ignore"):
        squares = [float((p * p).mean()) * (len(p) / len(x)) for p in parts(x, Likelihood.PART)]
    backcast = sum(squares)
    if not SMALLEST_NORMAL <= backcast < INF:
        raise DomainError("the returns have no usable variance")
    f, scale = Likelihood(x, backcast), np.array([backcast, 1.0, 1.0])
    grid = [np.array([backcast * (1 - a - b), a, b]) for a in GRID_ALPHA for b in GRID_BETA]
    scored = sorted(((f(p), i) for i, p in enumerate(grid)), key=lambda v: v[0])
    high, low = ([i for v, i in scored if v < INF and (grid[i][2] >= PERSISTENT) == want] for want in (True, False))
    found: tuple[float, np.ndarray, bool] | None = None
    for i in high[:3] + low[:1]:
        p, v, done = simplex_search(f, grid[i], scale)
        for _ in range(3):
            q, w, again = simplex_search(f, p, scale)
            better = v - w
            if w <= v:
                p, v, done = q, w, again
            if better <= 1e-9 * (abs(v) + 1):
                break
        if found is None or v < found[0]:
            found = (v, p, done)
    if found is None:
        raise DomainError("no start has a finite likelihood")
    v, (omega, alpha, beta), done = found
    omega, alpha, beta = float(omega), float(alpha), float(beta)
    s2 = garch_seed(omega, alpha, beta, backcast)
    for p in parts(x, Likelihood.PART):
        _, s2 = garch_filter(p, omega, alpha, beta, s2)
    return {"omega": omega, "alpha": alpha, "beta": beta, "sigma2_next": s2, "loglik": -v, "converged": bool(done), "backcast": backcast}


class RidgeState(NamedTuple):
    """All that a least-squares fit needs of rows [x | y]: how many, one of them as their level, the means of their offsets from it,
    and a triangular factor of the centred rows (or these themselves, where they are no more)."""

    n: int
    level: np.ndarray
    mean: np.ndarray
    r: np.ndarray


def _factor(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r") if len(a) > a.shape[1] else a


def ridge_state(a: np.ndarray) -> RidgeState:
    """The state of finite rows [x | y], one at least."""
    with np.errstate(all="ignore"):
        off = a - a[0]  # offsets first: a large level costs no digits
        mean = off.mean(axis=0)
        return RidgeState(len(a), a[0].copy(), mean, _factor(off - mean))


def ridge_merge(s: RidgeState, t: RidgeState) -> RidgeState:
    """The state of the rows of both: their factors, and a row for what their means differ by."""
    n = s.n + t.n
    with np.errstate(all="ignore"):
        gap = (t.level - s.level) + (t.mean - s.mean)
        return RidgeState(n, s.level, s.mean + gap * (t.n / n), _factor(np.vstack([s.r, t.r, math.sqrt(s.n / n * t.n) * gap])))


def ridge_solve(r: np.ndarray, ridge: float, n: int) -> np.ndarray:
    """Coefficients from the stacked triangular factors of centred [x | y] with n rows in all."""
    d = r.shape[1] - 1
    if ridge > 0:
        r = np.vstack([r, np.column_stack([math.sqrt(ridge) * np.eye(d), np.zeros(d)])])
    with np.errstate(all="ignore"):
        if not np.isfinite((r * r).sum(axis=0)).all():
            raise DomainError("the design overflows")
    r = np.linalg.qr(r, mode="r")
    rows = n + (d if ridge > 0 else 0)
    diagonal = np.abs(np.diag(r)[:d])
    if len(r) < d or len(diagonal) < d or (diagonal <= diagonal.max() * rows * np.finfo(float).eps).any():
        raise DomainError("the columns are not independent")
    w = np.zeros(d)
    for i in range(d - 1, -1, -1):
        w[i] = (r[i, d] - r[i, i + 1 : d] @ w[i + 1 :]) / r[i, i]
    if not np.isfinite(w).all():
        raise DomainError("the coefficients are not finite")
    return w


def ridge_finish(s: RidgeState, ridge: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a ridge regression whose intercept is not penalized."""
    d = len(s.level) - 1
    if ridge == 0 and s.n <= d:
        raise DomainError("too few rows for a fit without ridge")
    with np.errstate(all="ignore"):
        w = ridge_solve(s.r, ridge, s.n)
        at = s.level + s.mean
        b = float(at[d] - (at[:d] * w).sum())
    if not math.isfinite(b):
        raise DomainError("the intercept is not finite")
    return w, b


def ridge_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """The ridge regression of rows held at once."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(x) or not x.shape[1]:
        raise ValueError("a fit needs rows and columns")
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("a fit needs finite values")
    return ridge_finish(ridge_state(np.column_stack([x, y])), ridge)


def kelly(returns: np.ndarray, fraction: float) -> float:
    """fraction * mean / sample variance."""
    if len(returns) < 2 or not np.isfinite(returns).all():
        raise ValueError("at least two returns, all finite")
    m = returns.mean()
    v = ((returns - m) ** 2).sum() / (len(returns) - 1)
    if not 0 < v < INF or not math.isfinite(fraction * m / v):
        raise DomainError("the returns have no usable variance")
    return float(fraction * m / v)
