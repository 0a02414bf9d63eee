"""Optimisers and distributions without SciPy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Array = np.ndarray


def nelder_mead(f: Callable[[Array], float], x0: Array, scale: float = 0.1, iterations: int = 400, tol: float = 1e-8) -> tuple[Array, float, bool]:
    """(minimum, value, converged). Values that aren't finite count as very large."""
    n = len(x0)

    def value(x: Array) -> float:
        v = f(x)
        return v if np.isfinite(v) else 1e12

    points = np.vstack([x0] + [x0 + np.eye(n)[i] * (scale * abs(x0[i]) + scale) for i in range(n)])
    values = np.array([value(p) for p in points])
    for _ in range(iterations * n):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tol * (abs(values[0]) + tol) and np.abs(points[1:] - points[0]).max() <= math.sqrt(tol):
            return points[0], float(values[0]), True
        centre = points[:-1].mean(axis=0)
        far = centre + (centre - points[-1])
        v = value(far)
        if v < values[0]:
            further = centre + 2 * (centre - points[-1])
            w = value(further)
            points[-1], values[-1] = (further, w) if w < v else (far, v)
        elif v < values[-2]:
            points[-1], values[-1] = far, v
        else:
            near = centre + 0.5 * ((far if v < values[-1] else points[-1]) - centre)
            w = value(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [value(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], float(values[best]), False


GOLD = (math.sqrt(5) - 1) / 2


def along(f: Callable[[Array], float], x: Array, fx: float, d: Array, step: float, tol: float) -> tuple[Array, float]:
    """The best point found on the line through x: a bracket that doubles outwards, then golden sections of it."""
    best = (fx, 0.0)

    def at(t: float) -> float:
        nonlocal best
        v = f(x + t * d)
        v = v if np.isfinite(v) else 1e12
        best = min(best, (v, t))
        return v

    up, down = at(step), at(-step)
    if min(up, down) < fx:
        sign = 1.0 if up <= down else -1.0
        low, middle, v = 0.0, sign * step, min(up, down)
        for _ in range(40):
            high = 2 * middle
            w = at(high)
            if w >= v:
                break
            low, middle, v = middle, high, w
    else:
        low, high = -step, step
    a, b = min(low, high), max(low, high)
    c, e = b - GOLD * (b - a), a + GOLD * (b - a)
    fc, fe = at(c), at(e)
    while b - a > tol * max(1.0, abs(a) + abs(b)):
        if fc <= fe:
            b, e, fe = e, c, fc
            c = b - GOLD * (b - a)
            fc = at(c)
        else:
            a, c, fc = c, e, fe
            e = a + GOLD * (b - a)
            fe = at(e)
    return x + best[1] * d, best[0]


def powell(f: Callable[[Array], float], x0: Array, scale: float = 0.1, iterations: int = 60, tol: float = 1e-6) -> tuple[Array, float, bool]:
    """(minimum, value, converged) by direction sets: lines along each direction in turn, of which the one with the largest
    gain gives way to the whole step where the function still falls along that."""
    x, fx = x0.astype(float), f(x0)
    directions = [d * (scale * abs(v) + scale) for d, v in zip(np.eye(len(x0)), x0, strict=True)]
    for _ in range(iterations):
        start, before, gains = x, fx, []
        for d in directions:
            here = fx
            x, fx = along(f, x, fx, d, 1.0, 1e-3)
            gains.append(here - fx)
        if 2 * (before - fx) <= tol * (abs(before) + abs(fx)) + 1e-12:
            return x, fx, True
        whole = x - start
        k = int(np.argmax(gains))
        ahead = f(x + whole)
        if ahead < before and 2 * (before - 2 * fx + ahead) * (before - fx - gains[k]) ** 2 < gains[k] * (before - ahead) ** 2:
            x, fx = along(f, x, fx, whole, 1.0, 1e-3)
            directions[k] = directions[-1]
            directions[-1] = whole
    return x, fx, False


def newton(f: Callable[[Array], tuple[float, Array, Array]], x0: Array, iterations: int = 50, tol: float = 1e-10) -> Array:
    """Damped Newton steps on a smooth convex function that gives value, gradient and Hessian."""
    x = x0.astype(float)
    value, g, h = f(x)
    for _ in range(iterations):
        step = np.linalg.solve(h + 1e-10 * np.eye(len(x)), g)
        if float(g @ step) < tol:
            break
        t = 1.0
        while True:
            new = f(x - t * step)
            if new[0] <= value - 1e-4 * t * float(g @ step) or t < 1e-8:
                break
            t /= 2
        x, (value, g, h) = x - t * step, new
    return x


def logsumexp(a: Array, axis: int) -> Array:
    m = a.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * beta_inc(nu / 2, 0.5, nu / (nu + x * x))
    return 1 - tail if x > 0 else tail


def t_ppf(p: float, nu: float) -> float:
    lo, hi = -1.0, 1.0
    while t_cdf(lo, nu) > p:
        lo *= 2
    while t_cdf(hi, nu) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, nu) < p else (lo, mid)
    return (lo + hi) / 2


def t_logpdf(z: Array, nu: float, unit_variance: bool = True) -> Array:
    """Of Student's t, by default rescaled to variance one."""
    s = math.sqrt((nu - 2) / nu) if unit_variance else 1.0
    x = z / s
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(s) - (nu + 1) / 2 * np.log1p(x * x / nu)


def isotonic(y: Array, weight: Array | None = None) -> Array:
    """Non-decreasing least squares fit by pooling adjacent violators."""
    w = np.ones(len(y)) if weight is None else weight
    blocks: list[list[float]] = []
    for v, k in zip(y, w, strict=True):
        blocks.append([float(v), float(k), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def isotonic_at(x: Array, fitted: Array, at: Array) -> Array:
    """Step function: the fit of the last knot not above each point, the first one's below all."""
    return fitted[np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 1)]
