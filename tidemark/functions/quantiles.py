"""Column expressions over a distribution's quantiles at fixed levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import Col, c

TAUS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
CORE = [0.10, 0.25, 0.50, 0.75, 0.90]


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def pinball(y: Col, q: list[Col], taus: list[float] = TAUS) -> Column:
    """Twice the mean pinball loss."""
    y = c(y)
    return 2 * total([F.greatest(t * (y - c(x)), (t - 1) * (y - c(x))) for t, x in zip(taus, q, strict=True)]) / len(taus)


def extrapolated(q10: Col, q25: Col, q75: Col, q90: Col, k: float = 0.6) -> tuple[Column, Column]:
    q10, q25, q75, q90 = map(c, (q10, q25, q75, q90))
    return q10 - k * (q25 - q10), q90 + k * (q90 - q75)


def is_monotone(q: list[Col]) -> Column:
    return reduce(lambda a, b: a & b, [c(x) <= c(y) for x, y in zip(q, q[1:], strict=False)])


def rearranged(q: Column, gap: float = 1e-4) -> Column:
    """Sorted, then pushed up to keep a least gap from left to right."""
    first = F.array_sort(q)
    step = lambda acc, x: F.concat(acc, F.array(F.greatest(x, F.element_at(acc, -1) + gap)))
    return F.aggregate(F.slice(first, 2, F.size(first) - 1), F.slice(first, 1, 1), step)


def running_max(q: Column) -> Column:
    step = lambda acc, x: F.concat(acc, F.array(F.greatest(x, F.element_at(acc, -1))))
    return F.aggregate(F.slice(q, 2, F.size(q) - 1), F.slice(q, 1, 1), step)


def mean(q: list[Col], taus: list[float] = TAUS) -> Column:
    """Of the piecewise linear quantile curve, over its own probability mass."""
    return total([(b - a) * (c(x) + c(y)) / 2 for a, b, x, y in zip(taus, taus[1:], q, q[1:], strict=False)]) / (taus[-1] - taus[0])


def second_moment(q: list[Col], taus: list[float] = TAUS) -> Column:
    return total([(b - a) * (c(x) * c(x) + c(x) * c(y) + c(y) * c(y)) / 3 for a, b, x, y in zip(taus, taus[1:], q, q[1:], strict=False)]) / (taus[-1] - taus[0])


def deviation(q: list[Col], taus: list[float] = TAUS) -> Column:
    m = mean(q, taus)
    return F.sqrt(F.greatest(F.lit(0.0), second_moment(q, taus) - m * m))


def loss_probability(q: list[Col], taus: list[float] = TAUS) -> Column:
    """The curve's level at zero; 0 or 1 beyond its ends."""
    first, last = c(q[0]), c(q[-1])
    out = F.when(first >= 0, 0.0).when(last < 0, 1.0)
    for a, b, x, y in zip(taus, taus[1:], q, q[1:], strict=False):
        x, y = c(x), c(y)
        out = out.when((x <= 0) & (y >= 0), F.when(y > x, a + (b - a) * (-x) / (y - x)).otherwise(F.lit(a)))
    return out


def shortfall(q: list[Col], taus: list[float] = TAUS, upto: float = 0.20) -> Column:
    """Minus the mean of the curve up to a level, over the mass that the curve has there."""
    parts = []
    for a, b, x, y in zip(taus, taus[1:], q, q[1:], strict=False):
        if a >= upto:
            break
        end = min(b, upto)
        at_end = c(x) + (c(y) - c(x)) * ((end - a) / (b - a))
        parts.append((end - a) * (c(x) + at_end) / 2)
    return -total(parts) / (min(upto, taus[-1]) - taus[0])


def interpolated_rank(x: Col, sorted_values: Column) -> Column:
    """Where x lies in sorted values: 0 up to the first, 1 from the last, linear between; a half if anything is missing."""
    x, v = c(x), sorted_values
    n = F.size(v)
    below = F.size(F.filter(v, lambda a: a <= x))
    lo, hi = F.get(v, below - 1), F.get(v, below)
    inner = (below - 1 + F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)) / (n - 1)
    return F.when(x.isNull() | F.isnan(x) | (n == 0), 0.5).when(x <= F.get(v, F.lit(0)), 0.0).when(x >= F.element_at(v, -1), 1.0).otherwise(inner)


def remapped(x: Col, source: list[float], target: list[float]) -> Column:
    """Three-point piecewise map, extended linearly at both ends."""
    x = c(x)
    s0, s1, s2 = source
    t0, t1, t2 = target
    low = t1 + (x - s1) * ((t1 - t0) / (s1 - s0))
    return F.when(x <= s1, low).otherwise(t1 + (x - s1) * ((t2 - t1) / (s2 - s1)))
