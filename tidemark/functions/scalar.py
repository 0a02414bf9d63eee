"""Row-wise column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Col) -> Column:
    """NaN and infinities as null, so that no predicate meets them."""
    x = c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ln(x: Col) -> Column:
    x = finite(x)
    return F.when(x > 0, F.ln(x))


def squash(z: Col) -> Column:
    """4 tanh(z / 4), within five."""
    return F.greatest(F.lit(-5.0), F.least(F.lit(5.0), 4 * F.tanh(c(z) / 4)))


def logistic(x: Col) -> Column:
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), c(x)))))
    return F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))


def linear(intercept: Col, *terms: tuple[Col, Col]) -> Column:
    return reduce(lambda s, t: s + c(t[0]) * c(t[1]), terms, c(intercept))


def piecewise(x: Col, knots: list[float], levels: list[float]) -> Column:
    """Linear between knots, constant beyond them."""
    x = c(x)
    out = F.when(x <= knots[0], F.lit(float(levels[0])))
    for a, b, p, q in zip(knots, knots[1:], levels, levels[1:], strict=False):
        out = out.when(x <= b, p + (x - a) * ((q - p) / (b - a)))
    return out.when(x.isNotNull(), F.lit(float(levels[-1])))


def stance(score: Col) -> Column:
    score = c(score)
    return F.when(score <= 35, "DEFENSIVE").when(score >= 65, "OFFENSIVE").otherwise("NEUTRAL")


def guard_mode(rate: Col, blocks: Col) -> Column:
    """Blocked above a fifth missing or from two missing blocks; degraded from a tenth or one."""
    rate, blocks = c(rate), c(blocks)
    return F.when((rate > 0.20) | (blocks >= 2), "BLOCKED").when((rate >= 0.10) | (blocks >= 1), "DEGRADED").otherwise("NORMAL")


def utility(mean: Col, es20: Col, p_loss: Col, risk_weight: float = 1.2, loss_weight: float = 0.8) -> Column:
    return c(mean) - risk_weight * c(es20) - loss_weight * c(p_loss)


def sigma_clip(log_sigma: Col, p10: Col, p99: Col, median_sigma: Col) -> Column:
    """exp of the log, within [p10 - 0.35, p99], at most three medians."""
    return F.least(F.exp(F.greatest(c(p10) - 0.35, F.least(c(p99), c(log_sigma)))), 3 * c(median_sigma))
