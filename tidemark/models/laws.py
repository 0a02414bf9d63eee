"""Four direct laws of an outcome given features: density, quantiles, decoupled heads, two states.

Rows of X start with a 1. Each law gives a location, a scale and the quantiles at TAUS for the rows `at`.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

from tidemark.models.numerics import t_logpdf, t_ppf
from tidemark.models.quantreg import TAUS, Dense, interior_point

# Penalty of slopes, least scale, degrees of freedom tried, rows that a state needs.
ALPHA, LEAST, FREEDOMS, STATE_ROWS = 1.0, 1e-4, (5.0, 8.0, 12.0, 30.0), 20
NORMAL = np.array([NormalDist().inv_cdf(float(t)) for t in TAUS])


def ridge(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    penalty = ALPHA * np.eye(X.shape[1])
    penalty[0, 0] = 0
    return np.linalg.solve(X.T @ X + penalty, X.T @ y)


def normal_law(mu: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return mu, sigma, mu[:, None] + sigma[:, None] * NORMAL


def density(X: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Location and log scale by ridge, a t law of that standard deviation with the likeliest degrees of freedom."""
    centre = ridge(X, y)
    rest = y - X @ centre
    spread = ridge(X, np.log(np.maximum(np.abs(rest), max(0.05 * rest.std(), LEAST))))
    z = rest / np.maximum(np.exp(X @ spread), LEAST)
    unit = lambda df: np.sqrt((df - 2) / df)
    df = max(FREEDOMS, key=lambda d: float(t_logpdf(z / unit(d), d).sum()))
    mu, sigma = at @ centre, np.maximum(np.exp(at @ spread), LEAST)
    return mu, sigma, mu[:, None] + sigma[:, None] * unit(df) * np.array([t_ppf(float(t), df) for t in TAUS])


def quantile(X: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A linear quantile for each level by itself; the running maximum over levels is the forecast."""
    weight = np.r_[0.0, np.full(X.shape[1] - 1, ALPHA / 2)]
    beta = []
    for tau in TAUS:
        start = np.r_[np.quantile(y, tau), np.zeros(X.shape[1] - 1)]
        beta.append(interior_point(Dense(X, np.zeros((0, X.shape[1]))), y, np.full(len(y), tau), weight, np.zeros(0), start).theta)
    q = np.maximum.accumulate(at @ np.array(beta).T, axis=1)
    return q[:, 2], np.maximum((np.maximum(q[:, 3] - q[:, 1], LEAST)) / (NORMAL[3] - NORMAL[1]), LEAST), q


def ranks(y: np.ndarray) -> np.ndarray:
    """From 1, equal values with their mean rank."""
    _, back, n = np.unique(y, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[back]


def heads(X: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Direction from the outcomes' normal scores, scale from their distance to the median, fitted apart."""
    share = np.clip((ranks(y) - 0.5) / len(y), 0.01, 0.99)
    score = ridge(X, np.array([NormalDist().inv_cdf(float(s)) for s in share]))
    spread = ridge(X, np.log(np.maximum(np.abs(y - np.median(y)), LEAST)))
    sigma = np.maximum(np.exp(at @ spread), LEAST)
    return normal_law(np.median(y) + np.tanh(at @ score) * sigma, sigma)


def two_states(X: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of the training rows on the same side of the last feature's median; of all where these are few."""
    middle = np.median(X[:, -1])
    high = X[:, -1] > middle
    of = {s: y[high == s] if (high == s).sum() >= STATE_ROWS else y for s in (False, True)}
    now = at[:, -1] > middle
    return normal_law(np.array([of[bool(s)].mean() for s in now]), np.array([max(of[bool(s)].std(), LEAST) for s in now]))


LAWS = {"density": density, "quantile": quantile, "heads": heads, "two_state": two_states}
