"""Quantile laws of a panel: groups with parameters of their own around shared ones.

`Shared` has intercepts by group and level and the same slopes for all groups, on macro features, state probabilities and
micro features. `Spreads` has a median on macro and micro features and four non-negative spreads on micro features, each
with slopes that are shared but for a penalised deviation by group. Both are interior point fits with an arrow structure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.models.quantreg import TAUS, Arrow, Fit, fit_linear, interior_point

#: Which spreads each level adds to the median, and with which sign: outer lower, inner lower, inner upper, outer upper.
USES = np.array([[-1, -1, 0, 0], [0, -1, 0, 0], [0, 0, 0, 0], [0, 0, 1, 0], [0, 0, 1, 1]], float)
LEVELS = len(TAUS)


def _split(groups: np.ndarray, *arrays: np.ndarray) -> list[list[np.ndarray]]:
    return [[a[groups == k] for a in arrays] for k in range(int(groups.max()) + 1)]


@dataclass
class Shared:
    intercepts: np.ndarray  # group x level
    slopes: np.ndarray  # level x [macro, states, micro]; group x level x ... where groups were fitted apart
    status: str
    objective: float

    def predict(self, group: np.ndarray, x: np.ndarray, gap: float = 1e-4) -> np.ndarray:
        slopes = self.slopes[group] if self.slopes.ndim == 3 else np.repeat(self.slopes[None], len(group), axis=0)
        q = np.sort(self.intercepts[group] + np.einsum("nlp,np->nl", slopes, x), axis=1)
        for k in range(1, LEVELS):
            q[:, k] = np.maximum(q[:, k], q[:, k - 1] + gap)
        return q


def fit_shared(groups: np.ndarray, common: np.ndarray, micro: np.ndarray, y: np.ndarray, alpha_common: float = 2.0, alpha_micro: float = 2.0, gap: float = 1e-4) -> Shared:
    """common: macro features and state probabilities. If the joint fit breaks down or is inaccurate, each group has its own."""
    x = np.column_stack([common, micro])
    ridge = np.r_[np.full(common.shape[1], alpha_common), np.full(micro.shape[1], alpha_micro)]
    n = int(groups.max()) + 1
    eye, step = np.eye(LEVELS), np.eye(LEVELS - 1, LEVELS, 1) - np.eye(LEVELS - 1, LEVELS)
    parts = []
    for own, _ in _split(groups, x, y):
        one = np.ones((len(own), 1))
        parts.append((np.kron(eye, one), np.kron(eye, own), np.kron(step, one), np.kron(step, own)))
    theta = np.r_[np.concatenate([np.quantile(t, TAUS) for _, t in _split(groups, x, y)]), np.zeros(LEVELS * x.shape[1])]
    ys = np.concatenate([np.tile(t, LEVELS) for _, t in _split(groups, x, y)])
    taus = np.concatenate([np.repeat(TAUS, len(t)) for _, t in _split(groups, x, y)])
    try:
        fit = interior_point(Arrow(parts), ys, taus, np.r_[np.zeros(n * LEVELS), np.tile(ridge, LEVELS)], np.full(len(y) * (LEVELS - 1), gap), theta)
        if fit.status == "ok":
            return Shared(fit.theta[: n * LEVELS].reshape(n, LEVELS), fit.theta[n * LEVELS :].reshape(LEVELS, -1), "ok", fit.objective)
    except np.linalg.LinAlgError:
        pass
    alone = [fit_linear(own, np.zeros((len(own), 0)), t, float(ridge.mean()), gap) for own, t in _split(groups, x, y)]
    return Shared(np.array([c[:, 0] for c, _ in alone]), np.array([c[:, 1:] for c, _ in alone]), "per_asset_fallback", float(sum(f.objective for _, f in alone)))


@dataclass
class Spreads:
    own: np.ndarray  # group x own parameters
    shared: np.ndarray
    status: str
    objective: float

    def predict(self, group: np.ndarray, macro: np.ndarray, micro: np.ndarray, least: float = 1e-4) -> np.ndarray:
        p, q = macro.shape[1], micro.shape[1]
        x = np.column_stack([macro, micro])
        centre = self.own[group, 0] + ((self.own[group, 1 : 1 + p + q] + self.shared[: p + q]) * x).sum(axis=1)
        apart = self.own[group, 1 + p + q :].reshape(-1, 4, 1 + q)
        slopes = apart[:, :, 1:] + self.shared[p + q :].reshape(4, q)
        width = np.maximum(apart[:, :, 0] + np.einsum("nkq,nq->nk", slopes, micro), least)
        return centre[:, None] + width @ USES.T


def spread_design(macro: np.ndarray, micro: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One group's rows and limits, on own parameters (intercepts and deviations) and on shared slopes."""
    n = len(micro)
    one, x = np.ones((n, 1)), np.column_stack([macro, micro])
    wide = np.column_stack([one, micro])
    rows = [np.column_stack([one, x, *(u * wide for u in use)]) for use in USES]
    shared = [np.column_stack([x, *(u * micro for u in use)]) for use in USES]
    limits = np.column_stack([np.zeros((4 * n, 1 + x.shape[1])), np.kron(np.eye(4), wide)])
    return np.vstack(rows), np.vstack(shared), limits, np.column_stack([np.zeros((4 * n, x.shape[1])), np.kron(np.eye(4), micro)])


def fit_spreads(groups: np.ndarray, macro: np.ndarray, micro: np.ndarray, y: np.ndarray, alpha: float = 2.0, alpha_spread: float = 0.1, delta: float = 0.5, least: float = 1e-4) -> tuple[Spreads, Fit]:
    parts = _split(groups, macro, micro, y)
    p, q = macro.shape[1], micro.shape[1]
    own_ridge = np.r_[0.0, np.full(p + q, delta), np.tile(np.r_[0.0, np.full(q, delta)], 4)]
    first = []
    for _, _, t in parts:
        at = np.quantile(t, TAUS)
        start = np.zeros(len(own_ridge))
        start[0] = at[2]
        start[1 + p + q :: 1 + q] = np.maximum([at[1] - at[0], at[2] - at[1], at[3] - at[2], at[4] - at[3]], least)
        first.append(start)
    ridge = np.r_[np.tile(own_ridge, len(parts)), np.full(p + q, alpha), np.full(4 * q, alpha_spread)]
    ys = np.concatenate([np.tile(t, LEVELS) for *_, t in parts])
    taus = np.concatenate([np.repeat(TAUS, len(t)) for *_, t in parts])
    fit = interior_point(Arrow([spread_design(a, b) for a, b, _ in parts]), ys, taus, ridge, np.full(4 * len(y), least), np.r_[np.concatenate(first), np.zeros(p + 5 * q)])
    n = len(parts) * len(own_ridge)
    return Spreads(fit.theta[:n].reshape(len(parts), -1), fit.theta[n:], fit.status, fit.objective), fit
