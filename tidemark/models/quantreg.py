"""Joint, non-crossing, penalised quantile regression by a primal-dual interior point method.

minimise  sum pinball(y - A theta) + theta' diag(ridge) theta   subject to  G theta >= g
Residuals are split into u - v; the multiplier z of each row lies between tau - 1 and tau.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TAUS = np.array([0.10, 0.25, 0.50, 0.75, 0.90])


@dataclass
class Fit:
    theta: np.ndarray
    objective: float
    gap: float
    status: str


class Dense:
    """Rows A theta and limits G theta of one set of parameters."""

    def __init__(self, A: np.ndarray, G: np.ndarray):
        self.A, self.G = A, G

    def rows(self, theta: np.ndarray) -> np.ndarray:
        return self.A @ theta

    def limits(self, theta: np.ndarray) -> np.ndarray:
        return self.G @ theta

    def back(self, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A' z + G' w."""
        return self.A.T @ z + self.G.T @ w

    def newton(self, E: np.ndarray, W: np.ndarray, H: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The solution of (A' E A + G' W G + H) d = right."""
        M = (self.A * E[:, None]).T @ self.A + (self.G * W[:, None]).T @ self.G + np.diag(H + 1e-12)
        return np.linalg.solve(M, right)


class Arrow:
    """Groups of rows and limits, each on its own parameters and on shared ones, which come last. The Newton matrix has a
    block for each group and a border for the shared ones; blocks are eliminated one by one, so that work grows with the
    number of groups and not with its cube."""

    def __init__(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        """groups: rows on own and shared parameters, limits on own and shared parameters."""
        self.groups, self.own = groups, groups[0][0].shape[1]
        self.row = np.cumsum([0, *(len(g[0]) for g in groups)])
        self.limit = np.cumsum([0, *(len(g[2]) for g in groups)])

    def _parts(self, theta: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        n = len(self.groups) * self.own
        return list(theta[:n].reshape(-1, self.own)), theta[n:]

    def rows(self, theta: np.ndarray) -> np.ndarray:
        own, shared = self._parts(theta)
        return np.concatenate([g[0] @ t + g[1] @ shared for g, t in zip(self.groups, own, strict=True)])

    def limits(self, theta: np.ndarray) -> np.ndarray:
        own, shared = self._parts(theta)
        return np.concatenate([g[2] @ t + g[3] @ shared for g, t in zip(self.groups, own, strict=True)])

    def _each(self, z: np.ndarray, w: np.ndarray):
        for k, g in enumerate(self.groups):
            yield g, z[self.row[k] : self.row[k + 1]], w[self.limit[k] : self.limit[k + 1]]

    def back(self, z: np.ndarray, w: np.ndarray) -> np.ndarray:
        parts = [(g[0].T @ zk + g[2].T @ wk, g[1].T @ zk + g[3].T @ wk) for g, zk, wk in self._each(z, w)]
        return np.concatenate([*(own for own, _ in parts), sum(shared for _, shared in parts)])

    def newton(self, E: np.ndarray, W: np.ndarray, H: np.ndarray, right: np.ndarray) -> np.ndarray:
        own, shared = self._parts(right)
        h, h_shared = self._parts(H)
        S, kept = np.diag(h_shared + 1e-12), []
        shared = shared.copy()
        for (A, B, G, K), (e, w), hk, rk in zip(self.groups, ((e, w) for _, e, w in self._each(E, W)), h, own, strict=True):
            A_, G_ = A * e[:, None], G * w[:, None]
            block = np.linalg.cholesky(A_.T @ A + G_.T @ G + np.diag(hk + 1e-12))
            border = np.linalg.solve(block, A_.T @ B + G_.T @ K)
            mine = np.linalg.solve(block, rk)
            S = S + (B * e[:, None]).T @ B + (K * w[:, None]).T @ K - border.T @ border
            shared -= border.T @ mine
            kept.append((block, border, mine))
        d = np.linalg.solve(S, shared)
        return np.concatenate([*(np.linalg.solve(block.T, mine - border @ d) for block, border, mine in kept), d])


def solve(A: np.ndarray, y: np.ndarray, tau: np.ndarray, ridge: np.ndarray, G: np.ndarray, g: np.ndarray, theta: np.ndarray, iterations: int = 120, tol: float = 1e-8) -> Fit:
    return interior_point(Dense(A, G), y, tau, ridge, g, theta, iterations, tol)


def interior_point(design: Dense | Arrow, y: np.ndarray, tau: np.ndarray, ridge: np.ndarray, g: np.ndarray, theta: np.ndarray, iterations: int = 120, tol: float = 1e-8) -> Fit:
    H = 2 * ridge
    r = y - design.rows(theta)
    u, v = np.maximum(r, 0) + 1.0, np.maximum(-r, 0) + 1.0
    z = tau - 0.5
    s, w = np.maximum(design.limits(theta) - g, 1.0), np.ones(len(g))
    n = 2 * len(y) + len(g)
    gap = np.inf
    for _ in range(iterations):
        a, b = tau - z, 1 - tau + z
        gap = float(u @ a + v @ b + s @ w)
        r1 = design.back(z, w) - H * theta
        r = y - design.rows(theta)
        r2 = r - u + v
        r3 = g + s - design.limits(theta)
        residual = max(np.abs(r1).max(initial=0), np.abs(r2).max(initial=0), np.abs(r3).max(initial=0))
        objective = float(np.maximum(tau * r, (tau - 1) * r).sum() + (ridge * theta) @ theta)
        if gap <= tol * (1 + abs(objective)) and residual <= 1e-7:
            return Fit(theta, objective, gap, "ok")
        mu = 0.1 * gap / n
        E = 1 / (u / a + v / b)
        q = r2 - mu / a + u + mu / b - v
        W = w / s
        d = design.newton(E, W, H, r1 + design.back(E * q, (mu - s * w) / s + W * r3))
        dz = E * (q - design.rows(d))
        du, dv = (mu - u * a + u * dz) / a, (mu - v * b - v * dz) / b
        ds = design.limits(d) - r3
        dw = (mu - s * w) / s - W * ds
        t = 1.0
        for x, dx in ((u, du), (v, dv), (s, ds), (w, dw), (a, -dz), (b, dz)):
            down = dx < 0
            if down.any():
                t = min(t, float(0.995 * np.min(-x[down] / dx[down])))
        theta, u, v, s, w, z = theta + t * d, u + t * du, v + t * dv, s + t * ds, w + t * dw, z + t * dz
    r = y - design.rows(theta)
    return Fit(theta, float(np.maximum(tau * r, (tau - 1) * r).sum() + (ridge * theta) @ theta), gap, "inaccurate")


def stacked(X: np.ndarray, y: np.ndarray, penalised: np.ndarray, alpha: float, min_gap: float) -> tuple:
    """One block of parameters for each level; rows of X must be apart by min_gap from level to level."""
    n, p = X.shape
    k = len(TAUS)
    A = np.kron(np.eye(k), X)
    G = np.kron(np.eye(k - 1, k, 1) - np.eye(k - 1, k), X)
    theta = np.zeros((k, p))
    theta[:, 0] = np.quantile(y, TAUS) if len(y) else 0
    return A, np.tile(y, k), np.repeat(TAUS, n), np.tile(alpha * penalised, k), G, np.full(n * (k - 1), min_gap), theta.ravel()


def fit_linear(x: np.ndarray, pi: np.ndarray, y: np.ndarray, alpha: float = 1e-2, min_gap: float = 1e-4) -> tuple[np.ndarray, Fit]:
    """Coefficients (level x [intercept, features, state probabilities]). The intercept is not penalised."""
    if not (np.isfinite(x).all() and np.isfinite(pi).all() and np.isfinite(y).all()):
        raise ValueError("inputs must be finite")
    X = np.column_stack([np.ones(len(y)), x, pi])
    out = solve(*stacked(X, y, np.r_[0.0, np.ones(X.shape[1] - 1)], alpha, min_gap))
    return out.theta.reshape(len(TAUS), -1), out


def panel_design(groups: np.ndarray, shared: np.ndarray, n_groups: int) -> np.ndarray:
    """[own intercepts, shared coefficients, each group's deviations from them]."""
    own = np.eye(n_groups)[groups]
    return np.column_stack([own, shared] + [shared * own[:, [a]] for a in range(n_groups)])


def fit_panel(groups: np.ndarray, x: np.ndarray, y: np.ndarray, n_groups: int, alpha: float = 1e-2, delta: float = 1e-1, min_gap: float = 1e-4) -> tuple[np.ndarray, Fit]:
    """Partial pooling: deviations from the shared coefficients are penalised by delta."""
    X = panel_design(groups, x, n_groups)
    weights = np.r_[np.zeros(n_groups), np.full(x.shape[1], alpha), np.full(x.shape[1] * n_groups, delta)]
    A, yy, tau, ridge, G, g, theta = stacked(X, y, weights, 1.0, min_gap)
    theta = theta.reshape(len(TAUS), -1)
    theta[:, :n_groups] = np.quantile(y, TAUS)[:, None]
    out = solve(A, yy, tau, ridge, G, g, theta.ravel())
    return out.theta.reshape(len(TAUS), -1), out


def fit_panel_or_each(groups: np.ndarray, x: np.ndarray, y: np.ndarray, n_groups: int) -> tuple[np.ndarray, str]:
    """The joint fit, or else each group by itself on the same design."""
    try:
        theta, out = fit_panel(groups, x, y, n_groups)
        if out.status == "ok":
            return theta, "joint"
    except np.linalg.LinAlgError:
        pass
    p = x.shape[1]
    theta = np.zeros((len(TAUS), n_groups * (p + 1) + p))
    for a in range(n_groups):
        own = groups == a
        coef, _ = fit_linear(x[own], np.zeros((own.sum(), 0)), y[own])
        theta[:, a] = coef[:, 0]
        theta[:, n_groups + p + a * p : n_groups + p + (a + 1) * p] = coef[:, 1:]
    return theta, "independent"


def fit_spreads(macro: np.ndarray, micro: np.ndarray, y: np.ndarray, alpha: float = 1e-2, min_spread: float = 1e-4) -> tuple[np.ndarray, Fit]:
    """Median from macro and micro features; four non-negative spreads around it from micro features only."""
    n, p, q = len(y), macro.shape[1], micro.shape[1]
    one = np.ones((n, 1))
    centre, spread = np.column_stack([one, macro, micro]), np.column_stack([one, micro])
    c, m = centre.shape[1], spread.shape[1]
    # spreads: 50-25, 25-10 below; 75-50, 90-75 above
    use = {0: (-1, -1, 0, 0), 1: (-1, 0, 0, 0), 2: (0, 0, 0, 0), 3: (0, 0, 1, 0), 4: (0, 0, 1, 1)}
    A = np.vstack([np.column_stack([centre] + [f * spread for f in use[k]]) for k in range(5)])
    G = np.vstack([np.column_stack([np.zeros((n, c))] + [spread * (i == j) for j in range(4)]) for i in range(4)])
    ridge = np.r_[0.0, np.full(p + q, alpha), np.tile(np.r_[0.0, np.full(q, alpha)], 4)]
    theta = np.zeros(c + 4 * m)
    quant = np.quantile(y, TAUS)
    theta[0] = quant[2]
    theta[c], theta[c + m], theta[c + 2 * m], theta[c + 3 * m] = quant[2] - quant[1], quant[1] - quant[0], quant[3] - quant[2], quant[4] - quant[3]
    out = solve(A, np.tile(y, 5), np.repeat(TAUS, n), ridge, G, np.full(4 * n, min_spread), theta)
    return out.theta, out
