"""Location-scale laws and volatility models: Student-t law, HAR sigma, GARCH family, tail likelihoods."""

from __future__ import annotations

import numpy as np

from tidemark.models.numerics import nelder_mead, powell, t_logpdf, t_ppf

NU = 5.0
TAUS = np.array([0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95])


def student_quantiles(mu: np.ndarray, sigma: np.ndarray, nu: float = NU) -> np.ndarray:
    """Row x level; never decreasing in the level."""
    z = np.array([t_ppf(float(t), nu) for t in TAUS])
    return np.maximum.accumulate(mu[:, None] + sigma[:, None] * z, axis=1)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float, intercept: bool = True) -> np.ndarray:
    """The intercept is not penalised."""
    X = np.column_stack([np.ones(len(y)), x]) if intercept else x
    penalty = alpha * np.eye(X.shape[1])
    if intercept:
        penalty[0, 0] = 0
    return np.linalg.solve(X.T @ X + penalty, X.T @ y)


def fit_student(x: np.ndarray, pi: np.ndarray, y: np.ndarray, theta0: np.ndarray | None = None, iterations: int = 80) -> tuple[np.ndarray, float, str]:
    """(theta, objective, status): pinball loss of the law's quantiles plus a penalty on its coverage, which jumps. Direction
    sets and a simplex take turns, either first, in three growing budgets; the better of both counts."""
    mu_x = np.column_stack([np.ones(len(y)), x, pi[:, :-1]])
    sd_x = np.column_stack([np.ones(len(y)), pi[:, :-1]])
    k = mu_x.shape[1]
    if theta0 is None:
        first = ridge(mu_x, y, 1e-3, intercept=False)
        theta0 = np.concatenate([first, ridge(sd_x, np.log(np.maximum(np.abs(y - mu_x @ first), 1e-3)), 1e-3, intercept=False)])

    def objective(theta: np.ndarray) -> float:
        q = student_table(mu_x @ theta[:k], np.exp(np.clip(sd_x @ theta[k:], -8, 3)))
        e = y[:, None] - q
        loss = 2 * np.maximum(TAUS * e, (TAUS - 1) * e).mean()
        hit = (y[:, None] <= q).mean(axis=0)
        return float(loss + 0.1 * (abs(hit[1] - 0.1) + abs(hit[5] - 0.9)))

    z = np.array([t_ppf(float(t), NU) for t in TAUS])

    def student_table(mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
        return mu[:, None] + sd[:, None] * z

    def simplex(theta: np.ndarray, budget: int) -> tuple[np.ndarray, float, bool]:
        return nelder_mead(objective, theta, 0.05, budget, 1e-6)

    def lines(theta: np.ndarray, budget: int) -> tuple[np.ndarray, float, bool]:
        return powell(objective, theta, 0.1, budget, 1e-6)

    theta, value, ok = theta0, objective(theta0), False
    for budget in (iterations, 2 * iterations, 4 * iterations):
        chains = []
        for one, other in ((lines, simplex), (simplex, lines)):
            at, before, _ = one(theta, budget)
            after, reached, done = other(at, budget)
            chains.append((reached, after, done) if reached <= before else (before, at, done))
        value, theta, ok = min(chains, key=lambda c: c[0])
        if ok:
            break
    return theta, value, "ok" if ok else "budget"


def har_sigma(r: np.ndarray, iv: np.ndarray) -> np.ndarray:
    """log sigma of the next day from averages of |r| over 1, 5 and 22 days and an implied volatility: coefficients."""
    a = np.abs(r)
    mean = lambda n: np.convolve(a, np.ones(n) / n)[n - 1 : len(a)]
    rows = np.column_stack([np.log(a[21:-1] + 1e-4), np.log(mean(5)[17:-1] + 1e-4), np.log(mean(22)[:-1] + 1e-4), np.log(np.maximum(iv[21:-1], 1e-4))])
    return ridge(rows, np.log(a[22:] + 1e-4), 1e-6)


def garch_path(theta: np.ndarray, r: np.ndarray, kind: str) -> np.ndarray:
    """Conditional variances; the last one is the forecast for the next row."""
    out = np.empty(len(r) + 1)
    out[0] = r.var() + 1e-12
    if kind == "egarch":
        w, a, g, b = theta[:4]
        log = np.log(out[0])
        for t, x in enumerate(r):
            z = x / np.exp(log / 2)
            log = np.clip(w + b * log + a * (abs(z) - 0.7978845608) + g * z, -30, 10)
            out[t + 1] = np.exp(log)
        return out
    w, a, g, b = np.exp(theta[0]), *(1 / (1 + np.exp(-theta[1:4])))
    for t, x in enumerate(r):
        out[t + 1] = w + (0.3 * a + 0.3 * g * (x < 0)) * x * x + 0.98 * b * out[t]
    return out


def fit_garch(r: np.ndarray, kind: str, law: str) -> tuple[np.ndarray, float, float]:
    """(theta, negative log likelihood, one-step sigma). kind: egarch or gjr; law: normal or t."""
    var = np.log(r.var() + 1e-12)
    start = np.array([0.1 * var, 0.1, -0.05, 0.9]) if kind == "egarch" else np.array([var - 3, -1.0, -1.0, 2.0])
    start = np.append(start, np.log(6.0)) if law == "t" else start

    def loss(theta: np.ndarray) -> float:
        if kind == "egarch" and abs(theta[3]) >= 0.9999:
            return 1e12
        s = np.sqrt(np.maximum(garch_path(theta, r, kind)[:-1], 1e-12))
        z = r / s
        log = t_logpdf(z, 2.05 + np.exp(min(theta[4], 5))) if law == "t" else -0.5 * (z * z + np.log(2 * np.pi))
        return float(-(log - np.log(s)).sum())

    theta, value, _ = nelder_mead(loss, start, 0.1, 60, 1e-7)
    return theta, value, float(np.sqrt(garch_path(theta, r, kind)[-1]))


def fit_tail(z: np.ndarray) -> tuple[float, float]:
    """(scale k, degrees of freedom) of a variance-one t law for z / k, by likelihood; degrees of freedom up to 100."""
    def loss(p: np.ndarray) -> float:
        k, nu = np.exp(p[0]), min(100.0, 2.05 + np.exp(p[1]))
        return float(-(t_logpdf(z / k, nu) - np.log(k)).sum())

    best, _, _ = nelder_mead(loss, np.array([np.log(z.std() + 1e-9), 1.5]), 0.2, 200, 1e-9)
    return float(np.exp(best[0])), float(min(100.0, 2.05 + np.exp(best[1])))
