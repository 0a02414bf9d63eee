"""Three latent states with Gaussian emissions and hazards that depend on dwell time and a covariate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.models.numerics import logsumexp, newton
from tidemark.models.pca import shrunk_covariance

STATES = 3
LABELS = ("DEFENSIVE", "NEUTRAL", "OFFENSIVE")


@dataclass
class Hmm:
    initial: np.ndarray
    hazard: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float = -np.inf


def log_emissions(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, k] = -0.5 * (z**2).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def leaving(hazard: np.ndarray, dwell: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Probability of leaving each state, by week. dwell: week x state."""
    logit = np.clip(hazard[:, 0] + hazard[:, 1] * dwell + hazard[:, 2] * h[:, None], -50, 50)
    return np.clip(1 / (1 + np.exp(-logit)), 1e-12, 1 - 1e-12)


def log_transitions(hazard: np.ndarray, dwell: np.ndarray, h: np.ndarray) -> np.ndarray:
    """week x from x to; what leaves a state is split evenly over the others."""
    p = leaving(hazard, dwell, h)
    out = np.repeat(np.log(p / (STATES - 1))[:, :, None], STATES, axis=2)
    k = np.arange(STATES)
    out[:, k, k] = np.log1p(-p)
    return out


def filtered(log_initial: np.ndarray, log_trans: np.ndarray, log_emit: np.ndarray) -> np.ndarray:
    """log p(state at t, observations up to t). log_trans[t] leads from t to t + 1."""
    out = np.empty_like(log_emit)
    out[0] = log_initial + log_emit[0]
    for t in range(1, len(log_emit)):
        out[t] = logsumexp(out[t - 1][:, None] + log_trans[t - 1], 0) + log_emit[t]
    return out


def smoothed(log_alpha: np.ndarray, log_trans: np.ndarray, log_emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of states, and of pairs of successive states."""
    beta = np.zeros_like(log_emit)
    for t in range(len(log_emit) - 2, -1, -1):
        beta[t] = logsumexp(log_trans[t] + (log_emit[t + 1] + beta[t + 1])[None, :], 1)
    total = logsumexp(log_alpha[-1], 0)
    pairs = np.exp(log_alpha[:-1, :, None] + log_trans[: len(log_emit) - 1] + (log_emit[1:] + beta[1:])[:, None, :] - total)
    return np.exp(log_alpha + beta - total), pairs


def dwell_path(states: np.ndarray) -> np.ndarray:
    """Rows so far in the current run of each state; at least 1."""
    out = np.ones((len(states), STATES))
    run = 0
    for t, s in enumerate(states):
        run = run + 1 if t and states[t - 1] == s else 1
        out[t, s] = run
    return out


def fit_hazard(pairs: np.ndarray, dwell: np.ndarray, h: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Penalised logistic fit of leaving each state, weighted by expected stays and leaves."""
    out = np.zeros((STATES, 3))
    for k in range(STATES):
        x = np.column_stack([np.ones(len(h)), dwell[:, k], h])
        stay = pairs[:, k, k]
        go = pairs[:, k].sum(axis=1) - stay

        def objective(b: np.ndarray, x=x, stay=stay, go=go):
            eta = np.clip(x @ b, -50, 50)
            p = 1 / (1 + np.exp(-eta))
            value = float((stay * np.logaddexp(0, eta) + go * np.logaddexp(0, -eta)).sum() + l2 * b @ b)
            w = (stay + go) * p * (1 - p)
            return value, x.T @ ((stay + go) * p - go) + 2 * l2 * b, (x * w[:, None]).T @ x + 2 * l2 * np.eye(3)

        out[k] = newton(objective, np.array([-2.0, 0.0, 0.0]))
    return out


def seeds(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(STATES - 1):
        gap = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())] if gap.sum() > 0 else x[rng.integers(len(x))])
    return np.array(centres)


def soft_assignment(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gap = ((x[:, None, :] - centres) ** 2).sum(axis=2)
    scale = max(float(np.median(gap.min(axis=1))), 1e-8)
    logit = -gap / (2 * scale)
    return np.exp(logit - logsumexp(logit, 1)[:, None])


def emissions(x: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    means = gamma.T @ x / np.maximum(gamma.sum(axis=0), 1e-12)[:, None]
    eye = 1e-6 * np.eye(x.shape[1])
    return means, np.array([shrunk_covariance(x - means[k], np.maximum(gamma[:, k], 1e-12)) + eye for k in range(STATES)])


def many_covariances(centred: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """shrunk_covariance of each start and state. centred: start x state x week x feature; weight: start x state x week."""
    total = weight.sum(axis=2)[..., None, None]
    cov = np.einsum("rktd,rkt,rkte->rkde", centred, weight, centred, optimize=True) / total
    target = cov * np.eye(cov.shape[-1])
    size = ((cov - target) ** 2).sum(axis=(2, 3))
    apart = (centred**2).sum(axis=3) ** 2 - 2 * np.einsum("rktd,rkde,rkte->rkt", centred, cov, centred, optimize=True) + (cov**2).sum(axis=(2, 3))[..., None]
    noise = (weight**2 * apart).sum(axis=2) / total[..., 0, 0] ** 2
    share = np.where(size > 0, np.clip(noise / np.where(size > 0, size, 1), 0, 1), 1)[..., None, None]
    return (1 - share) * cov + share * target


def many_emissions(x: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gamma: start x week x state."""
    w = np.maximum(gamma, 1e-12).transpose(0, 2, 1)
    means = gamma.transpose(0, 2, 1) @ x / np.maximum(gamma.sum(axis=1), 1e-12)[..., None]
    return means, many_covariances(x - means[:, :, None, :], w) + 1e-6 * np.eye(x.shape[1])


def many_log_emissions(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """start x week x state."""
    low = np.linalg.cholesky(covs)
    z = np.linalg.solve(low, (x - means[:, :, None, :]).transpose(0, 1, 3, 2))
    half = np.log(np.diagonal(low, axis1=2, axis2=3)).sum(axis=2)
    return (-0.5 * (z**2).sum(axis=2) - half[..., None] - 0.5 * x.shape[1] * np.log(2 * np.pi)).transpose(0, 2, 1)


def many_posteriors(initial: np.ndarray, stay: np.ndarray, log_emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, posteriors of states, and of leaving and staying, by scaled sums. stay: start x week x state (week t leads to t + 1)."""
    n, weeks, k = log_emit.shape
    top = log_emit.max(axis=2, keepdims=True)
    emit = np.exp(log_emit - top)
    away = (1 - stay) / (k - 1)
    alpha, scale = np.empty_like(emit), np.empty((n, weeks))
    now = (initial + 1e-12) * emit[:, 0]
    for t in range(weeks):
        if t:
            out = now * away[:, t - 1]
            now = (now * stay[:, t - 1] + out.sum(axis=1, keepdims=True) - out) * emit[:, t]
        scale[:, t] = now.sum(axis=1)
        now = now / scale[:, t, None]
        alpha[:, t] = now
    beta = np.ones_like(emit)
    pairs = np.empty((n, weeks - 1, 2, k))
    for t in range(weeks - 2, -1, -1):
        ahead = emit[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        others = ahead.sum(axis=1, keepdims=True) - ahead
        go, keep = away[:, t] * others, stay[:, t] * ahead
        beta[:, t] = go + keep
        pairs[:, t, 0], pairs[:, t, 1] = alpha[:, t] * go, alpha[:, t] * keep
    return np.log(scale).sum(axis=1) + top.sum(axis=(1, 2)), alpha * beta, pairs


def many_hazards(go: np.ndarray, stay: np.ndarray, x: np.ndarray, b: np.ndarray, l2: float = 1e-3, iterations: int = 50, tol: float = 1e-10) -> np.ndarray:
    """Penalised logistic fits, one for each leading row, from b on: damped Newton steps. go, stay: fit x week; x: fit x week x 3."""
    def at(b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        eta = np.clip(np.einsum("ftj,fj->ft", x[own], b), -50, 50)
        value = (stay[own] * np.logaddexp(0, eta) + go[own] * np.logaddexp(0, -eta)).sum(axis=1) + l2 * (b**2).sum(axis=1)
        return value, eta, 1 / (1 + np.exp(-eta))

    b, live = b.copy(), np.arange(len(b))
    value, _, p = at(b, live)
    for _ in range(iterations):
        both = go[live] + stay[live]
        g = np.einsum("ftj,ft->fj", x[live], both * p - go[live]) + 2 * l2 * b[live]
        h = np.einsum("fti,ft,ftj->fij", x[live], both * p * (1 - p), x[live], optimize=True) + (2 * l2 + 1e-10) * np.eye(3)
        step = np.linalg.solve(h, g[..., None])[..., 0]
        drop = (g * step).sum(axis=1)
        more = drop >= tol
        live, step, drop, value, p = live[more], step[more], drop[more], value[more], p[more]
        if not len(live):
            break
        size = np.ones(len(live))
        while True:
            new, _, q = at(b[live] - size[:, None] * step, live)
            short = (new > value - 1e-4 * size * drop) & (size >= 1e-8)
            if not short.any():
                break
            size[short] /= 2
        b[live] -= size[:, None] * step
        value, p = new, q
    return b


def fit_many(x: np.ndarray, h: np.ndarray, starts: list[int], iterations: int = 200, tol: float = 1e-6, warm: Hmm | None = None) -> list[Hmm | None]:
    """A fit from each start (its own random stream, or `warm`), all advanced together; None where one breaks down."""
    n, weeks = len(starts), len(x)
    if warm is None:
        gamma = np.array([soft_assignment(x, seeds(x, np.random.Generator(np.random.PCG64(s)))) for s in starts])
        means, covs = many_emissions(x, gamma)
        initial, hazard = np.full((n, STATES), 1 / STATES), np.tile([-2.0, 0.0, 0.0], (n, STATES, 1))
    else:
        initial, hazard, means, covs = (np.repeat(v[None], n, axis=0) for v in (warm.initial, warm.hazard, warm.means, warm.covs))
    loglik = np.full(n, -np.inf if warm is None else warm.loglik)
    dwell = np.ones((n, weeks, STATES))
    live, broken = np.arange(n), np.zeros(n, bool)
    for _ in range(iterations):
        sound = np.array([np.isfinite(c).all() and (np.linalg.eigvalsh(c)[..., 0] > 0).all() for c in covs[live]])
        broken[live[~sound]] = True
        live = live[sound]
        if not len(live):
            break
        eta = np.clip(hazard[live, None, :, 0] + hazard[live, None, :, 1] * dwell[live] + hazard[live, None, :, 2] * h[None, :, None], -50, 50)
        leave = np.clip(1 / (1 + np.exp(-eta)), 1e-12, 1 - 1e-12)
        ll, gamma, pairs = many_posteriors(initial[live], 1 - leave, many_log_emissions(x, means[live], covs[live]))
        done = np.abs(ll - loglik[live]) < tol * (1 + np.abs(ll))
        loglik[live] = ll
        means[live], covs[live] = many_emissions(x, gamma)
        initial[live] = gamma[:, 0] / gamma[:, 0].sum(axis=1, keepdims=True)
        dwell[live] = [dwell_path(s) for s in gamma.argmax(axis=2)]
        before = dwell[live][:, :-1].transpose(0, 2, 1).reshape(-1, weeks - 1)
        design = np.stack([np.ones_like(before), before, np.broadcast_to(h[:-1], before.shape)], axis=2)
        go, stay = (pairs[:, :, j].transpose(0, 2, 1).reshape(-1, weeks - 1) for j in (0, 1))
        hazard[live] = many_hazards(go, stay, design, hazard[live].reshape(-1, 3)).reshape(-1, STATES, 3)
        live = live[~done]
        if not len(live):
            break
    return [None if broken[k] else Hmm(initial[k], hazard[k], means[k], covs[k], float(loglik[k])) for k in range(n)]


def fit_once(x: np.ndarray, h: np.ndarray, seed: int, iterations: int = 200, tol: float = 1e-6, warm: Hmm | None = None) -> Hmm:
    model = fit_many(x, h, [seed], iterations, tol, warm)[0]
    if model is None:
        raise np.linalg.LinAlgError("a state's covariance is not positive definite")
    return model


def posterior_path(model: Hmm, x: np.ndarray, h: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Posterior of the states by week; dwell times come from the most likely states of the round before."""
    dwell = np.ones((len(x), STATES))
    emit = many_log_emissions(x, model.means[None], model.covs[None])
    for _ in range(rounds):
        _, gamma, _ = many_posteriors(model.initial[None], 1 - leaving(model.hazard, dwell, h)[None], emit)
        dwell = dwell_path(gamma[0].argmax(axis=1))
    return gamma[0]


def fit(x: np.ndarray, h: np.ndarray, restarts: int = 50, iterations: int = 200, seed: int = 0) -> Hmm:
    """The best of several starts, the first of equals. Starts are independent: each has its own stream."""
    best: Hmm | None = None
    for m in fit_many(x, h, [seed * 1000 + r for r in range(restarts)], iterations):
        if m is not None and (best is None or m.loglik > best.loglik):
            best = m
    if best is None:
        raise ValueError("no start converged")
    return best


def labels(mean_return: np.ndarray) -> dict[int, str]:
    """States by ascending forward return, ties by state."""
    order = sorted(range(STATES), key=lambda k: (mean_return[k], k))
    return {state: LABELS[i] for i, state in enumerate(order)}
