"""The four laws against plain fits, and their walk-forward run against a loop."""

import datetime as dt

import numpy as np
import pytest

from tidemark.models import laws
from tidemark.plans import walkforward as WF


def data(n=220, seed=0):
    rng = np.random.default_rng(seed)
    X = np.column_stack([np.ones(n), rng.normal(size=(n, 2)), np.exp(rng.normal(size=n) / 2)])
    y = 0.3 * X[:, 1] + X[:, 3] * rng.standard_t(6, size=n) / 4
    return X, y


def test_quantile_law_is_optimal():
    X, y = data()
    _, _, q = laws.quantile(X, y, X)
    for k, tau in enumerate(laws.TAUS):
        weight = np.r_[0.0, np.full(3, laws.ALPHA / 2)]
        loss = lambda b: np.maximum(tau * (y - X @ b), (tau - 1) * (y - X @ b)).sum() + (weight * b) @ b  # noqa: B023, E731
        beta = np.linalg.lstsq(X, q[:, k], rcond=None)[0]
        if not np.allclose(X @ beta, q[:, k], atol=1e-6):
            continue  # levels crossed on some row
        rng = np.random.default_rng(k)
        assert all(loss(beta + rng.normal(size=4) * s) >= loss(beta) - 1e-6 for s in (1e-1, 1e-2, 1e-3) for _ in range(50))
    assert (np.diff(q, axis=1) >= 0).all() and np.abs((y[:, None] <= q).mean(axis=0) - laws.TAUS).max() < 0.03


def test_density_heads_and_states():
    X, y = data(400, 1)
    mu, sigma, q = laws.density(X, y, X)
    assert np.allclose(q[:, 2], mu) and np.corrcoef(np.log(sigma), X[:, 3])[0, 1] > 0.8
    assert laws.ranks(np.array([3.0, 1, 3, 2])).tolist() == [3.5, 1, 3.5, 2]
    mu, sigma, q = laws.heads(X, y, X)
    assert np.corrcoef(mu, X[:, 1])[0, 1] > 0.8 and np.allclose((q[:, 3] - q[:, 1]) / (laws.NORMAL[3] - laws.NORMAL[1]), sigma)
    mu, sigma, _ = laws.two_states(X, y, X[:50])
    high = X[:, 3] > np.median(X[:, 3])
    assert mu.tolist() == pytest.approx([y[high == h].mean() for h in high[:50]]) and sigma.tolist() == pytest.approx([y[high == h].std() for h in high[:50]])
    mu, _, _ = laws.two_states(X[:30], y[:30], X[:3])
    assert mu.tolist() == pytest.approx([y[:30].mean()] * 3)


def test_walk_forward_of_the_laws(spark):
    X, y = data(70, 3)
    start = dt.date(2021, 1, 1)
    rows = [(s, start + dt.timedelta(weeks=t), *map(float, X[t, 1:]), float(y[t]) * (1 + (s == "B"))) for s in "AB" for t in range(70)]
    df = spark.createDataFrame(rows, "series_id string, week date, a double, b double, c double, y double")
    out = WF.hypotheses(df.repartition(3), ["a", "b", "c"], embargo=4, min_train=50, weeks=5).collect()
    assert len(out) == 2 * 4 * (70 - 53)
    for r in out:
        t = (r.as_of - start).days // 7
        train, scale = slice(0, t - 3), 1 + (r.series_id == "B")
        mu, sigma, q = laws.LAWS[r.hypothesis](X[train], y[train] * scale, X[t : t + 1])
        assert r.n_train == t - 3
        assert [r.mu, r.sigma, *(r[n] for n in WF.NAMES)] == pytest.approx([mu[0], sigma[0], *q[0]], abs=1e-6)


def test_direction_sets():
    from tidemark.models.numerics import powell

    at, value, done = powell(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, np.array([-1.2, 1.0]), 0.1, 200, 1e-12)
    assert done and value < 1e-9 and at == pytest.approx([1, 1], abs=1e-4)
    at, _, _ = powell(lambda p: abs(p[0] - 3) + 2 * abs(p[1] + 1), np.zeros(2), 0.1, 100, 1e-12)
    assert at == pytest.approx([3, -1], abs=1e-2)


def test_student_law_is_at_least_as_good_as_a_simplex(monkeypatch):
    from tidemark.models import scale

    for seed in range(8):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(60, 300))
        x = rng.normal(size=(n, 1))
        y = 0.3 * x[:, 0] + 0.4 * rng.standard_t(4, size=n)
        _, value, status = scale.fit_student(x, np.ones((n, 1)), y)
        with monkeypatch.context() as m:
            m.setattr(scale, "powell", lambda f, theta, *_: (theta, f(theta), True))
            _, simplex, _ = scale.fit_student(x, np.ones((n, 1)), y)
        assert status == "ok" and value <= simplex + 1e-9
