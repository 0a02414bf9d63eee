"""Prefix structures against plain loops: order statistics, state posteriors."""

import datetime as dt

import numpy as np
import pytest

from tidemark.models import hmm
from tidemark.models.orderstats import Prefixes, expanding_median_mad


@pytest.mark.parametrize("n, kinds", [(1, 3), (2, 1), (3, 2), (64, 5), (257, 1000), (300, 4)])
def test_expanding_median_and_mad(n, kinds):
    rng = np.random.default_rng(n + kinds)
    x = rng.integers(-kinds, kinds, n) / 3.0
    x[rng.random(n) < 0.1] = np.nan
    med, mad = expanding_median_mad(x)
    for t in range(n):
        seen = x[: t + 1][~np.isnan(x[: t + 1])]
        if not len(seen):
            assert np.isnan(med[t]) and np.isnan(mad[t])
            continue
        assert med[t] == pytest.approx(np.median(seen), abs=1e-12)
        assert mad[t] == pytest.approx(np.median(np.abs(seen - np.median(seen))), abs=1e-12)


def test_any_rank_of_any_prefix():
    rng = np.random.default_rng(4)
    x = rng.normal(size=90).round(1)
    p = Prefixes(x)
    t = np.repeat(np.arange(1, 91), 3)
    k = (rng.random(270) * t).astype(np.int64)
    assert p.smallest(t, k).tolist() == [np.sort(x[:a])[b] for a, b in zip(t, k)]


@pytest.mark.parametrize("block", [1, 7, 256])
def test_posteriors_by_scan_equal_the_week_by_week_recursion(spark, block):
    from pyspark.sql import functions as F

    from tidemark.operators import states

    rng = np.random.default_rng(block)
    rows, want = [], {}
    for s, n in (("A", 60), ("B", 1), ("C", 23)):
        emit = rng.normal(size=(n, 3)) * 30 - 400  # far below what exp can hold
        h = rng.normal(size=n)
        dwell = rng.integers(1, 9, (n, 3))
        move = hmm.log_transitions(np.array([[-2, 0.1, 1], [-1, 0, -1], [-3, 0.2, 0.5]]), dwell, h)
        alpha = hmm.filtered(np.log(np.full(3, 1 / 3)), move, emit)
        gamma, pairs = hmm.smoothed(alpha, move, emit)
        for t in range(n):
            into = np.exp(move[t - 1]).ravel() if t else np.zeros(9)
            day = dt.date(2020, 1, 3) + dt.timedelta(weeks=t)
            rows.append((s, day, *map(float, emit[t]), *map(float, into)))
            top = alpha[t].max()
            ll = top + np.log(np.exp(alpha[t] - top).sum())
            want[s, day] = [*np.exp(alpha[t] - ll), *gamma[t], *(pairs[t - 1].ravel() if t else [None] * 9), ll]
    names = [f"t{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    df = spark.createDataFrame(rows, "series_id string, week date, l1 double, l2 double, l3 double, " + ", ".join(f"{n} double" for n in names))
    out = states.posteriors(df.repartition(3), "series_id", "week", [F.col(f"l{k}") for k in (1, 2, 3)], [F.col(n) for n in names], block).collect()
    assert len(out) == len(want)
    for r in out:
        for got, exact in zip(list(r)[2:], want[r.series_id, r.week]):
            assert got is None and exact is None or got == pytest.approx(exact, rel=1e-9, abs=1e-9)
