"""The panel's walk-forward run against a serial version, and the pooled laws against a dense solver."""

import datetime as dt

import numpy as np
import pytest

from tidemark.models import hmm, pooled, quantreg
from tidemark.plans import panel as plan
from tidemark.plans.training import state_inputs

MACRO, MICRO = ["z1", "z2", "z3"], ["m1", "m2"]
RUN = plan.Run(embargo=4, longest=50, least=30, restarts=3, iterations=12, fresh_every=10, chain=20, laws=7)


def panel_rows(name, n, seed):
    rng = np.random.default_rng(seed)
    z = np.cumsum(rng.normal(size=(n, 3)), axis=0) / 4
    rows = []
    for k, asset in enumerate("ABC"):
        for t in range(n):
            if asset == "C" and t % 11 == 3:
                continue
            m = rng.normal(size=2)
            ok = not (asset == "B" and t < 15)
            y = float(0.1 * z[t, 0] + 0.2 * (k - 1) + (0.3 + 0.1 * abs(m[0])) * rng.normal())
            rows.append((name, asset, dt.date(2020, 1, 3) + dt.timedelta(weeks=t), *map(float, z[t]), *(map(float, m) if ok else (0.0, 0.0)), ok, None if t > n - 4 else y))
    return rows


def serial(rows):
    """Week by week, all rows at hand, the model of the week before in a variable."""
    week = np.array([np.datetime64(r[2]) for r in rows])
    asset = np.array([r[1] for r in rows])
    z, m = np.array([r[3:6] for r in rows]), np.array([r[6:8] for r in rows])
    ok, y = np.array([r[8] for r in rows]), np.array([np.nan if r[9] is None else r[9] for r in rows])
    weeks = np.unique(week)
    macro = np.array([z[week == w][0] for w in weeks])
    model, out = None, {}
    for i, w in enumerate(weeks):
        edge = w - np.timedelta64(7 * RUN.embargo, "D")
        past = (weeks <= edge) & (weeks > edge - np.timedelta64(7 * RUN.longest, "D"))
        if past.sum() < RUN.least:
            continue
        obs, h = state_inputs(macro[past])
        warm = hmm.fit_many(obs, h, [0], RUN.iterations, warm=model)[0] if model else None
        if i % RUN.fresh_every == 0 or model is None:
            seeds = [int(w.astype(int)) * 1000 + k for k in range(RUN.restarts)]
            found = [f for f in hmm.fit_many(obs, h, seeds, RUN.iterations) if f]
            best = max(found, key=lambda f: round(f.loglik, 6), default=None)
            if warm is None or (best and round(best.loglik, 6) > round(warm.loglik, 6)):
                warm = best
        model = warm
        seen = (weeks <= w) & (weeks > w - np.timedelta64(7 * (RUN.embargo + RUN.longest), "D"))
        if model:
            pi = hmm.posterior_path(model, obs, h)
            pi = np.vstack([pi[:1], pi])
            today = hmm.posterior_path(model, *state_inputs(macro[seen]))[-1]
        else:
            pi, today = np.tile([0.25, 0.5, 0.25], (past.sum(), 1)), np.array([0.25, 0.5, 0.25])
        of_week = dict(zip(weeks[past].tolist(), pi))
        train = np.array([x in of_week for x in week.tolist()]) & ok & np.isfinite(y)
        names, group = np.unique(asset[train], return_inverse=True)
        now = (week == w) & ok & np.isin(asset, names)
        if train.sum() < RUN.least:
            continue
        probs = np.array([of_week[x] for x in week[train].tolist()])
        shared = pooled.fit_shared(group, np.column_stack([z[train], probs]), m[train], y[train])
        spread, _ = pooled.fit_spreads(group, z[train], m[train], y[train])
        at = np.searchsorted(names, asset[now])
        q = shared.predict(at, np.column_stack([z[now], np.tile(today, (now.sum(), 1)), m[now]]))
        r = spread.predict(at, z[now], m[now])
        for a, u, v in zip(asset[now], q, r):
            out[a, w.astype(object)] = (int(train.sum()), *today, *u, *v)
    return out


def test_backtest_equals_the_serial_run(spark):
    tables = {"one": panel_rows("one", 75, 1), "two": panel_rows("two", 58, 2)}
    schema = "panel string, series_id string, week date, z1 double, z2 double, z3 double, m1 double, m2 double, available boolean, y double"
    df = spark.createDataFrame([r for rows in tables.values() for r in rows], schema).repartition(3)
    got = plan.backtest(df, MACRO, MICRO, "A", RUN).collect()
    for name, rows in tables.items():
        want = serial(rows)
        mine = {(r.series_id, r.week): r for r in got if r.panel == name and r.q50 is not None}
        assert mine.keys() == want.keys() and want
        for key, (n, *values) in want.items():
            r = mine[key]
            assert r.n_train == n
            assert [r.p1, r.p2, r.p3, *(r[c] for c in plan.NAMES), *(r[c] for c in plan.SPREAD)] == pytest.approx(values, abs=2e-4)
    # unavailable assets have a row without quantiles; chains go on over the borders of chunks
    assert any(r.q50 is None and r.series_id == "B" for r in got) is False  # B is available again before the first forecast
    assert {r.start for r in got} >= {"warm", "fresh"}


def test_unavailable_assets_have_no_quantiles(spark):
    rows = panel_rows("one", 50, 3)
    last = max(r[2] for r in rows)
    rows = [(*r[:6], 0.0, 0.0, False, r[9]) if r[1] == "B" and r[2] == last else r for r in rows]
    schema = "panel string, series_id string, week date, z1 double, z2 double, z3 double, m1 double, m2 double, available boolean, y double"
    got = plan.backtest(spark.createDataFrame(rows, schema), MACRO, MICRO, "A", RUN).where(f"week = date'{last}'").collect()
    assert {r.series_id: r.q50 is None for r in got} == {"A": False, "B": True, "C": False}


def dense(parts, i, j):
    own = parts[0][i].shape[1]
    rows = []
    for k, p in enumerate(parts):
        wide = np.zeros((len(p[i]), own * len(parts)))
        wide[:, k * own : (k + 1) * own] = p[i]
        rows.append(np.hstack([wide, p[j]]))
    return np.vstack(rows)


def test_pooled_spreads_reach_the_dense_optimum():
    rng = np.random.default_rng(0)
    n, groups = 80, np.repeat([0, 1, 2], 80)
    macro, micro = rng.normal(size=(3 * n, 4)), np.abs(rng.normal(size=(3 * n, 2)))
    y = macro @ [0.1, 0, 0.2, 0] + 0.1 * groups + (0.2 + 0.3 * micro[:, 0]) * rng.standard_t(5, size=3 * n)
    law, fit = pooled.fit_spreads(groups, macro, micro, y)
    parts = [pooled.spread_design(macro[groups == k], micro[groups == k]) for k in range(3)]
    ridge = np.r_[np.tile(np.r_[0, np.full(6, 0.5), np.tile([0, 0.5, 0.5], 4)], 3), np.full(6, 2.0), np.full(8, 0.1)]
    ys = np.concatenate([np.tile(y[groups == k], 5) for k in range(3)])
    plain = quantreg.solve(dense(parts, 0, 1), ys, np.tile(np.repeat(quantreg.TAUS, n), 3), ridge, dense(parts, 2, 3), np.full(12 * n, 1e-4), np.zeros(len(ridge)))
    assert fit.status == plain.status == "ok"
    assert fit.objective <= plain.objective + 1e-5
    q = law.predict(groups, macro, micro)
    assert (np.diff(q, axis=1) > 0).all()
    assert np.abs((y[:, None] <= q).mean(axis=0) - quantreg.TAUS).max() < 0.05
    # no step away from it is better
    for _ in range(200):
        theta = fit.theta + rng.normal(size=len(ridge)) * 1e-3
        if (dense(parts, 2, 3) @ theta >= 1e-4).all():
            r = ys - dense(parts, 0, 1) @ theta
            tau = np.tile(np.repeat(quantreg.TAUS, n), 3)
            assert np.maximum(tau * r, (tau - 1) * r).sum() + (ridge * theta) @ theta >= fit.objective - 1e-6


def test_shared_slopes_and_fallback():
    rng = np.random.default_rng(1)
    groups = np.repeat([0, 1], 120)
    common, micro = rng.normal(size=(240, 3)), rng.normal(size=(240, 2))
    y = common @ [0.3, 0, 0] + groups + rng.normal(size=240)
    law = pooled.fit_shared(groups, common, micro, y, 1e-3, 1e-3)
    q = law.predict(groups, np.column_stack([common, micro]))
    assert law.status == "ok" and np.abs((y[:, None] <= q).mean(axis=0) - quantreg.TAUS).max() < 0.04
    broken = pooled.Arrow.newton
    try:
        pooled.Arrow.newton = lambda *a: (_ for _ in ()).throw(np.linalg.LinAlgError())
        alone = pooled.fit_shared(groups, common, micro, y, 1e-3, 1e-3)
    finally:
        pooled.Arrow.newton = broken
    assert alone.status == "per_asset_fallback" and alone.predict(groups, np.column_stack([common, micro])).shape == q.shape


def test_walk_forward_outcomes_and_policies(spark):
    from pyspark.sql import functions as F

    from tidemark.plans import walkforward as WF

    rng = np.random.default_rng(9)
    start = dt.date(2020, 1, 3)
    rows = [(s, start + dt.timedelta(weeks=t), float(rng.normal()), float("nan") if (s, t) == ("B", 44) else float(rng.normal())) for s, n in (("A", 70), ("B", 60), ("C", 20)) for t in range(n)]
    df = spark.createDataFrame(rows, "series_id string, week date, x double, y double")
    out = {(r.series_id, r.as_of): r for r in WF.run(df, embargo=5, min_train=30, weeks=8).collect()}
    assert len(out) == len(rows)
    for (s, w), r in out.items():
        train = [(x, y) for a, b, x, y in sorted(rows, key=lambda r: r[1]) if a == s and b <= w - dt.timedelta(weeks=5)]
        assert r.n_train == len(train)
        if len(train) < 30:
            assert r.status == "insufficient_history" and r.q50 is None
        elif any(y != y for _, y in train):
            assert r.status == "failed" and r.q50 is None
        else:
            x = next(x for a, b, x, _ in rows if (a, b) == (s, w))
            coef, fit = quantreg.fit_linear(np.array([[t[0]] for t in train]), np.zeros((len(train), 0)), np.array([t[1] for t in train]))
            assert r.status == fit.status
            assert [r[q] for q in WF.NAMES] == pytest.approx(np.maximum.accumulate(coef[:, 0] + coef[:, 1] * x).tolist(), abs=2e-5)
    short = WF.run(df, embargo=5, min_train=10, longest=20, weeks=8).where("status = 'ok'").collect()
    assert max(r.n_train for r in short) == 20
    outcomes = WF.run(df, embargo=5, min_train=30, weeks=8)
    first = F.lit(start).cast("date")
    clipped = WF.under_policy(outcomes, first, 30, "clip_diagnostic").collect()
    assert {r.series_id: (r.effective_start, r.n_clipped) for r in clipped} == {s: (start + dt.timedelta(weeks=34), 34) for s in "AB"}
    assert min(r.as_of for r in clipped) == start + dt.timedelta(weeks=34)
    assert WF.under_policy(outcomes, first, 30, "allow").count() == len(rows)
    with pytest.raises(Exception, match="precedes the effective start"):
        WF.under_policy(outcomes, first, 30, "raise").collect()
    late = F.lit(start + dt.timedelta(weeks=40)).cast("date")
    assert WF.under_policy(outcomes.where("series_id <> 'C'"), late, 30, "raise").count() == 30 + 20
    with pytest.raises(ValueError):
        WF.under_policy(outcomes, first, 30, "other")


def test_groups_of_few_rows_are_fitted_in_tasks_of_their_own(spark):
    """Adaptive execution would merge them into one task, in which all weeks come one after another."""
    from pyspark.sql import functions as F

    run = plan.Run(embargo=4, longest=50, least=30, restarts=1, iterations=2, fresh_every=5, chain=20, laws=7)
    schema = "panel string, series_id string, week date, z1 double, z2 double, z3 double, m1 double, m2 double, available boolean, y double"
    rows = spark.createDataFrame(panel_rows("one", 75, 1), schema)
    bounds = rows.groupBy("panel").agg(F.min("week").alias("first"), F.max("week").alias("last"))
    fresh = plan.fresh_models(rows.where("series_id = 'A'"), bounds, MACRO, run).select("as_of", F.spark_partition_id().alias("task")).collect()
    assert len({r.as_of for r in fresh}) == 8 and len({r.task for r in fresh}) > 4
    laws = plan.backtest(rows, MACRO, MICRO, "A", run).select("week", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in laws}) > 3


def test_the_panel_query_scans_each_table_once_a_series(spark, monkeypatch):
    from tidemark.queries import panel as queries
    from tidemark.sources import tables as T

    class Found(Exception):
        pass

    def stop(frame, *rest):
        raise Found

    scans, table = [], T.table
    monkeypatch.setattr(T, "table", lambda spark, d, name: scans.append(name) or table(spark, d, name))
    monkeypatch.setattr(queries.plan, "backtest", stop)
    with pytest.raises(Found):
        queries.panel_backtest(spark, "/root/testdata/sf0.001")
    assert sorted(scans) == ["lineitem", "lineitem", "orders"]
    d = T.stored(spark, "/root/testdata/sf0.001")
    seen = len(scans)
    mine = queries.panel_frame(spark, d).orderBy("series_id", "week").collect()
    assert len(scans) == seen and mine == queries.panel_frame(spark, "/root/testdata/sf0.001").orderBy("series_id", "week").collect()
