"""Golden values and plan properties of the engine's operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import quantiles as Q
from tidemark.functions import scalar as S
from tidemark.operators import alignment as A
from tidemark.operators import calendar as C
from tidemark.operators import evaluate as V
from tidemark.operators import windows as W
from tidemark.sources import observations as O

DAY = dt.date


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["zero"])
    return row.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_robust_z(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a"), (3, 100.0, "a")], "week int, x double, k string")
    z = [r["z"] for r in W.robust_z(df, "x", ["k"]).orderBy("week").collect()]
    assert z == pytest.approx([0, 0.6744907594765952, 66.1000939828673])


def test_fridays(spark):
    got = one(spark, C.next_friday(F.lit("2024-07-04").cast("date")), C.next_friday(F.lit("2024-07-05").cast("date")), C.is_friday(F.lit("2024-07-05").cast("date")), C.weeks_between(F.lit("2024-07-05").cast("date"), F.lit("2024-07-19").cast("date")))
    assert tuple(got) == (DAY(2024, 7, 5), DAY(2024, 7, 5), True, 3)


def test_strict_start(spark):
    df = spark.createDataFrame([(DAY(2007, 12, 3),), (DAY(2001, 1, 1),)], "first_date date")
    assert C.strict_start(df).first()[0] == DAY(2014, 11, 28)


def weekly_series(spark, n, value):
    return spark.createDataFrame([("s", DAY(2024, 1, 5) + dt.timedelta(days=7 * i), float(value(i))) for i in range(n)], "series_id string, week date, value double")


def test_calendar_lag_misses_missing_weeks(spark):
    df = weekly_series(spark, 20, lambda i: i).where("week <> date'2024-01-12'")
    out = {r["week"]: r["d"] for r in df.withColumn("d", A.at_week_offset("value", -13, ["series_id"])).collect()}
    assert out[DAY(2024, 4, 5)] == 0 and out[DAY(2024, 4, 12)] is None and out[DAY(2024, 4, 19)] == 2


def test_forward_return(spark):
    df = weekly_series(spark, 60, lambda i: math.exp(0.01 * i)).withColumn("y", A.forward_log_return("value", 52, ["series_id"]))
    y = [r["y"] for r in df.orderBy("week").collect()]
    assert y[0] == pytest.approx(0.52) and y[7] == pytest.approx(0.52) and y[8] is None


def test_asof_has_six_days(spark):
    obs = spark.createDataFrame([("s", DAY(2024, 7, 4), 27.0), ("s", DAY(2024, 7, 10), None)], "series_id string, obs_date date, value double")
    days = spark.createDataFrame([(DAY(2024, 7, k),) for k in (3, 4, 9, 10, 11, 16, 17)], "as_of date")
    got = {r["as_of"].day: r["value"] for r in A.as_of(days, obs).collect()}
    assert got == {4: 27.0, 9: 27.0, 10: None, 11: None, 16: None}
    far = {r["as_of"].day: r["value"] for r in A.as_of(days, obs, tolerance=None).collect()}
    assert far == {4: 27.0, 9: 27.0, 10: None, 11: None, 16: None, 17: None}


def test_tail_and_moments(spark):
    q = [F.lit(x) for x in (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3)]
    low, high = Q.extrapolated(F.lit(-0.10), F.lit(-0.05), F.lit(0.10), F.lit(0.20))
    got = one(spark, low, high, Q.mean(q), Q.loss_probability(q), Q.shortfall(q))
    assert tuple(got) == pytest.approx((-0.13, 0.26, 0, 0.5, 0.19444444444444445), abs=1e-12)


def test_scores_and_stances(spark):
    knots, levels = [-2.0, -1.0, 0.0, 1.0, 2.0, 3.0], [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]
    got = one(spark, *[S.piecewise(F.lit(x), knots, levels) for x in (-1.5, 0.5, 2.5, -10.0, 10.0)], *[S.stance(F.lit(x)) for x in (35.0, 50.0, 65.0)])
    assert tuple(got) == (10, 50, 90, 0, 100, "DEFENSIVE", "NEUTRAL", "OFFENSIVE")


def test_guard(spark):
    got = one(spark, S.guard_mode(F.lit(0.1), F.lit(0)), S.guard_mode(F.lit(0.05), F.lit(1)), S.guard_mode(F.lit(0.21), F.lit(0)), S.guard_mode(F.lit(0.0), F.lit(2)), S.guard_mode(F.lit(0.0), F.lit(0)))
    assert tuple(got) == ("DEGRADED", "DEGRADED", "BLOCKED", "BLOCKED", "NORMAL")


def test_missing_values_never_compare(spark):
    got = one(spark, S.finite(F.lit(float("nan"))), S.finite(F.lit(float("inf"))), S.safe_ln(F.lit(0.0)), S.finite(F.lit(2.0)))
    assert tuple(got) == (None, None, None, 2.0)


def test_hysteresis(spark):
    df = spark.createDataFrame([("a", 1, 54.0), ("a", 2, 60.0), ("a", 3, 62.0), ("a", 4, 80.0), ("b", 1, 57.0)], "k string, week int, raw double")
    got = {(r["k"], r["week"]): r["final"] for r in W.hysteresis(df, "raw", ["k"], "week").collect()}
    assert got == {("a", 1): 50, ("a", 2): 60, ("a", 3): 60, ("a", 4): 80, ("b", 1): 57}


def test_confusion(spark):
    df = spark.createDataFrame(list(zip("xxxxx", "EESCC", "ESSCE")), "k string, truth string, pred string")
    assert V.confusion(df, "truth", "pred", ["C", "S", "E"], ["k"]).first()["balanced_accuracy"] == pytest.approx(2 / 3)


def test_terciles(spark):
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate((-2, -1, 0, 1, 2))], "k string, i int, x double")
    assert [r["s"] for r in V.terciles(df, "x", "s", ["k"]).orderBy("i").collect()] == ["C", "C", "S", "E", "E"]


def test_pearson_of_constants_is_null(spark):
    df = spark.createDataFrame([("k", 1.0, float(i)) for i in range(5)], "k string, x double, y double")
    assert df.groupBy("k").agg(V.pearson("x", "y").alias("c")).first()["c"] is None


def test_append_only(spark):
    schema = "series_id string, obs_date date, value double"
    old = spark.createDataFrame([("s", DAY(2024, 1, 1), 1.0), ("s", DAY(2024, 1, 2), None)], schema)
    same = spark.createDataFrame([("s", DAY(2024, 1, 2), None), ("s", DAY(2024, 1, 3), 3.0)], schema)
    assert [r["value"] for r in O.merged(old, same).orderBy("obs_date").collect()] == [1.0, None, 3.0]
    with pytest.raises(ValueError, match="disagree"):
        O.merged(old, spark.createDataFrame([("s", DAY(2024, 1, 1), 2.0)], schema))


def test_vintage_guard_fails(spark):
    rows = spark.createDataFrame([("s", DAY(2024, 1, 1), DAY(2024, 2, 1), 1.0)], "series_id string, obs_date date, realtime_start date, value double")
    day = lambda x: F.lit(x).cast("date")
    assert O.guarded(rows, day("2024-02-01")).count() == 1
    assert O.guarded(rows, day("2024-01-15"), enforce=False).count() == 1
    with pytest.raises(Exception, match="later than as_of"):
        O.guarded(rows, day("2024-01-15")).collect()


def test_payload(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"series_id": "s", "observations": [{"date": "2024-01-01", "value": ".", "realtime_start": "2024-01-02", "realtime_end": "9999-12-31"}, {"date": "2024-01-02", "value": "1.5", "realtime_start": "2024-01-03", "realtime_end": "9999-12-31"}]}) + "\n")
    assert [(r["obs_date"], r["value"]) for r in O.read_payload(spark, str(tmp_path)).collect()] == [(DAY(2024, 1, 2), 1.5)]


def test_record_text_is_stable():
    assert O.record_text({"b": [1.5, None], "a": {"z": "é", "y": True}}) == '{"a":{"y":true,"z":"\\u00e9"},"b":[1.5,null]}\n'


def test_files_are_checked(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    want = spark.createDataFrame([("x.bin", hashlib.sha256(b"abc").hexdigest()), ("y.bin", "0")], "name string, sha256 string")
    assert {r["name"]: r["ok"] for r in O.checked_files(spark, str(tmp_path), want).collect()} == {"x.bin": True, "y.bin": False}


def test_filters_reach_the_scan(spark, tmp_path):
    from tidemark.queries.series import weekly_prices

    spark.sql("SELECT 'A' AS l_returnflag, 'F' AS l_linestatus, timestamp_ntz'1998-01-02 00:00:00' AS l_shipdate, 2.0D AS l_extendedprice, 1.0D AS l_quantity, 'x' AS l_comment").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = weekly_prices(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_quantity" not in plan


def test_streamed_weeks_and_scores(spark, tmp_path):
    from tidemark.streaming import weekly as T

    rows = [("s", dt.datetime(2024, 1, 1 + k), float(k)) for k in range(26)]
    spark.createDataFrame(rows, "series_id string, obs_time timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/obs")
    stream = spark.readStream.schema("series_id string, obs_time timestamp, value double").parquet(f"{tmp_path}/obs")
    q = T.closed_weeks(stream, "1 day").writeStream.outputMode("append").format("memory").queryName("weeks").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["week"]: r["value"] for r in spark.table("weeks").collect()} == {DAY(2024, 1, 5): 4.0, DAY(2024, 1, 12): 11.0, DAY(2024, 1, 19): 18.0}


def test_quantile_fit_is_optimal_and_apart():
    from tidemark.models import quantreg

    g = np.random.Generator(np.random.PCG64(2))
    x = g.standard_normal((90, 2))
    y = x @ [0.4, -0.2] + 0.3 * g.standard_normal(90) * (1 + 0.5 * np.abs(x[:, 0]))
    coef, out = quantreg.fit_linear(x, np.zeros((90, 0)), y)
    q = np.column_stack([np.ones(90), x]) @ coef.T
    assert out.status == "ok" and (np.diff(q, axis=1) >= 1e-4 - 1e-9).all()
    args = quantreg.stacked(np.column_stack([np.ones(90), x]), y, np.r_[0.0, 1, 1], 1e-2, 1e-4)
    A_, yy, tau, ridge = args[:4]

    def objective(t):
        r = yy - A_ @ t
        return np.maximum(tau * r, (tau - 1) * r).sum() + (ridge * t) @ t

    base = objective(coef.ravel())
    for _ in range(200):
        t = coef.ravel() + 0.01 * g.standard_normal(15)
        if ((args[4] @ t) >= args[5]).all():
            assert objective(t) >= base - 1e-6
    assert ((y[:, None] <= q).mean(axis=0) - quantreg.TAUS == pytest.approx(0, abs=0.06))


def test_panel_and_spread_fits():
    from tidemark.models import quantreg

    g = np.random.Generator(np.random.PCG64(3))
    x, groups = g.standard_normal((120, 2)), np.arange(120) % 3
    y = x[:, 0] * (0.3 + 0.1 * groups) + 0.2 * g.standard_normal(120) + groups
    theta, how = quantreg.fit_panel_or_each(groups, x, y, 3)
    q = quantreg.panel_design(groups, x, 3) @ theta.T
    assert how == "joint" and (np.diff(q, axis=1) >= 1e-4 - 1e-9).all()
    spread, out = quantreg.fit_spreads(x, np.abs(x), y)
    assert out.status == "ok" and len(spread) == 5 + 4 * 3


def test_hmm_against_enumeration():
    from itertools import product

    from tidemark.models import hmm

    g = np.random.Generator(np.random.PCG64(4))
    x = g.standard_normal((5, 1))
    emit = hmm.log_emissions(x, np.array([[-1.0], [0.0], [1.0]]), np.tile(np.eye(1), (3, 1, 1)))
    trans = hmm.log_transitions(np.array([[-1.0, 0, 0.2], [-2, 0, 0], [-1, 0.1, 0]]), np.ones((5, 3)), np.linspace(-1, 1, 5))
    assert np.exp(trans).sum(axis=2) == pytest.approx(np.ones((5, 3)))
    start = np.log(np.full(3, 1 / 3))
    alpha = hmm.filtered(start, trans, emit)
    gamma, pairs = hmm.smoothed(alpha, trans, emit)
    weight = {p: math.exp(start[p[0]] + sum(emit[t, p[t]] for t in range(5)) + sum(trans[t, p[t], p[t + 1]] for t in range(4))) for p in product(range(3), repeat=5)}
    total = sum(weight.values())
    assert math.log(total) == pytest.approx(float(np.log(np.exp(alpha[-1]).sum())))
    for t in range(5):
        assert gamma[t] == pytest.approx([sum(w for p, w in weight.items() if p[t] == k) / total for k in range(3)])
    assert pairs.sum(axis=(1, 2)) == pytest.approx(np.ones(4))
    assert hmm.labels(np.array([0.01, 0.08, 0.01])) == {0: "DEFENSIVE", 2: "NEUTRAL", 1: "OFFENSIVE"}
    assert hmm.dwell_path(np.array([0, 0, 1, 0]))[:, 0].tolist() == [1, 2, 1, 1]


def test_every_week_is_predicted(spark, monkeypatch):
    from tidemark.plans import walkforward as WF
    from tidemark.queries import modelling

    start, rng = dt.date(2000, 1, 7), np.random.default_rng(2)
    rows = [("A", start + dt.timedelta(weeks=k), x := float(rng.normal()), x / 2 + float(rng.normal())) for k in range(86) if k != 70]
    weeks = [r[1] for r in rows]
    monkeypatch.setattr(modelling, "pairs", lambda spark, d: spark.createDataFrame(rows, "series_id string, week date, x double, y double"))
    out = {r["as_of"]: r for r in modelling.challenger_run(spark, "").collect()}
    before = {w: sum(v <= w - dt.timedelta(weeks=14) for v in weeks) for w in weeks}
    assert sorted(out) == [w for w in weeks if before[w] >= 52]
    first = min(out)
    assert {r["fitted"] for r in out.values()} == {first, first + dt.timedelta(weeks=13)}
    assert all(r["n_train"] == before[r["fitted"]] and w - r["fitted"] < dt.timedelta(weeks=13) for w, r in out.items())
    assert all(r["q05"] < r["q50"] < r["q95"] for r in out.values()) and len({r["q50"] for r in out.values()}) == len(out)
    assert sorted(r["as_of"] for r in modelling.walkforward(spark, "").collect()) == [w for w in weeks if before[w] >= 60]


def test_production_bootstraps(spark, monkeypatch):
    from tidemark.operators import performance as P
    from tidemark.queries import backtest

    rng, reps = np.random.default_rng(4), 2000
    p, b, y = (rng.uniform(0.5, 1.5, 30) for _ in range(3))
    rows = spark.createDataFrame([(k, float(p[k]), float(b[k]), float(y[k])) for k in range(30)], "idx bigint, p double, b double, y double")
    two = rows.selectExpr("'A' AS series_id", "*").unionByName(rows.where("idx < 17").selectExpr("'B' AS series_id", "*"))
    monkeypatch.setattr(backtest, "all_metric_rows", lambda spark, d: two)
    monkeypatch.setattr(backtest, "week_rows", lambda spark, d: rows)
    draws = {}
    for length in (52, 78):
        for r in range(reps):
            s, i, path = (backtest.SEED + r * 7919) % P.LCG_M, -1, []
            for _ in range(30):
                s1 = (s * P.LCG_A + P.LCG_C) % P.LCG_M
                s = (s1 * P.LCG_A + P.LCG_C) % P.LCG_M
                i = s * 30 // P.LCG_M if i < 0 or s1 * length < P.LCG_M else (i + 1) % 30
                path.append(i)
            draws[length, r] = path
    streams = backtest.bootstrap_stream(spark, "").collect()
    assert {(r["block_length"], r["rep"]): (r["n"], r["checksum"]) for r in streams if r["series_id"] == "A"} == {k: (30, sum(v)) for k, v in draws.items()}
    assert [r["n"] for r in streams if r["series_id"] == "B"] == [17] * 2 * reps
    single = {r["block_length"]: r for r in backtest.bootstrap_p05(spark, "").collect() if r["series_id"] == "A"}
    cluster = {r["block_length"]: r for r in backtest.cluster_bootstrap_p05(spark, "").collect()}
    for length in (52, 78):
        at = [draws[length, r] for r in range(reps)]
        gain, ceq = [1 - p[i].mean() / b[i].mean() for i in at], [52 * (y[i].mean() - 0.5 * y[i].var(ddof=1)) for i in at]
        assert single[length]["gain_p05"] == pytest.approx(np.quantile(gain, 0.05), abs=2e-6) == cluster[length]["gain_p05"]
        assert single[length]["ceq_p05"] == pytest.approx(np.quantile(ceq, 0.05), abs=2e-6)
        assert cluster[length]["gain_mean"] == pytest.approx(np.mean(gain), abs=2e-6)


def test_registered_fit_has_production_starts(spark, monkeypatch):
    from tidemark.plans import walkforward as WF
    from tidemark.queries import modelling

    asked = {}
    monkeypatch.setattr(modelling, "weekly_returns_df", lambda spark, d: None)
    monkeypatch.setattr(WF, "best_hmm", lambda returns, **given: asked.update(given))
    modelling.hmm_fit(spark, "")
    assert asked == {"restarts": 50, "iterations": 200}


def test_hmm_fit_improves():
    from tidemark.models import hmm

    g = np.random.Generator(np.random.PCG64(6))
    x = np.concatenate([g.normal(m, 0.3, 60) for m in (-2, 0, 2)])[:, None]
    short, long = hmm.fit_once(x, np.zeros(180), 1, 1), hmm.fit_once(x, np.zeros(180), 1, 60)
    assert long.loglik > short.loglik and sorted(long.means[:, 0].round()) == [-2, 0, 2]


def test_pca():
    from tidemark.models.pca import shrunk_covariance, two_components

    g = np.random.Generator(np.random.PCG64(7))
    x = g.standard_normal((60, 4)) * [3, 1, 0.5, 0.2]
    s = two_components(x)
    assert s == pytest.approx(two_components(x + [5, -3, 2, 1]))
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / 60
    noise = sum(((np.outer(r, r) - cov) ** 2).sum() for r in centred) / 3600 / ((cov - np.diag(np.diag(cov))) ** 2).sum()
    k = min(1, noise)
    assert shrunk_covariance(centred) == pytest.approx((1 - k) * cov + k * np.diag(np.diag(cov)))


def test_distributions():
    from tidemark.models import numerics as N

    assert N.t_cdf(2.015, 5) == pytest.approx(0.95, abs=2e-4) and N.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    grid = np.linspace(-60, 60, 400001)
    assert np.trapezoid(np.exp(N.t_logpdf(grid, 6.0)) * grid**2, grid) == pytest.approx(1, abs=1e-3)
    assert N.isotonic(np.array([1.0, 3, 2, 2, 5])).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])
    assert N.isotonic_at(np.array([1, 2, 3]), np.array([10, 20, 30]), np.array([0, 2.5, 9])).tolist() == [10, 20, 30]
    x, v, ok = N.nelder_mead(lambda p: (p[0] - 1) ** 2 + 3 * (p[1] + 2) ** 2, np.zeros(2))
    assert ok and x == pytest.approx([1, -2], abs=1e-3)


def test_garch_and_tail():
    from tidemark.models import scale

    g = np.random.Generator(np.random.PCG64(8))
    r = g.standard_normal(250) * 0.02
    for kind in ("egarch", "gjr"):
        _, nll, sigma = scale.fit_garch(r, kind, "normal")
        assert 0.01 < sigma < 0.04 and np.isfinite(nll)
    k, nu = scale.fit_tail(g.standard_t(5, 4000) * math.sqrt(3 / 5) * 2)
    assert k == pytest.approx(2, rel=0.1) and 3.5 < nu < 8


def test_state_inputs_and_decision_stats():
    from tidemark.models.pca import two_components
    from tidemark.plans import training

    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 5))
    obs, h = training.state_inputs(x)
    pc = two_components(x)
    assert np.allclose(obs, np.column_stack([pc[1:], np.diff(pc, axis=0), x[1:, 3], x[1:, 4]])) and np.allclose(h, x[1:, 1] + 0.5 * x[1:, 4])
    with pytest.raises(ValueError):
        training.state_inputs(x[:2])
    q = np.sort(rng.normal(size=(40, 5)), axis=1)
    full = training.full_curve(q)
    mean, es, loss = training.moments(full)
    grid = np.linspace(0.05, 0.95, 200_001)
    line = np.interp(grid, training.TAUS, full[3])
    assert mean[3] == pytest.approx(line.mean(), abs=1e-4) and es[3] == pytest.approx(-line[grid <= 0.2].mean(), abs=1e-4)
    assert loss[3] == pytest.approx(np.interp(0, full[3], training.TAUS, left=0, right=1))
    stats, cuts = training.decision_stats(full)
    assert set(stats) == {f"{a}_{b}" for a in ("er", "es20", "ploss") for b in ("med", "mad")} and list(cuts.values()) == sorted(cuts.values())
    golden = training.moments(np.array([[-0.30, -0.20, -0.10, 0, 0.10, 0.20, 0.30]]))
    assert [float(v[0]) for v in golden] == pytest.approx([0, 0.19444444444444445, 0.5])


def test_training_job_writes_and_reads_six_files(spark, monkeypatch):
    import json

    from tidemark.plans import training
    from tidemark.queries import panel

    rng = np.random.default_rng(5)
    start = dt.date(2000, 1, 7)
    rows = []
    for s, n in (("A", 120), ("B", 100), ("C", 40)):
        for k in range(n):
            x = rng.normal(size=5)
            rows.append((s, start + dt.timedelta(weeks=k), *map(float, x), *map(float, 10 * x), float(0.1 * x[0] + rng.normal() / 10)))
    df = spark.createDataFrame(rows, "series_id string, week date, " + ", ".join(f"{n} double" for n in [*panel.ZS, *panel.XS, "y"]))
    made = {(r["series_id"], r["file"]): r["text"] for r in training.trained(df, panel.ZS, panel.XS, restarts=4, iterations=8, together=2).collect()}
    files = {"utility_zstats.json", "offense_thresholds.json", "state_label_map.json", "train_distributions.json", "qr_coefs.json", "hmm_model.json"}
    assert set(made) == {(s, f) for s in "AB" for f in files}, "a series with too few rows has no artifact"
    for text in made.values():
        assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    assert len(json.loads(made["A", "train_distributions.json"])["x1"]) == 120 - training.EMBARGO - 1
    assert json.loads(made["A", "state_label_map.json"]) == json.loads(made["A", "hmm_model.json"])["label_map"]
    again = {(r["series_id"], r["file"]): r["text"] for r in training.trained(df, panel.ZS, panel.XS, restarts=4, iterations=8, together=1).collect()}
    assert again == made
    assert "hmm_model.json" not in training.artifact(rng.normal(size=(80, 5)), rng.normal(size=(80, 5)), rng.normal(size=80), None, 5)
    monkeypatch.setattr(panel, "training_files", lambda spark, d: spark.createDataFrame([(s, f, t) for (s, f), t in made.items()], "series_id string, file string, text string"))
    job = panel.training_job(spark, "").collect()
    assert len(job) == len(made) and all(r["round_trip"] and r["n_bytes"] == len(made[r["series_id"], r["file"]]) for r in job)


def test_masked_fill_rejects_available_values_that_are_not_finite(spark):
    from pyspark.sql import functions as F

    from tidemark.queries.panel import filled

    df = spark.createDataFrame([(1.5, True), (None, False), (float("nan"), False)], "x double, ok boolean")
    assert [r[0] for r in df.select(filled("x", "ok")).collect()] == [1.5, 0.0, 0.0]
    for bad in (float("inf"), float("nan"), None):
        with pytest.raises(Exception, match="not finite"):
            spark.createDataFrame([(bad, True)], "x double, ok boolean").select(filled("x", "ok")).collect()
    assert df.select(F.lit(1)).count() == 3
