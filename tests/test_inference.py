"""Weekly inference from stored training files, and what is wrong with them as modes."""

import datetime as dt
import json

import numpy as np
import pytest

from tidemark.models import hmm
from tidemark.plans import training

NAMES = [f"z{k}" for k in range(1, 6)]


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    y = 0.2 * x[:, 0] + rng.normal(size=120) / 5
    return x, y, training.artifact(x[:100], 10 * x[:100], y[:100], 1, 20)


def test_weeks_from_stored_files(spark, made):
    x, _, files = made
    start = dt.date(2020, 1, 3)
    week = [start + dt.timedelta(weeks=t) for t in range(120)]
    gap = x.copy()
    gap[110, 2] = np.nan
    broken = {
        "good": files,
        "none": {},
        "half": {k: v for k, v in files.items() if k != "hmm_model.json"},
        "torn": files | {"qr_coefs.json": files["qr_coefs.json"][:40]},
        "unsolved": files | {"qr_coefs.json": training.compact(json.loads(files["qr_coefs.json"]) | {"solver_status": "failed"})},
    }
    rows = spark.createDataFrame([(s, w, *map(float, r)) for s in broken for w, r in zip(week, gap)], "series_id string, week date, " + ", ".join(f"{n} double" for n in NAMES))
    stored = spark.createDataFrame([(s, k, v) for s, f in broken.items() for k, v in f.items()], "series_id string, file string, text string")
    first = spark.createDataFrame([(s, week[100]) for s in broken], "series_id string, first date")
    out = {(r.series_id, r.week): r for r in training.inferred(rows, NAMES, stored, first).collect()}
    assert len(out) == 5 * 20
    state = {"none": ("BLOCKED", "no_artifact"), "half": ("DEGRADED", "em_nonconverge"), "torn": ("BLOCKED", "invalid_artifact"), "unsolved": ("BLOCKED", "quantile_solver_failed")}
    for (s, w), r in out.items():
        if s in state and w != week[110]:
            assert (r.mode, r.reason) == state[s] and r.stance == "NEUTRAL" and r.offense == 50 and r.q50 == (0 if s == "half" else None)
    assert out["good", week[110]].reason == "missing_features"
    coef = json.loads(files["qr_coefs.json"])
    coef = np.column_stack([coef["a"], coef["b"], coef["c"]])
    m = json.loads(files["hmm_model.json"])
    model = hmm.Hmm(np.full(3, 1 / 3), np.array(m["transition_coefs"]), np.array(m["emission_mean"]), np.array(m["emission_cov"]))
    for t in (100, 105, 119):
        r = out["good", week[t]]
        seen = gap[: t + 1][np.isfinite(gap[: t + 1]).all(axis=1)]
        pi = hmm.posterior_path(model, *training.state_inputs(seen))[-1]
        inner = np.maximum.accumulate(coef @ np.r_[1, x[t], pi[:-1]])
        assert r.mode == "NORMAL" and [r.p1, r.p2, r.p3] == pytest.approx(pi, abs=1e-5)
        assert [r.q10, r.q25, r.q50, r.q75, r.q90] == pytest.approx(inner, abs=1e-5)
        stats, cuts = json.loads(files["utility_zstats.json"]), json.loads(files["offense_thresholds.json"])
        er, es, loss = (float(v[0]) for v in training.moments(training.full_curve(inner[None])))
        z = lambda v, n: (v - stats[f"{n}_med"]) / stats[f"{n}_mad"]
        u = z(er, "er") - 1.2 * z(es, "es20") - 0.8 * z(loss, "ploss")
        assert r.offense == pytest.approx(np.interp(u, sorted(cuts.values()), [0, 20, 40, 60, 80, 100]), abs=1e-3)
        assert r.stance == ("DEFENSIVE" if r.offense <= 35 else "OFFENSIVE" if r.offense >= 65 else "NEUTRAL")
        assert r.state == json.loads(files["state_label_map.json"])[str(int(pi.argmax()))] and 0 <= r.offense <= 100
