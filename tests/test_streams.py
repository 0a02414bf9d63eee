"""Streams that are restarted in mid-stream against batches over the same rows."""

import datetime as dt
import random

import numpy as np

from tidemark.plans import walkforward
from tidemark.streaming import refits, revisions
from tidemark.streaming.runs import replayed

START = dt.date(2020, 1, 3)


def test_challenger_equals_the_batch_run(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s, n in (("A", 90), ("B", 84)):
        for t in range(n):
            if (s, t) not in (("A", 40), ("A", 41)):
                x = float(rng.normal())
                rows.append((s, START + dt.timedelta(weeks=t), x, 0.2 * x + float(rng.normal()) / 3))
    schema = "series_id string, week date, x double, y double"
    batch = {(r.series_id, r.as_of): r for r in walkforward.challenger(spark.createDataFrame(rows, schema), every=13, min_train=52, embargo=4).collect()}
    parts = [[r for r in rows if a <= (r[1] - START).days < b] for a, b in ((0, 370), (370, 500), (500, 9999))]
    # late within the delay: this week comes with the part after its own
    late = next(r for r in parts[1] if r[0] == "B" and r[1] == max(x[1] for x in parts[1]))
    parts[1].remove(late)
    parts[2].append(late)
    frames = [spark.createDataFrame(random.Random(k).sample(p, len(p)), schema).selectExpr("series_id", "cast(week as timestamp) week", "x", "y") for k, p in enumerate(parts)]
    out = {(r.series_id, r.as_of): r for r in replayed(spark, frames, lambda s: refits.challenger_stream(s, 13, 52, 4, "21 days"), "challenger").collect()}
    passed = max(r[1] for r in rows) - dt.timedelta(days=21)
    assert out.keys() == {k for k in batch if k[1] <= passed} and ("B", late[1]) in out
    for key, r in out.items():
        assert r.asDict() == batch[key].asDict()
    assert len({r.fitted for r in out.values()}) > 2


def test_revised_weeks_equal_the_batch_over_vintages(spark):
    rng = random.Random(2)
    rows = []
    for s in "AB":
        for t in range(40):
            day = START + dt.timedelta(days=t)
            for k in range(rng.choice([1, 1, 2, 3])):
                value = None if rng.random() < 0.1 else float(rng.randint(1, 5))
                rows.append((s, day, value, day + dt.timedelta(days=9 * k + rng.randint(0, 3))))
    rows = list({(r[0], r[1], r[3]): r for r in rows}.values())
    rows.sort(key=lambda r: r[3])
    schema = "series_id string, obs_date date, value double, realtime_start date"
    cut = len(rows) // 2
    # an older vintage that comes last changes nothing
    parts = [rows[:cut], rows[cut + 1 :], [rows[cut]]]
    changes = replayed(spark, [spark.createDataFrame(p, schema) for p in parts], revisions.revised_weeks, "weeks").collect()
    friday = lambda d: d + dt.timedelta(days=(4 - d.weekday()) % 7)
    newest = {}
    for s, day, value, known in rows:
        if (s, day) not in newest or known > newest[s, day][0]:
            newest[s, day] = (known, value)
    want = {}
    for (s, day), (_, value) in sorted(newest.items()):
        want[s, friday(day)] = value
    got = {(r.series_id, r.week): r.value for r in revisions.latest(spark.createDataFrame(changes, revisions.CHANGES)).collect()}
    assert got == want
    by_week = {}
    for r in sorted(changes, key=lambda r: (r.series_id, r.week, r.version)):
        by_week.setdefault((r.series_id, r.week), []).append(r)
    assert any(len(v) > 1 for v in by_week.values())
    for log in by_week.values():
        assert [r.version for r in log] == list(range(1, len(log) + 1))
        assert log[0].kind == "insert" and [r.kind for r in log[1:]] == ["retract", "revise"] * (len(log) // 2)
        for before, gone in zip(log[::2], log[1::2]):
            assert gone.value == before.value
