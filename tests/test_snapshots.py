"""The cache-through source: filled once, pruned by filters."""

import datetime as dt
import io
import json
import random
import tracemalloc

import pytest

from tidemark.sources.scratch import Folder
from tidemark.sources.snapshots import BLOCK, RUN, WAIVED, Reader, Snapshot, in_order, observations, read_snapshots


def answers(spark, path):
    obs = lambda *rows: json.dumps({"observations": [dict(zip(("date", "value", "realtime_start", "realtime_end"), r)) for r in rows]})
    a = obs(("2020-01-01", "1.0", "2020-01-05", "2020-02-01"), ("2020-01-01", "1.5", "2020-02-02", "9999-12-31"), ("2020-01-02", ".", "2020-01-05", "9999-12-31"))
    b = obs(("2020-01-01", "7", "2020-03-01", "9999-12-31"))
    spark.createDataFrame([("A", a), ("B", b)], "series_id string, value string").write.mode("append").partitionBy("series_id").text(path)


def files(path):
    from pathlib import Path

    root = Path(path.removeprefix("file://"))
    return sorted(str(p.relative_to(root)) for p in root.rglob("*.json"))


def test_snapshots_are_filled_once_and_stay(spark):
    tmp = Folder(spark, "snapshots")
    service, cache = tmp.path(), tmp.path()
    answers(spark, service)
    read = lambda: read_snapshots(spark, cache, service, ["A", "B", "C"], ["2020-01-10", "2020-02-10"], ("B",))
    first = sorted((r.series_id, str(r.as_of), r.value) for r in read().collect())
    assert first == [("A", "2020-01-10", 1.0), ("A", "2020-02-10", 1.5), ("B", "2020-01-10", 7.0), ("B", "2020-02-10", 7.0)]
    assert len(files(cache)) == 6
    kept = json.loads(open(cache.removeprefix("file://") + "/B/2020-01-10.json").read())
    assert kept[WAIVED] is True and len(kept["observations"]) == 1
    answers(spark, service)  # the service now says everything twice; the snapshots don't change
    assert sorted((r.series_id, str(r.as_of), r.value) for r in read().collect()) == first


def test_filters_choose_the_files(spark):
    tmp = Folder(spark, "snapshots")
    service, cache = tmp.path(), tmp.path()
    answers(spark, service)
    rows = read_snapshots(spark, cache, service, ["A", "B"], ["2020-01-10", "2020-02-10", "2020-03-10"])
    some = rows.where("series_id = 'A' and as_of >= date'2020-02-01' and value > 1")
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.splitlines() if "Filter" in line)  # what the source hasn't taken over
    assert "value" in left and "series_id" not in left and "as_of" not in left
    assert some.rdd.getNumPartitions() == 2
    assert [r.value for r in some.collect()] == [1.5, 1.5]
    assert files(cache) == ["A/2020-02-10.json", "A/2020-03-10.json"]
    assert rows.where("series_id in ('B') and as_of <= date'2020-01-31'").count() == 0 and "B/2020-01-10.json" in files(cache)


def test_a_snapshot_takes_no_more_memory_for_more_vintages(tmp_path):
    """Memory of filling and reading a snapshot, over 20,000 and 200,000 vintages of 500 days; it was that of all vintages."""

    def peak(vintages, days=500):
        root = tmp_path / str(vintages)
        (root / "service" / "series_id=A").mkdir(parents=True)
        first = dt.date(2000, 1, 1)
        with open(root / "service" / "series_id=A" / "part-0", "w") as f:
            for k in range(days):
                day, n = str(first + dt.timedelta(k)), vintages // days
                known = [str(first + dt.timedelta(days + j)) for j in range(n)] + ["9999-12-31"]
                f.write(json.dumps({"observations": [{"date": day, "value": str(k + j / n), "realtime_start": known[j], "realtime_end": known[j + 1] if j == n - 1 else str(dt.date.fromisoformat(known[j + 1]) - dt.timedelta(1))} for j in range(n)]}) + "\n")
        reader = Reader({"cache": f"file://{root}/cache", "service": f"file://{root}/service", "series": '["A"]', "days": '["2002-01-01"]'})
        next(reader.read(Snapshot("A", dt.date(1999, 1, 1))), None)  # imports
        tracemalloc.start()
        try:
            n = sum(1 for _ in reader.read(Snapshot("A", dt.date(2002, 1, 1))))
            return n, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (n_small, small), (n_large, large) = peak(20_000), peak(200_000)
    assert n_small == n_large == 500
    assert large < 1.5 * small and large < 8e6


def test_observations_are_read_across_blocks_and_lines():
    one = [{"date": f"2020-01-{k % 28 + 1:02d}", "value": "}]\"é, " * (k % 5)} for k in range(20_000)]
    text = json.dumps({"client_side_pit": True, "observations": one}, ensure_ascii=False) + "\n" + json.dumps({"observations": []}) + "\n" + json.dumps({"observations": one[:3]}, indent=1) + "\n"
    assert len(text) > 3 * BLOCK
    assert list(observations(io.BytesIO(text.encode()))) == one + one[:3]
    assert list(observations(io.BytesIO(b""))) == []
    for broken in (text[: len(text) // 2], "{}"):
        with pytest.raises(ValueError):
            list(observations(io.BytesIO(broken.encode())))


def test_runs_are_merged_in_order():
    rows = [{"date": str(k % 700), "realtime_start": str(k), "value": "1"} for k in range(1_000)]
    random.Random(1).shuffle(rows)
    want = sorted(rows, key=lambda o: (o["date"], o["realtime_start"]))
    assert [list(in_order(rows, size)) for size in (7, 1_000, RUN)] == [want] * 3


def test_totals_do_not_depend_on_the_order_of_rows(spark):
    """Halves of a cent: in doubles, some orders of these rows come out below, others above."""
    from tidemark.queries.storage import total

    values = [45155.31333333333, 43128.94333333333, 24730.023333333334, 78879.36666666667, 51642.23666666667, 42275.33666666667] * 20 + [0.005, 0.1, 0.2, 0.3, 1e6 / 3, 1e6 / 3, 1e6 / 3]
    cents = {}
    for seed in range(6):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "value double").coalesce(1)
        cents[seed] = df.agg(total("value")).first()[0]
    assert set(cents.values()) == {6716225.01}
