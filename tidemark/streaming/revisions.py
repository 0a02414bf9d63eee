"""Weeks from a stream of vintages: late and revised observations change weeks that are already out.

Each week of each series is its own state: the newest vintage of each of its days. A row that changes the week's value
retracts what was put out before; the changes, in order, are the result. Its last state is the batch over all vintages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.calendar import next_friday

CHANGES = "series_id string, week date, version long, kind string, value double, known date"
NAMES = [c.split(" ")[0] for c in CHANGES.split(", ")]


class Weeks(StatefulProcessor):
    """Rows (series_id, week, obs_date, value, realtime_start) -> CHANGES. kind: insert, or retract (the value before) and
    then revise. Rows of one trigger are taken by knowledge time; an older vintage than the one at hand changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day date", "known date, value double")
        self.out = handle.getValueState("out", "version long, value double, known date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        series, week = key
        pdf = pd.concat(list(rows)).sort_values(["realtime_start", "obs_date"])
        days = {k[0]: v for k, v in self.days.iterator()}
        changed, out = {}, []
        version, value, known = self.out.get() if self.out.exists() else (0, None, None)
        for day, v, start in zip(pdf["obs_date"], pdf["value"], pdf["realtime_start"]):
            v = None if pd.isna(v) else float(v)
            if day in days and days[day][0] > start:
                continue
            days[day] = changed[day] = (start, v)
            now = days[max(days)][1]
            if version and now == value:
                continue
            if version:
                out.append((series, week, version + 1, "retract", value, start))
            out.append((series, week, version + 1 + bool(version), "revise" if version else "insert", now, start))
            version, value, known = out[-1][2], now, start
        for day, entry in changed.items():
            self.days.updateValue((day,), entry)
        if out:
            self.out.update((version, value, known))
        yield pd.DataFrame(out, columns=NAMES)


def revised_weeks(vintages: DataFrame) -> DataFrame:
    """vintages: a stream (series_id, obs_date, value, realtime_start) -> CHANGES."""
    rows = vintages.select("series_id", next_friday("obs_date").alias("week"), "obs_date", "value", "realtime_start")
    return rows.groupBy("series_id", "week").transformWithStateInPandas(Weeks(), CHANGES, "Append", "None")


def latest(changes: DataFrame) -> DataFrame:
    """The state after all changes, and how often each week was revised."""
    last = F.max_by(F.struct("value"), "version").alias("v")
    return changes.groupBy("series_id", "week").agg(last, F.count_if(F.col("kind") == "revise").alias("n_revisions")).select("series_id", "week", F.col("v.value").alias("value"), "n_revisions")
