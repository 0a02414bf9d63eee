"""The challenger as a stream: parameters, training rows and waiting weeks are state, weeks are timers.

A week is predicted once the watermark has passed it, so rows may come in any order within the watermark's delay. Then the
model is fitted again if it is 13 weeks old, from the parameters before, on the rows at least the embargo older. State is
the fit (a value), the rows seen (a list) and the weeks to predict (timers); a restart goes on from the checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NAMES = ["q05", "q10", "q25", "q50", "q75", "q90", "q95"]
FORECASTS = "series_id string, as_of date, fitted date, n_train long, objective double, status string, " + ", ".join(f"{q} double" for q in NAMES)
DAY = 86_400_000


def as_day(ms: int) -> dt.date:
    return dt.date(1970, 1, 1) + dt.timedelta(days=ms // DAY)


class Challenger(StatefulProcessor):
    """Rows (series_id, week timestamp, x, y) -> FORECASTS. Rows of a week that is already predicted only train."""

    def __init__(self, every: int, min_train: int, embargo: int):
        self.every, self.min_train, self.embargo = every, min_train, embargo

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fit = handle.getValueState("fit", "theta array<double>, fitted date, n long, objective double, status string")
        self.rows = handle.getListState("rows", "week date, x double, y double")
        self.newest = handle.getValueState("newest", "week date")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.newest.get()[0] if self.newest.exists() else None
        for pdf in rows:
            week = pd.to_datetime(pdf["week"])
            self.rows.appendList([(w.date(), float(x), float(y)) for w, x, y in zip(week, pdf["x"], pdf["y"])])
            for w in week:
                if seen is None or w.date() > seen:
                    self.handle.registerTimer(int(w.timestamp() * 1000))
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in FORECASTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        from tidemark.models import scale

        as_of = as_day(expiredTimerInfo.getExpiryTimeInMs())
        self.newest.update((as_of,))
        known = sorted(set(tuple(r) for r in self.rows.get()))
        week = np.array([r[0] for r in known], "datetime64[D]")
        n = int(np.searchsorted(week, np.datetime64(as_of) - np.timedelta64(7 * self.embargo, "D"), "right"))
        if n < self.min_train:
            return
        theta, fitted, used, value, status = self.fit.get() if self.fit.exists() else (None, None, 0, 0.0, "")
        if fitted is None or as_of >= fitted + dt.timedelta(weeks=self.every):
            x, y = np.array([[r[1]] for r in known[:n]]), np.array([r[2] for r in known[:n]])
            theta, value, status = scale.fit_student(x, np.ones((n, 1)), y, None if theta is None else np.array(theta), 40)
            fitted, used = as_of, n
            self.fit.update(([float(t) for t in theta], fitted, used, float(value), status))
        theta = np.array(theta)
        out = []
        for w, x, _ in (r for r in known if r[0] == as_of):
            q = scale.student_quantiles(np.array([theta[0] + x * theta[1]]), np.exp(np.clip(theta[-1:], -8, 3)))[0]
            out.append((key[0], w, fitted, used, round(value, 5), status, *q.round(5)))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in FORECASTS.split(", ")])


def challenger_stream(rows: DataFrame, every: int, min_train: int, embargo: int, delay: str = "7 days") -> DataFrame:
    """rows: a stream (series_id, week timestamp, x, y) -> FORECASTS of each week that the watermark has passed."""
    return rows.withWatermark("week", delay).groupBy("series_id").transformWithStateInPandas(Challenger(every, min_train, embargo), FORECASTS, "Append", "EventTime")
