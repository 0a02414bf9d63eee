"""The weekly replay as a stream: observations arrive, weeks close behind a watermark, scores carry state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.calendar import next_friday

SCORE = "series_id string, week date, raw double, final double"


def closed_weeks(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """stream (series_id, obs_time timestamp, value): last value of each Friday week, put out once the watermark has passed
    the week. Later revisions of a closed week are dropped; the batch path over vintages is the place for those."""
    week = F.window("obs_time", "7 days", startTime="2 days")  # windows from Saturday to Friday
    rows = stream.withColumn("obs_time", F.col("obs_time").cast("timestamp")).withWatermark("obs_time", delay)
    out = rows.groupBy("series_id", week.alias("w")).agg(F.max_by("value", "obs_time").alias("value"))
    return out.select("series_id", next_friday(F.to_date("w.start")).alias("week"), "value")


def held_scores(stream: DataFrame, start: float = 50.0, band: float = 7.0) -> DataFrame:
    """stream (series_id, week, raw) -> SCORE: each series keeps its last score unless the raw one differs by the band or more.
    The state is one number for each series. Weeks of one trigger are taken in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values("week")
        final = []
        for raw in rows["raw"]:
            last = last if abs(raw - last) < band else float(raw)
            final.append(last)
        state.update((last,))
        yield pd.DataFrame({"series_id": key[0], "week": rows["week"].to_numpy(), "raw": rows["raw"].to_numpy(), "final": final})

    return stream.groupBy("series_id").applyInPandasWithState(step, SCORE, "last double", "append", "NoTimeout")
