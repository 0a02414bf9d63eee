"""Streams: weeks under revision, held scores and the challenger, each restarted in mid-stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, query
from tidemark.queries.distribution import raw_scores
from tidemark.queries.modelling import pairs
from tidemark.sources import tables as T
from tidemark.sources.scratch import Folder
from tidemark.streaming import refits, revisions, weekly
from tidemark.streaming.runs import replayed

MIDDLE = "1998-06-26"


def halves(rows, by: str) -> list:
    return [rows.where(F.col(by) <= F.lit(MIDDLE).cast("date")), rows.where(F.col(by) > F.lit(MIDDLE).cast("date"))]


@query(
    f"""WITH {T.VINTAGES}, l AS (SELECT series_id, obs_date, arg_max(value, realtime_start) AS value FROM vintages GROUP BY 1, 2)
SELECT series_id, CAST({T.friday('obs_date')} AS DATE) AS week, arg_max(value, obs_date) AS value FROM l GROUP BY 1, 2"""
)
def revised_weeks_stream(spark, d):
    """The last state of every week after all vintages have arrived as a stream, by knowledge time, in two runs."""
    known = T.vintages(spark, d).select("series_id", "obs_date", "value", "realtime_start")
    changes = replayed(spark, halves(known, "realtime_start"), revisions.revised_weeks, "revisions")
    return revisions.latest(changes).select("series_id", "week", "value")


@query(ORACLES["hysteresis"])
def held_scores_stream(spark, d):
    """The hysteresis fold with its state in a stream that is restarted in mid-1998."""
    raw = Folder(spark, "scores").cut(raw_scores(spark, d).select("series_id", "week", F.round("raw", 6).alias("raw")))
    out = replayed(spark, halves(raw, "week"), weekly.held_scores, "held")
    return out.select("series_id", "week", F.round("final", 4).alias("final"))


@query()
def challenger_stream(spark, d):
    """challenger_run as a stream: weeks are timers, parameters are state; restarted in mid-1998."""
    rows = Folder(spark, "pairs").cut(pairs(spark, d).select("series_id", F.col("week").cast("timestamp").alias("week"), "x", "y"))
    return replayed(spark, halves(rows, "week"), lambda s: refits.challenger_stream(s, every=13, min_train=52, embargo=14), "challenger")
