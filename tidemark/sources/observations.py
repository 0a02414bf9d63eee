"""Scans and sinks of point-in-time data: vintage JSON, price histories, weekly records."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAYLOAD = "series_id string, observations array<struct<date:string,value:string,realtime_start:string,realtime_end:string>>"
#: How missing values are written in the payload.
MISSING = "."
#: Series that are never revised: their latest values are right for any day.
UNREVISED = ("5-LOW",)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Cached service answers (JSON, one document a line) as typed observations; missing values are dropped."""
    rows = spark.read.schema(PAYLOAD).json(path).select("series_id", F.explode("observations").alias("o"))
    return typed(rows.select("series_id", "o.*"))


def typed(rows: DataFrame) -> DataFrame:
    """Strings as dates and numbers. What doesn't parse is null, but for the missing mark, whose rows go."""
    day = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return rows.where(F.col("value") != MISSING).select("series_id", day(F.col("date")).alias("obs_date"), F.expr("try_cast(value AS double)").alias("value"), day(F.col("realtime_start")).alias("realtime_start"), day(F.col("realtime_end")).alias("realtime_end"))


def snapshot(df: DataFrame, root: str) -> None:
    """Writes each (series_id, as_of) once: a snapshot that is there already stays as it is."""
    df.write.mode("ignore").partitionBy("series_id", "as_of").parquet(root)


def guarded(obs: DataFrame, as_of: Column, enforce: bool = True) -> DataFrame:
    """Fails on any row from the future of as_of."""
    ahead = (F.col("obs_date") > as_of) | ((F.col("realtime_start") > as_of) if enforce else F.lit(False))
    return obs.where(F.assert_true(~F.coalesce(ahead, F.lit(False)), F.lit("an observation is later than as_of")).isNull())


def guard_counts(obs: DataFrame, as_of: Column) -> DataFrame:
    late_start, late_obs = F.col("realtime_start") > as_of, F.col("obs_date") > as_of
    return obs.groupBy("series_id").agg(F.count_if(late_start).alias("n_late_vintage"), F.count_if(late_obs).alias("n_late_obs"), F.count("*").alias("n"))


def routed(vintages: DataFrame, as_of: Column, strict: bool = True, unrevised: tuple[str, ...] = UNREVISED) -> DataFrame:
    """The vintage as of a day for series that are revised, in strict mode; the latest value for all others."""
    before = vintages.where(F.col("obs_date") <= as_of)
    latest = Window.partitionBy("series_id", "obs_date").orderBy(F.desc("realtime_start"))
    fixed = F.lit(not strict) | F.col("series_id").isin(*unrevised)
    seen = before.where(fixed | (F.col("realtime_start") <= as_of))
    return seen.withColumn("i", F.row_number().over(latest)).where("i = 1").select("series_id", "obs_date", "value")


def available(obs: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Registry rows with ok: not denied, and first published by as_of."""
    return registry.withColumn("ok", ~F.col("denied") & (F.col("first_vintage") <= as_of))


def conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dates on which both histories have a row, with different values: an append-only cache must have none."""
    both = old.select("series_id", "obs_date", F.col("value").alias("old_value")).join(new.select("series_id", "obs_date", F.col("value").alias("new_value")), ["series_id", "obs_date"])
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new by (series_id, obs_date), the old row where both have one."""
    both = old.withColumn("from_new", F.lit(0)).unionByName(new.withColumn("from_new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("series_id", "obs_date").orderBy("from_new", "value"))
    return both.withColumn("i", first).where("i = 1").select("series_id", "obs_date", "value")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """appended(), unless the histories disagree."""
    if not conflicts(old, new).isEmpty():
        raise ValueError("histories disagree on dates that both have")
    return appended(old, new)


def write_records(df: DataFrame, root: str) -> None:
    """Weekly records, one directory per as_of. Each record lies in the file of its as_of, whatever the number of tasks."""
    df.repartition("as_of").write.mode("overwrite").partitionBy("as_of").json(root)


def read_records(spark: SparkSession, root: str, first: str, last: str) -> DataFrame:
    """Records of a closed range of as_of; other directories aren't read."""
    return spark.read.json(root).where(F.col("as_of").cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def record_text(record: dict[str, Any]) -> str:
    """One record as bytes that depend on its content only: keys in order, no blanks, ASCII, a line feed at the end."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False) + "\n"


def checked_files(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """digests (name, sha256) with ok: the file is there and has that digest."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("seen"))
    return digests.join(files, "name", "left").select("name", F.coalesce(F.lower("sha256") == F.col("seen"), F.lit(False)).alias("ok"))


def latest_files(obs: DataFrame) -> DataFrame:
    """Rows of each series' latest as_of."""
    last = Window.partitionBy("series_id")
    return obs.withColumn("last", F.max("as_of").over(last)).where("as_of = last").drop("last")
