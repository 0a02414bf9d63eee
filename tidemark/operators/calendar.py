"""Fridays, weekly spines and eligibility scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weeks of history a model is trained on, and weeks between the last training row and the forecast.
MIN_TRAIN, EMBARGO, HORIZON = 312, 53, 52


def next_friday(day: Column | str) -> Column:
    """The Friday on or after a day."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def is_friday(day: Column | str) -> Column:
    return F.weekday(day) == 4


def weeks_between(first: Column | str, last: Column | str) -> Column:
    """Fridays from first to last, both included."""
    return F.floor(F.datediff(last, first) / 7) + 1


def spine(obs: DataFrame) -> DataFrame:
    """Every Friday from the first observation's to the last one's, holidays included: one row each. Reversed bounds give no rows."""
    ends = obs.agg(next_friday(F.min("obs_date")).alias("a"), next_friday(F.max("obs_date")).alias("z")).where("a <= z")
    return ends.select(F.explode(F.expr("sequence(a, z, interval 7 days)")).alias("week"))


def observed_spine(obs: DataFrame) -> DataFrame:
    """Fridays on which the series has a row."""
    return obs.where(is_friday("obs_date")).select(F.col("obs_date").alias("week")).distinct()


def strict_start(first_vintages: DataFrame, min_train: int = MIN_TRAIN, embargo: int = EMBARGO) -> DataFrame:
    """Closed form: the Friday after the latest first vintage, plus training, less one, and embargo weeks."""
    return first_vintages.agg(F.date_add(next_friday(F.max("first_date")), 7 * (min_train - 1 + embargo)).alias("effective_start"))


def eligible_weeks(weekly: DataFrame, ok: Column, min_train: int, embargo: int, keys: list[str]) -> DataFrame:
    """weekly (keys, week, ...): with n_train, the complete weeks at least embargo weeks earlier, and eligible."""
    order = Window.partitionBy(*keys).orderBy(F.unix_date("week")).rangeBetween(Window.unboundedPreceding, -7 * embargo)
    counted = weekly.withColumn("n_train", F.coalesce(F.sum(F.when(ok, 1).otherwise(0)).over(order), F.lit(0)))
    return counted.withColumn("eligible", F.coalesce(ok, F.lit(False)) & (F.col("n_train") >= min_train))


def effective_start(weekly: DataFrame, ok: Column, min_train: int, embargo: int, keys: list[str]) -> DataFrame:
    """First eligible week by keys; null where there is none."""
    return eligible_weeks(weekly, ok, min_train, embargo, keys).groupBy(*keys).agg(F.min(F.when(F.col("eligible"), F.col("week"))).alias("effective_start"))
