"""Point-in-time joins: as-of values, calendar lags, forward returns, fills, embargoed training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import next_friday

TOLERANCE = 6


def known_at(vintages: DataFrame, as_of: Column) -> DataFrame:
    """Rows of a bitemporal table as they stood on a day."""
    return vintages.where((F.col("obs_date") <= as_of) & (F.col("realtime_start") <= as_of) & (as_of <= F.col("realtime_end")))


def weekly_values(obs: DataFrame) -> DataFrame:
    """Last observation of each Friday week. As the weeks tile the calendar, this is the as-of join with six days' tolerance
    without a join; a last observation that is missing stays missing."""
    return obs.groupBy("series_id", next_friday("obs_date").alias("week")).agg(F.max_by("value", "obs_date").alias("value"))


def as_of(days: DataFrame, obs: DataFrame, tolerance: int | None = TOLERANCE) -> DataFrame:
    """days (as_of) x series: the last value at most `tolerance` days old, for days off the spine. Days and observations meet
    in buckets of tolerance + 1 days, so the join is an equi-join; without tolerance, obs are carried forward by a window."""
    if tolerance is None:
        series = obs.select("series_id").distinct()
        both = obs.select("series_id", F.col("obs_date").alias("day"), "value", F.lit(0).alias("asked")).unionByName(days.crossJoin(F.broadcast(series)).select("series_id", F.col("as_of").alias("day"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("asked")))
        last = F.last(F.when(F.col("asked") == 0, F.struct("value")), ignorenulls=True).over(Window.partitionBy("series_id").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn("v", last).where("asked = 1 and v is not null").select("series_id", F.col("day").alias("as_of"), F.col("v.value").alias("value"))
    width = tolerance + 1
    bucket = F.floor(F.unix_date("as_of") / width)
    asked = days.select("as_of", F.explode(F.array(bucket - 1, bucket)).alias("bucket"))
    held = obs.withColumn("bucket", F.floor(F.unix_date("obs_date") / width))
    near = asked.join(held, "bucket").where(F.datediff("as_of", "obs_date").between(0, tolerance))
    return near.groupBy("series_id", "as_of").agg(F.max_by("value", "obs_date").alias("value"))


def at_week_offset(value: Column | str, weeks: int, keys: list[str]) -> Column:
    """The value of the row exactly so many weeks away; null if there is no such row (never the k-th row)."""
    days = 7 * weeks
    return F.first(value).over(Window.partitionBy(*keys).orderBy(F.unix_date("week")).rangeBetween(days, days))


def forward_log_return(value: str, weeks: int, keys: list[str]) -> Column:
    after = at_week_offset(value, weeks, keys)
    return F.when((after > 0) & (F.col(value) > 0), F.ln(after) - F.ln(value))


def onto_spine(spine: DataFrame, weekly: DataFrame, ids: list[str]) -> DataFrame:
    """One row per spine week, a column for each series in ids."""
    wide = weekly.groupBy("week").pivot("series_id", ids).agg(F.first("value"))
    return spine.join(wide, "week", "left")


def filled_forward(calendar: DataFrame, obs: DataFrame) -> DataFrame:
    """obs reindexed to every calendar day (day), then carried forward: values of days outside the calendar are not carried."""
    grid = calendar.crossJoin(F.broadcast(obs.select("series_id").distinct()))
    on = grid.join(obs.withColumnRenamed("obs_date", "day"), ["series_id", "day"], "left")
    return on.withColumn("value", F.last("value", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def training_sets(as_ofs: DataFrame, rows: DataFrame, embargo: int, min_train: int, longest: int | None = None) -> DataFrame:
    """Size, first and last week of each as_of's training set: rows at least embargo weeks earlier, the last `longest` of them.
    Counts and bounds come from ranks, not from pairing every as_of with every row."""
    ranked = rows.select("week").withColumn("rank", F.row_number().over(Window.orderBy("week")))
    both = ranked.select(F.col("week").alias("day"), "rank", F.lit(None).cast("date").alias("as_of")).unionByName(as_ofs.select(F.date_sub("as_of", 7 * embargo).alias("day"), F.lit(None).cast("int").alias("rank"), "as_of"))
    upto = Window.orderBy(F.col("day"), F.col("as_of").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("n", F.coalesce(F.max("rank").over(upto), F.lit(0))).withColumn("last_week", F.max(F.when(F.col("as_of").isNull(), F.col("day"))).over(upto)).where("as_of is not null and n >= %d" % min_train)
    size = F.least("n", F.lit(longest)) if longest else F.col("n")
    sized = counted.select("as_of", "last_week", size.alias("n_rows"), (F.col("n") - size + 1).alias("rank"))
    return sized.join(ranked.withColumnRenamed("week", "first_week"), "rank").select("as_of", "n_rows", "first_week", "last_week")


def tiered(primary: DataFrame, proxy: DataFrame, realised: DataFrame, value: str = "value") -> DataFrame:
    """Three-tier volatility by week and asset: primary, else proxy, else none (rv_only)."""
    keys = ["asset_id", "week"]
    rows = realised.select(*keys, F.col(value).alias("rv")).join(primary.select(*keys, F.col(value).alias("x_primary")), keys, "left").join(proxy.select(*keys, F.col(value).alias("x_proxy")), keys, "left")
    mode = F.when(F.col("x_primary").isNotNull(), "primary").when(F.col("x_proxy").isNotNull(), "proxy").otherwise("rv_only")
    return rows.select(*keys, F.coalesce("x_primary", "x_proxy").alias("vol"), "rv", mode.alias("mode"))
