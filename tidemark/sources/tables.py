"""The driver's tables in the engine's shapes: observations (series_id, obs_date, value), vintages, outcomes, states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import Folder


@dataclass(frozen=True)
class Stored:
    """Daily series of a folder's tables, for the place of the folder in queries that need them often."""

    prices: DataFrame
    volatility: DataFrame
    macro: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mean(x: str) -> Column:
    """The average of amounts in hundredths, from an exact sum: the same bits in whatever order rows are added."""
    return F.sum(F.round(F.col(x) * 100).cast("bigint")).cast("double") / F.count(x).cast("double") / 100


def prices(spark: SparkSession, sf_dir: str | Stored) -> DataFrame:
    """Daily price of three assets."""
    if isinstance(sf_dir, Stored):
        return sf_dir.prices
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("obs_date")).agg(mean("l_extendedprice").alias("value"))


def volatility(spark: SparkSession, sf_dir: str | Stored) -> DataFrame:
    """Daily volatility index by line status; the first year of 'F' is missing."""
    if isinstance(sf_dir, Stored):
        return sf_dir.volatility
    rows = table(spark, sf_dir, "lineitem")
    out = rows.groupBy(F.col("l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("obs_date")).agg(mean("l_quantity").alias("value"))
    return out.where("not (series_id = 'F' and obs_date < date'1996-01-01')")


def macro(spark: SparkSession, sf_dir: str | Stored) -> DataFrame:
    """Daily level of five macro series."""
    if isinstance(sf_dir, Stored):
        return sf_dir.macro
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date")).agg(mean("o_totalprice").alias("value"))


def stored(spark: SparkSession, sf_dir: str) -> Stored:
    """The daily series, each written once from one scan of its table."""
    tmp = Folder(spark, "daily")
    return Stored(*(tmp.cut(f(spark, sf_dir)) for f in (prices, volatility, macro)))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the day on which they became known, and the day before they were revised."""
    from pyspark.sql import Window

    o, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = o.join(item, o.o_orderkey == item.l_orderkey).groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date"), F.to_date(F.greatest("o_orderdate", "l_shipdate")).alias("realtime_start")).agg(mean("l_extendedprice").alias("value"))
    after = F.lead("realtime_start").over(Window.partitionBy("series_id", "obs_date").orderBy("realtime_start"))
    return rows.withColumn("realtime_end", F.coalesce(F.date_sub(after, 1), F.lit("9999-12-31").cast("date")))


#: The same shapes for DuckDB, as common table expressions.
PRICES = "prices AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS obs_date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(l_extendedprice) AS DOUBLE) / 100 AS value FROM lineitem GROUP BY 1, 2)"
VOLATILITY = "vols AS (SELECT l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS obs_date, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / CAST(count(l_quantity) AS DOUBLE) / 100 AS value FROM lineitem GROUP BY 1, 2 HAVING NOT (l_linestatus = 'F' AND CAST(l_shipdate AS DATE) < DATE '1996-01-01'))"
MACRO = "macro AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(o_totalprice) AS DOUBLE) / 100 AS value FROM orders GROUP BY 1, 2)"
VINTAGES = """known AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, CAST(greatest(o_orderdate, l_shipdate) AS DATE) AS realtime_start, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(l_extendedprice) AS DOUBLE) / 100 AS value
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
vintages AS (SELECT *, coalesce(lead(realtime_start) OVER (PARTITION BY series_id, obs_date ORDER BY realtime_start) - 1, DATE '9999-12-31') AS realtime_end FROM known)"""


def friday(day: str) -> str:
    """DuckDB: the Friday on or after a day."""
    return f"({day} + ((12 - isodow({day})) % 7)::INT)"


def weekly(source: str, name: str = "weekly") -> str:
    """DuckDB: last observation of each Friday week."""
    return f"{name} AS (SELECT series_id, CAST({friday('obs_date')} AS DATE) AS week, arg_max(value, obs_date) AS value FROM {source} GROUP BY 1, 2)"
