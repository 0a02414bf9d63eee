"""Scans, vintages, append-only histories, registries and set operations."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import alignment as A
from tidemark.queries.series import WEEKLY, r6, weekly_prices
from tidemark.sources import observations as O
from tidemark.sources import snapshots as SN
from tidemark.sources import tables as T
from tidemark.sources.scratch import Folder

AS_OF = "DATE '1998-06-26'"


def as_of():
    return F.lit("1998-06-26").cast("date")


@query(f"WITH {T.VINTAGES} SELECT series_id, obs_date, value FROM vintages WHERE obs_date <= {AS_OF} AND realtime_start <= {AS_OF} AND {AS_OF} <= realtime_end")
def vintage_asof(spark, d):
    return A.known_at(T.vintages(spark, d), as_of()).select("series_id", "obs_date", "value")


@query(f"WITH {T.VINTAGES} SELECT series_id, count(*) FILTER (realtime_start > {AS_OF}) AS n_late_vintage, count(*) FILTER (obs_date > {AS_OF}) AS n_late_obs, count(*) AS n FROM vintages GROUP BY 1")
def vintage_guard(spark, d):
    return O.guard_counts(T.vintages(spark, d), as_of())


@query(f"WITH {T.VINTAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, obs_date ORDER BY realtime_start DESC) AS i FROM vintages WHERE obs_date <= {AS_OF} AND (series_id = '5-LOW' OR realtime_start <= {AS_OF})) SELECT series_id, obs_date, value FROM r WHERE i = 1")
def vintage_routing(spark, d):
    return O.routed(T.vintages(spark, d), as_of())


@query(f"WITH {T.VINTAGES}, f AS (SELECT series_id, obs_date, realtime_start, value, row_number() OVER (PARTITION BY series_id, obs_date ORDER BY realtime_start) AS i, count(*) OVER (PARTITION BY series_id, obs_date) AS n FROM vintages) SELECT series_id, count(*) FILTER (i = n AND n > 1) AS n_revised, count(*) FILTER (i = 1) AS n_dates, CAST(max(n) AS BIGINT) AS most_vintages FROM f GROUP BY 1")
def revision_counts(spark, d):
    """Late and revised data: vintages of an observation date."""
    per = T.vintages(spark, d).groupBy("series_id", "obs_date").agg(F.count("*").alias("n"))
    return per.groupBy("series_id").agg(F.count_if(F.col("n") > 1).alias("n_revised"), F.count("*").alias("n_dates"), F.max("n").alias("most_vintages"))


def histories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An older history, and a later one that overlaps it and was corrected on some days."""
    p = T.prices(spark, d)
    new = p.where("obs_date >= date'1998-01-01'").withColumn("value", F.when(F.dayofmonth("obs_date") == 13, F.col("value") + 1).otherwise(F.col("value")))
    return p.where("obs_date < date'1999-01-01'"), new


HISTORIES = f"WITH {T.PRICES}, old AS (SELECT * FROM prices WHERE obs_date < DATE '1999-01-01'), new AS (SELECT series_id, obs_date, CASE WHEN day(obs_date) = 13 THEN value + 1 ELSE value END AS value FROM prices WHERE obs_date >= DATE '1998-01-01')"


@query(f"{HISTORIES} SELECT series_id, obs_date, o.value AS old_value, n.value AS new_value FROM old o JOIN new n USING (series_id, obs_date) WHERE o.value IS DISTINCT FROM n.value")
def append_only_conflicts(spark, d):
    c = O.conflicts(*histories(spark, d))
    return c.select("series_id", "obs_date", "old_value", "new_value")


@query(f"{HISTORIES} SELECT series_id, obs_date, value AS value FROM (SELECT * FROM old UNION ALL SELECT n.* FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.series_id = n.series_id AND o.obs_date = n.obs_date))")
def incremental_append(spark, d):
    return O.appended(*histories(spark, d)).select("series_id", "obs_date", "value")


REGISTRY = "reg AS (SELECT n_name AS series_id, DATE '1995-01-06' + n_nationkey * 60 AS first_vintage, n_regionkey = 3 AS denied FROM nation)"


def registry(spark, d) -> DataFrame:
    return T.table(spark, d, "nation").select(F.col("n_name").alias("series_id"), F.expr("date_add(date'1995-01-06', n_nationkey * 60)").alias("first_vintage"), (F.col("n_regionkey") == 3).alias("denied"))


@query(f"WITH {REGISTRY} SELECT series_id, NOT denied AND first_vintage <= {AS_OF} AS ok FROM reg")
def registry_availability(spark, d):
    return O.available(T.prices(spark, d), registry(spark, d), as_of()).select("series_id", "ok")


@query(f"WITH {REGISTRY} SELECT series_id FROM reg WHERE NOT denied AND series_id NOT IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)")
def missing_series(spark, d):
    """Required series that no source delivers."""
    there = T.table(spark, d, "nation").join(T.table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_acctbal > 5000").select(F.col("n_name").alias("series_id"))
    return registry(spark, d).where("not denied").join(there, "series_id", "left_anti").select("series_id")


@query(f"{WEEKLY}, a AS (SELECT week FROM weekly WHERE series_id = 'A' AND value > 57000), n AS (SELECT week FROM weekly WHERE series_id = 'N' AND value > 57000) SELECT week FROM a INTERSECT SELECT week FROM n")
def common_weeks(spark, d):
    w = weekly_prices(spark, d).where("value > 57000")
    return w.where("series_id = 'A'").select("week").intersect(w.where("series_id = 'N'").select("week"))


@query(f"WITH {T.PRICES}, {T.VOLATILITY} SELECT obs_date, series_id, value FROM prices UNION ALL SELECT obs_date, series_id, value FROM vols")
def concatenated(spark, d):
    return T.prices(spark, d).unionByName(T.volatility(spark, d)).select("obs_date", "series_id", "value").orderBy("obs_date", "series_id")


@query(f"WITH {T.PRICES}, {T.VOLATILITY}, a AS (SELECT obs_date, value AS price FROM prices WHERE series_id = 'A'), v AS (SELECT obs_date, value AS vol FROM vols WHERE series_id = 'F') SELECT obs_date, price AS price, vol AS vol FROM a FULL JOIN v USING (obs_date) WHERE price IS NOT NULL AND vol IS NOT NULL")
def outer_concat(spark, d):
    """Full outer alignment, then complete pairs only."""
    a = T.prices(spark, d).where("series_id = 'A'").select("obs_date", F.col("value").alias("price"))
    v = T.volatility(spark, d).where("series_id = 'F'").select("obs_date", F.col("value").alias("vol"))
    return a.join(v, "obs_date", "full_outer").dropna("any").select("obs_date", "price", "vol")


@query(f"WITH {T.PRICES} SELECT CAST(min(obs_date) AS DATE) AS first_day, CAST(max(obs_date) AS DATE) AS last_day, count(*) AS n, count(DISTINCT obs_date) AS n_days, series_id FROM prices WHERE isfinite(value) GROUP BY series_id")
def availability_summary(spark, d):
    p = T.prices(spark, d).where(~F.isnan("value") & (F.abs("value") != float("inf")))
    return p.groupBy("series_id").agg(F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day"), F.count("*").alias("n"), F.countDistinct("obs_date").alias("n_days"))


@query(f"{WEEKLY} SELECT series_id, week, value AS value FROM weekly WHERE week = DATE '1998-06-26'")
def exact_row(spark, d):
    return weekly_prices(spark, d).where(F.col("week") == as_of()).select("series_id", "week", "value")


def materialised(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder; what reads it doesn't compute it again."""
    return Folder(spark, name).cut(df)


def payload(v: DataFrame) -> DataFrame:
    """Vintages as the service answers: observations by series and day, with missing marks."""
    value = F.when(F.dayofmonth("obs_date") == 13, O.MISSING).otherwise(F.col("value").cast("string"))
    said = F.struct(F.col("obs_date").cast("string").alias("date"), value.alias("value"), F.col("realtime_start").cast("string").alias("realtime_start"), F.col("realtime_end").cast("string").alias("realtime_end"))
    return v.groupBy("series_id", "obs_date").agg(F.collect_list(said).alias("observations"))


def through_payload(spark: SparkSession, v: DataFrame) -> DataFrame:
    path = Folder(spark, "payload").path()
    payload(v).select("series_id", "observations").write.json(path)
    return O.read_payload(spark, path).select("series_id", "obs_date", "value", "realtime_start")


@query(f"WITH {T.VINTAGES} SELECT series_id, obs_date, value AS value, realtime_start FROM vintages WHERE day(obs_date) <> 13")
def payload_scan(spark, d):
    """Through the service's JSON: written as its answers are, with missing marks, and scanned back."""
    return through_payload(spark, T.vintages(spark, d))


def total(x: str) -> Column:
    """The sum to the cent, the same in whatever order rows are added."""
    return F.round(F.round(F.sum(F.col(x).cast("decimal(38,12)")), 8), 2).cast("double")


SNAPSHOT_DAYS = ["1996-03-29", "1997-08-01", "1998-06-26", "2001-12-28"]


@query(
    f"""WITH {T.VINTAGES}, days AS (SELECT unnest([{', '.join(f"DATE '{x}'" for x in SNAPSHOT_DAYS)}]) AS as_of)
SELECT series_id, as_of, count(*) AS n, round(sum(value), 2) AS total, max(realtime_start) AS newest FROM vintages JOIN days ON obs_date <= as_of WHERE day(obs_date) <> 13
AND CASE WHEN series_id = '5-LOW' THEN realtime_end = DATE '9999-12-31' ELSE realtime_start <= as_of AND as_of <= realtime_end END GROUP BY 1, 2"""
)
def snapshot_scan(spark, d):
    """Snapshots of all series on four days through the cache: the first read fills it from the service's answers, the second
    has no service to ask. Totals are exact before they are rounded: halves of a cent are frequent, and round up."""
    tmp = Folder(spark, "snapshots")
    service, cache = tmp.path(), tmp.path()
    payload(T.vintages(spark, d)).select("series_id", F.to_json(F.struct("observations")).alias("value")).write.partitionBy("series_id").text(service)
    said = spark.read.schema("value string, series_id string").text(service)
    series = [r["series_id"] for r in said.select("series_id").distinct().orderBy("series_id").collect()]
    filled = SN.read_snapshots(spark, cache, service, series, SNAPSHOT_DAYS, O.UNREVISED)
    filled.write.format("noop").mode("overwrite").save()
    rows = SN.read_snapshots(spark, cache, "", series, SNAPSHOT_DAYS, O.UNREVISED)
    return rows.groupBy("series_id", "as_of").agg(F.count("*").alias("n"), total("value").alias("total"), F.max("realtime_start").alias("newest"))


@query(f"{WEEKLY} SELECT series_id, week, value AS value FROM weekly WHERE week BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def records_round_trip(spark, d):
    """Weekly records written by as_of and read back for a range of dates."""
    path = Folder(spark, "records").path()
    O.write_records(weekly_prices(spark, d).select(F.col("week").alias("as_of"), "series_id", "value"), path)
    back = O.read_records(spark, path, "1997-01-01", "1998-12-31")
    return back.select("series_id", F.col("as_of").cast("date").alias("week"), "value")


@query("SELECT o_orderpriority AS series_id, CAST(max(o_orderdate) AS DATE) AS as_of, count(*) FILTER (CAST(o_orderdate AS DATE) = (SELECT max(CAST(p.o_orderdate AS DATE)) FROM orders p WHERE p.o_orderpriority = o.o_orderpriority)) AS n FROM orders o GROUP BY 1")
def latest_snapshot(spark, d):
    rows = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("as_of"))
    return O.latest_files(rows).groupBy("series_id", "as_of").agg(F.count("*").alias("n"))


@query(f"{WEEKLY}, r AS (SELECT series_id, week, value FROM weekly), y AS (SELECT a.series_id, a.week, ln(b.value) - ln(a.value) AS realised FROM r a JOIN r b ON a.series_id = b.series_id AND b.week = a.week + 364) SELECT series_id, count(*) AS n, round(avg(realised), 6) AS mean_realised FROM r JOIN y USING (series_id, week) GROUP BY 1")
def outcomes_joined(spark, d):
    rows = weekly_prices(spark, d).withColumn("realised", A.forward_log_return("value", 52, ["series_id"])).where("realised is not null")
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), r6(F.avg("realised"), "mean_realised"))


def digest_of(record: dict) -> str:
    return hashlib.sha256(O.record_text(json.loads(json.dumps(record))).encode()).hexdigest()
