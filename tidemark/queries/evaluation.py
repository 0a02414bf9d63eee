"""Evaluation: correlations, classification, states, events, lead-lag, dispersion, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import alignment as A
from tidemark.operators import evaluate as V
from tidemark.queries.distribution import FORECAST, forecast
from tidemark.queries.series import ID, RETURNS, WEEKLY, WEEKLY_RETURNS, by_week, daily_returns, r6, weekly_prices, weekly_returns_df
from tidemark.sources import tables as T

PAIRS = f"{FORECAST}, p AS (SELECT series_id, week, q4 AS x, y FROM fc)"


def pairs(spark, d) -> DataFrame:
    return forecast(spark, d).select("series_id", "week", F.col("q4").alias("x"), "y")


@query(f"{PAIRS} SELECT series_id, round(corr(x, y), 6) AS pearson FROM p GROUP BY 1")
def pearson(spark, d):
    return pairs(spark, d).groupBy("series_id").agg(r6(V.pearson("x", "y"), "pearson"))


@query(
    f"""{PAIRS}, r AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY round(x, 3)) + (count(*) OVER (PARTITION BY series_id, round(x, 3)) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY series_id ORDER BY round(y, 3)) + (count(*) OVER (PARTITION BY series_id, round(y, 3)) - 1) / 2.0::DOUBLE AS b FROM p)
SELECT series_id, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1"""
)
def spearman_average(spark, d):
    rows = pairs(spark, d).select("series_id", "week", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
    return V.average_ranks(rows, ["x", "y"], ID).groupBy("series_id").agg(r6(V.pearson("rank_x", "rank_y"), "spearman"))


@query(
    f"""{PAIRS}, r AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY round(x, 3), week) AS a, row_number() OVER (PARTITION BY series_id ORDER BY round(y, 3), week) AS b FROM p)
SELECT series_id, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1"""
)
def spearman_ordinal(spark, d):
    rows = pairs(spark, d).select("series_id", "week", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
    for x in "xy":
        rows = rows.withColumn(f"rank_{x}", F.row_number().over(Window.partitionBy("series_id").orderBy(x, "week")))
    return rows.groupBy("series_id").agg(r6(V.pearson("rank_x", "rank_y"), "spearman"))


@query(f"{WEEKLY_RETURNS}, l AS (SELECT series_id, r, lag(r) OVER (PARTITION BY series_id ORDER BY week) AS b FROM r) SELECT series_id, round(corr(r, b), 6) AS acf1 FROM l WHERE b IS NOT NULL GROUP BY 1")
def autocorrelation(spark, d):
    rows = weekly_returns_df(spark, d).withColumn("b", F.lag("r").over(by_week())).where("b is not null")
    return rows.groupBy("series_id").agg(r6(V.pearson("r", "b"), "acf1"))


@query(f"{PAIRS} SELECT series_id, week, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS z FROM p WINDOW w AS (PARTITION BY series_id)")
def standardised(spark, d):
    return pairs(spark, d).select("series_id", "week", r6(V.standardised("x", Window.partitionBy("series_id")), "z"))


TERCILES = f"{PAIRS}, t AS (SELECT series_id, quantile_cont(y, 1.0::DOUBLE / 3) AS lo, quantile_cont(y, 2.0::DOUBLE / 3) AS hi, quantile_cont(x, 1.0::DOUBLE / 3) AS xlo, quantile_cont(x, 2.0::DOUBLE / 3) AS xhi FROM p GROUP BY 1), s AS (SELECT series_id, week, x, y, CASE WHEN y <= lo THEN 'C' WHEN y >= hi THEN 'E' ELSE 'S' END AS truth, CASE WHEN x <= xlo THEN 'C' WHEN x >= xhi THEN 'E' ELSE 'S' END AS pred FROM p JOIN t USING (series_id))"


def states(spark, d) -> DataFrame:
    rows = pairs(spark, d)
    return V.terciles(V.terciles(rows, "y", "truth", ID), "x", "pred", ID)


@query(f"{TERCILES} SELECT series_id, week, truth, pred FROM s")
def terciles(spark, d):
    return states(spark, d).select("series_id", "week", "truth", "pred")


@query(
    f"""{TERCILES}, k AS (SELECT unnest(['C', 'S', 'E']) AS label), ids AS (SELECT DISTINCT series_id FROM s), c AS (SELECT ids.series_id, k.label, count(*) FILTER (truth = label) AS t, count(*) FILTER (pred = label) AS p, count(*) FILTER (truth = label AND pred = label) AS h FROM ids CROSS JOIN k JOIN s ON s.series_id = ids.series_id GROUP BY 1, 2)
SELECT series_id, round(avg(CASE WHEN t > 0 THEN h / t::DOUBLE END), 6) AS balanced_accuracy, round(avg(CASE WHEN 2 * h + (t - h) + (p - h) > 0 THEN 2.0::DOUBLE * h / (t + p) ELSE 0 END), 6) AS macro_f1, CAST(sum(h) AS BIGINT) AS n_correct FROM c GROUP BY 1"""
)
def confusion_metrics(spark, d):
    return V.confusion(states(spark, d), "truth", "pred", ["C", "S", "E"], ID).select("series_id", r6(F.col("balanced_accuracy"), "balanced_accuracy"), r6(F.col("macro_f1"), "macro_f1"), "n_correct")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_counts(spark, d):
    return T.table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(
    f"""{TERCILES}, l AS (SELECT series_id, x, pred, lag(pred) OVER o AS before, lag(x) OVER o AS bx FROM s WINDOW o AS (PARTITION BY series_id ORDER BY week))
SELECT series_id, round(avg(CASE WHEN pred = before THEN 1.0::DOUBLE ELSE 0 END), 6) AS persistence, round(avg(CASE WHEN pred <> before THEN 1.0::DOUBLE ELSE 0 END), 6) AS churn, round(avg(CASE WHEN (pred = 'C' AND before = 'E') OR (pred = 'E' AND before = 'C') THEN 1.0::DOUBLE ELSE 0 END), 6) AS direct_flips, round(corr(x, bx), 6) AS acf1, round(avg(abs(x - bx)), 6) AS mean_move FROM l WHERE before IS NOT NULL GROUP BY 1"""
)
def stability(spark, d):
    return V.stability(states(spark, d), "pred", "x", ID, "week").select("series_id", *[r6(F.col(x), x) for x in ("persistence", "churn", "direct_flips", "acf1", "mean_move")])


EVENTS = "ev AS (SELECT * FROM (VALUES ('early', DATE '1996-03-01', DATE '1996-09-27'), ('mid', DATE '1998-02-06', DATE '1998-08-28'), ('late', DATE '2000-01-07', DATE '2000-06-30')) AS v(event, first_day, last_day))"


def events(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('early', date'1996-03-01', date'1996-09-27'), ('mid', date'1998-02-06', date'1998-08-28'), ('late', date'2000-01-07', date'2000-06-30') AS v(event, first_day, last_day)")


@query(f"{TERCILES}, {EVENTS} SELECT e.event, s.series_id, count(*) AS n, min(week) AS first_week, max(week) AS last_week, round(avg(y), 6) AS mean_y FROM s JOIN ev e ON s.week BETWEEN first_day AND last_day GROUP BY 1, 2")
def event_windows(spark, d):
    rows = V.in_windows(states(spark, d), events(spark), "week")
    return rows.groupBy("event", "series_id").agg(F.count("*").alias("n"), F.min("week").alias("first_week"), F.max("week").alias("last_week"), r6(F.avg("y"), "mean_y"))


@query(f"{TERCILES}, {EVENTS} SELECT series_id, count(*) AS n_calm, round(avg(y), 6) AS mean_y FROM s WHERE NOT EXISTS (SELECT 1 FROM ev WHERE s.week BETWEEN first_day AND last_day) GROUP BY 1")
def calm_weeks(spark, d):
    return V.outside_windows(states(spark, d), events(spark), "week").groupBy("series_id").agg(F.count("*").alias("n_calm"), r6(F.avg("y"), "mean_y"))


@query(
    f"""{TERCILES}, {EVENTS}, a AS (SELECT series_id, week FROM s WHERE pred = 'C'), i AS (SELECT DISTINCT series_id FROM s)
SELECT i.series_id, e.event, CAST(date_diff('day', min(a.week), e.first_day) / 7 AS BIGINT) AS lead_weeks FROM i CROSS JOIN ev e LEFT JOIN a ON a.series_id = i.series_id AND a.week BETWEEN e.first_day - 182 AND e.first_day GROUP BY i.series_id, e.event, e.first_day"""
)
def lead_time(spark, d):
    rows = states(spark, d)
    return V.lead_times(rows.where("pred = 'C'"), rows.select("series_id").distinct(), events(spark), ID, 26)


@query(
    f"""{TERCILES}, {EVENTS} SELECT series_id, count(*) AS n_signals, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ev WHERE s.week BETWEEN first_day - 182 AND last_day)) AS n_false,
round(count(*) FILTER (NOT EXISTS (SELECT 1 FROM ev WHERE s.week BETWEEN first_day - 182 AND last_day)) / count(*)::DOUBLE, 6) AS share FROM s WHERE pred = 'C' GROUP BY 1"""
)
def false_alarm(spark, d):
    wide = events(spark).select("event", F.date_sub("first_day", 182).alias("first_day"), "last_day")
    return V.false_alarms(states(spark, d).where("pred = 'C'"), wide, ID).select("series_id", "n_signals", "n_false", r6(F.col("share"), "share"))


@query(
    f"""{PAIRS}, {EVENTS}, c AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM ev WHERE p.week BETWEEN first_day AND last_day)), q AS (SELECT series_id, quantile_cont(x, 0.8::DOUBLE) AS xs, quantile_cont(y, 0.8::DOUBLE) AS ys FROM c GROUP BY 1)
SELECT series_id, round(count(*) FILTER (x >= xs AND y < ys) / count(*) FILTER (x >= xs)::DOUBLE, 6) AS false_positive_rate FROM c JOIN q USING (series_id) GROUP BY 1"""
)
def false_positive_rate(spark, d):
    calm = V.outside_windows(pairs(spark, d), events(spark), "week")
    cut = calm.groupBy("series_id").agg(F.percentile("x", F.lit(0.8)).alias("xs"), F.percentile("y", F.lit(0.8)).alias("ys"))
    high = F.col("x") >= F.col("xs")
    rate = F.try_divide(F.count_if(high & (F.col("y") < F.col("ys"))), F.count_if(high))
    return calm.join(cut, "series_id").groupBy("series_id").agg(r6(rate, "false_positive_rate"))


LAGGED = ", ".join(f"lag(a, {k}) OVER o AS l{k}" for k in range(1, 6))


@query(
    f"""{RETURNS}, s AS (SELECT series_id, obs_date, abs(r) AS a FROM r WHERE r IS NOT NULL), l AS (SELECT series_id, obs_date, a, {LAGGED} FROM s WINDOW o AS (PARTITION BY series_id ORDER BY obs_date)),
u AS (SELECT series_id, a, unnest([1, 2, 3, 4, 5]) AS k, unnest([l1, l2, l3, l4, l5]) AS b FROM l) SELECT series_id, CAST(k AS INT) AS lag, round(corr(a, b), 6) AS pearson FROM u WHERE b IS NOT NULL GROUP BY 1, 2"""
)
def lead_lag(spark, d):
    rows = daily_returns(spark, d).where("r is not null").select("series_id", "obs_date", F.abs("r").alias("a"))
    return V.lead_lag(rows, "a", "a", ID, "obs_date", 5).select("series_id", "lag", r6(F.col("pearson"), "pearson"))


@query(f"{PAIRS}, w AS (SELECT series_id, year(week) AS yr, corr(x, y) AS c FROM p GROUP BY 1, 2 HAVING count(*) >= 10 AND stddev_pop(x) > 1e-12) SELECT series_id, round(stddev_pop(c), 6) AS dispersion, round(min(c), 6) AS worst, CAST(arg_min(yr, c) AS INT) AS worst_window, count(*) AS n_windows FROM w GROUP BY 1")
def window_dispersion(spark, d):
    per = pairs(spark, d).groupBy("series_id", F.year("week").alias("yr")).agg(V.pearson("x", "y").alias("c"), F.count("*").alias("n")).where("n >= 10 and c is not null")
    return per.groupBy("series_id").agg(r6(F.stddev_pop("c"), "dispersion"), r6(F.min("c"), "worst"), F.min_by("yr", "c").alias("worst_window"), F.count("*").alias("n_windows"))


@query(
    f"""{PAIRS}, nx AS (SELECT series_id, week, x, y, lead(y) OVER o AS ny FROM p WINDOW o AS (PARTITION BY series_id ORDER BY week))
SELECT series_id, round(corr(x, y), 6) AS x_y, round(corr(x, ny), 6) AS x_next, round(corr(abs(x), abs(y)), 6) AS size_y, round(avg(CASE WHEN x * y > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS same_sign FROM nx GROUP BY 1"""
)
def direction_metrics(spark, d):
    rows = pairs(spark, d).withColumn("ny", F.lead("y").over(by_week())).withColumn("ax", F.abs("x")).withColumn("ay", F.abs("y"))
    return rows.groupBy("series_id").agg(r6(V.pearson("x", "y"), "x_y"), r6(V.pearson("x", "ny"), "x_next"), r6(V.pearson("ax", "ay"), "size_y"), r6(F.avg((F.col("x") * F.col("y") > 0).cast("double")), "same_sign"))


DIAG = f"{FORECAST}, z AS (SELECT series_id, week, (y - q4) / (q6 - q2) AS z, q6 - q2 AS s FROM fc), m AS (SELECT series_id, median(s) AS med FROM z GROUP BY 1)"


@query(
    f"""{DIAG}, l AS (SELECT series_id, week, z, s, lead(abs(z)) OVER (PARTITION BY series_id ORDER BY week) AS nz FROM z)
SELECT series_id, round(avg(z), 6) AS mean_z, round(stddev_pop(z), 6) AS std_z, round(corr(s, nz), 6) AS corr_next, count(*) FILTER (s > 2 * med) AS above2, count(*) FILTER (s > 10 * med) AS above10, round(quantile_cont(s, 0.9::DOUBLE) / quantile_cont(s, 0.1::DOUBLE), 6) AS ratio FROM l JOIN m USING (series_id) GROUP BY 1"""
)
def forecast_diagnostics(spark, d):
    s = F.col("q6") - F.col("q2")
    rows = forecast(spark, d).select("series_id", "week", ((F.col("y") - F.col("q4")) / s).alias("z"), s.alias("s")).withColumn("nz", F.lead(F.abs("z")).over(by_week()))
    med = rows.groupBy("series_id").agg(F.percentile("s", F.lit(0.5)).alias("med"))
    ratio = F.percentile("s", F.lit(0.9)) / F.percentile("s", F.lit(0.1))
    return rows.join(med, "series_id").groupBy("series_id").agg(r6(F.avg("z"), "mean_z"), r6(F.stddev_pop("z"), "std_z"), r6(V.pearson("s", "nz"), "corr_next"), F.count_if(F.col("s") > 2 * F.col("med")).alias("above2"), F.count_if(F.col("s") > 10 * F.col("med")).alias("above10"), r6(ratio, "ratio"))


@query(f"{DIAG}, e AS (SELECT series_id, z, 1 / (1 + exp(-1.702::DOUBLE * z)) AS u FROM z), t AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS tau) SELECT series_id, tau, round(abs(avg(CASE WHEN u <= tau THEN 1.0::DOUBLE ELSE 0 END) - tau), 6) AS error FROM e CROSS JOIN t GROUP BY 1, 2")
def calibration_error(spark, d):
    """Of the probability transform under a logistic law; one pass, a conditional average for each level."""
    s = F.col("q6") - F.col("q2")
    rows = forecast(spark, d).select("series_id", (1 / (1 + F.exp(-1.702 * (F.col("y") - F.col("q4")) / s))).alias("u"))
    taus = [0.05, 0.1, 0.5, 0.9, 0.95]
    wide = rows.groupBy("series_id").agg(*[F.abs(F.avg((F.col("u") <= t).cast("double")) - t).alias(f"e{k}") for k, t in enumerate(taus)])
    return wide.select("series_id", F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.round(f"e{k}", 6).alias("error")) for k, t in enumerate(taus)])).alias("x")).select("series_id", "x.tau", "x.error")


@query(f"{DIAG}, e AS (SELECT series_id, 1 / (1 + exp(-1.702::DOUBLE * z)) AS u, row_number() OVER (PARTITION BY series_id ORDER BY z, week) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM z) SELECT series_id, round(max(greatest(i / n::DOUBLE - u, u - (i - 1) / n::DOUBLE)), 6) AS ks FROM e GROUP BY 1")
def ks_statistic(spark, d):
    s = F.col("q6") - F.col("q2")
    rows = forecast(spark, d).select("series_id", "week", ((F.col("y") - F.col("q4")) / s).alias("z")).withColumn("u", 1 / (1 + F.exp(-1.702 * F.col("z"))))
    return V.ks(rows, "z", "u", ID, "week").select("series_id", r6(F.col("ks"), "ks"))


@query(f"{WEEKLY}, w AS (SELECT DISTINCT week FROM weekly), m AS (SELECT week, max(value) FILTER (series_id = 'A') AS a, max(value) FILTER (series_id = 'N') AS n FROM weekly GROUP BY 1), k AS (SELECT median(a) AS ma, median(n) AS mn FROM m WHERE week < DATE '1997-01-01') SELECT week, round(coalesce(a, ma), 6) AS a, round(coalesce(n, mn), 6) AS n FROM m, k")
def median_imputed(spark, d):
    wide = weekly_prices(spark, d).groupBy("week").pivot("series_id", ["A", "N"]).agg(F.first("value"))
    med = wide.where("week < date'1997-01-01'").agg(F.percentile("A", F.lit(0.5)).alias("ma"), F.percentile("N", F.lit(0.5)).alias("mn"))
    return wide.crossJoin(F.broadcast(med)).select("week", r6(F.coalesce("A", "ma"), "a"), r6(F.coalesce("N", "mn"), "n"))


@query(f"{WEEKLY} SELECT a.week, round(a.value - b.value, 6) AS gap FROM weekly a JOIN weekly b ON a.week = b.week AND a.series_id = 'A' AND b.series_id = 'R'")
def inner_alignment(spark, d):
    w = weekly_prices(spark, d)
    a, b = (w.where(f"series_id = '{k}'").select("week", F.col("value").alias(k)) for k in "AR")
    return a.join(b, "week").select("week", r6(F.col("A") - F.col("R"), "gap"))


@query(
    f"""{PAIRS}, h AS (SELECT series_id, week, x, y, median(x) OVER (PARTITION BY series_id) AS m FROM p)
SELECT series_id, x > m AS high, count(*) AS n, round(avg(y), 6) AS mean_y, round(stddev_pop(y), 6) AS std_y FROM h GROUP BY 1, 2"""
)
def two_state(spark, d):
    """Median split, conditional mean and deviation."""
    med = pairs(spark, d).groupBy("series_id").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    return pairs(spark, d).join(med, "series_id").groupBy("series_id", (F.col("x") > F.col("m")).alias("high")).agg(F.count("*").alias("n"), r6(F.avg("y"), "mean_y"), r6(F.stddev_pop("y"), "std_y"))


@query(
    f"""{PAIRS}, r AS (SELECT series_id, week, y, (rank() OVER (PARTITION BY series_id ORDER BY x) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / count(*) OVER (PARTITION BY series_id) AS u FROM p), t AS (SELECT series_id, list_sort(list(y)) AS v FROM p GROUP BY 1),
k AS (SELECT series_id, week, v, u * (len(v) - 1) AS h FROM r JOIN t USING (series_id)) SELECT series_id, week, round(v[CAST(floor(h) AS INT) + 1] + (h - floor(h)) * (v[least(CAST(floor(h) AS INT) + 2, len(v))] - v[CAST(floor(h) AS INT) + 1]), 6) AS mapped FROM k"""
)
def rank_quantile_map(spark, d):
    """The outcome quantile at the signal's average-rank percentile."""
    rows = V.average_ranks(pairs(spark, d), ["x"], ID).withColumn("u", (F.col("rank_x") - 0.5) / F.count("*").over(Window.partitionBy("series_id")))
    table = pairs(spark, d).groupBy("series_id").agg(F.array_sort(F.collect_list("y")).alias("v"))
    h = F.col("u") * (F.size("v") - 1)
    i = F.floor(h).cast("int")
    lo, hi = F.get("v", i), F.get("v", F.least(i + 1, F.size("v") - 1))
    return rows.join(table, "series_id").select("series_id", "week", r6(lo + (h - i) * (hi - lo), "mapped"))
