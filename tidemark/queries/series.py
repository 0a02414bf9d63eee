"""Calendars, point-in-time alignment, features and series windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import scalar as S
from tidemark.operators import alignment as A
from tidemark.operators import calendar as C
from tidemark.operators import windows as W
from tidemark.sources import tables as T

ID = ["series_id"]


def by_week(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ID)).orderBy("week")


def by_day() -> Window:
    return Window.partitionBy("series_id").orderBy("obs_date")


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def weekly_prices(spark: SparkSession, d: str) -> DataFrame:
    return A.weekly_values(T.prices(spark, d))


WEEKLY = f"WITH {T.PRICES}, {T.weekly('prices')}"
MACRO = f"WITH {T.MACRO}, {T.weekly('macro')}"


@query(f"WITH {T.PRICES} SELECT series_id, obs_date, value FROM prices WHERE obs_date <= DATE '1998-06-30'")
def pit_truncate(spark, d):
    return T.prices(spark, d).where("obs_date <= date'1998-06-30'")


@query(f"WITH {T.PRICES} SELECT CAST(unnest(generate_series({T.friday('min(obs_date)')}, {T.friday('max(obs_date)')}, INTERVAL 7 DAY)) AS DATE) AS week FROM prices")
def weekly_spine(spark, d):
    return C.spine(T.prices(spark, d))


@query(f"WITH {T.MACRO} SELECT DISTINCT obs_date AS week FROM macro WHERE series_id = '1-URGENT' AND isodow(obs_date) = 5")
def observed_fridays(spark, d):
    return C.observed_spine(T.macro(spark, d).where("series_id = '1-URGENT'"))


@query(f"{WEEKLY} SELECT series_id, week, value FROM weekly")
def weekly_asof(spark, d):
    return weekly_prices(spark, d)


@query(
    f"""WITH {T.PRICES}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + 3 AS as_of FROM orders)
SELECT series_id, as_of, arg_max(value, obs_date) AS value FROM days JOIN prices ON obs_date BETWEEN as_of - 6 AND as_of GROUP BY 1, 2"""
)
def asof_off_spine(spark, d):
    """As of three days after every order's day."""
    days = T.table(spark, d, "orders").select(F.date_add(F.to_date("o_orderdate"), 3).alias("as_of")).distinct()
    return A.as_of(days, T.prices(spark, d))


@query(
    f"""WITH {T.PRICES}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders), ids AS (SELECT DISTINCT series_id FROM prices)
SELECT i.series_id, d.as_of, p.value FROM days d CROSS JOIN ids i ASOF JOIN prices p ON p.series_id = i.series_id AND d.as_of >= p.obs_date"""
)
def asof_unbounded(spark, d):
    """As of every order's day, however old the value."""
    days = T.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    return A.as_of(days, T.prices(spark, d), tolerance=None)


MACRO_IDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    f"""{MACRO}, spine AS (SELECT CAST(unnest(generate_series({T.friday('min(obs_date)')}, {T.friday('max(obs_date)')}, INTERVAL 7 DAY)) AS DATE) AS week FROM macro)
SELECT s.week, """
    + ", ".join(f"max(CASE WHEN series_id = '{x}' THEN value END) AS s{x[0]}" for x in MACRO_IDS)
    + " FROM spine s LEFT JOIN weekly w ON s.week = w.week GROUP BY 1"
)
def series_alignment(spark, d):
    macro = T.macro(spark, d)
    wide = A.onto_spine(C.spine(macro), A.weekly_values(macro), MACRO_IDS)
    return wide.select("week", *[F.col(f"`{x}`").alias(f"s{x[0]}") for x in MACRO_IDS])


@query(f"{WEEKLY} SELECT a.series_id, a.week, round(a.value - b.value, 6) AS delta FROM weekly a LEFT JOIN weekly b ON a.series_id = b.series_id AND b.week = a.week - 91")
def calendar_delta(spark, d):
    return weekly_prices(spark, d).select("series_id", "week", r6(F.col("value") - A.at_week_offset("value", -13, ID), "delta"))


@query(f"{WEEKLY} SELECT a.series_id, a.week, round(ln(b.value) - ln(a.value), 6) AS y FROM weekly a LEFT JOIN weekly b ON a.series_id = b.series_id AND b.week = a.week + 364")
def forward_return(spark, d):
    return weekly_prices(spark, d).select("series_id", "week", r6(A.forward_log_return("value", 52, ID), "y"))


FEATURES_SQL = f"""{MACRO}, w AS (SELECT week, """ + ", ".join(f"max(CASE WHEN series_id = '{x}' THEN value END) AS s{x[0]}" for x in MACRO_IDS) + """ FROM weekly GROUP BY 1),
f AS (SELECT a.week, a.s1 - a.s2 AS x1, (a.s1 - a.s2) - (b.s1 - b.s2) AS x2, a.s3 - b.s3 AS x3, ln(a.s4) - ln(e.s4) AS x4, ln(a.s5 / a.s1) AS x5
  FROM w a LEFT JOIN w b ON b.week = a.week - 91 LEFT JOIN w e ON e.week = a.week - 182)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """Spread, its 13-week change, a 13-week change, 26-week log growth and a log ratio; null where a lagged week is missing."""
    wide = A.weekly_values(T.macro(spark, d)).groupBy("week").pivot("series_id", MACRO_IDS).agg(F.first("value"))
    w = wide.select("week", F.lit(1).alias("one"), *[F.col(f"`{x}`").alias(f"s{x[0]}") for x in MACRO_IDS]).withColumn("spread", F.col("s1") - F.col("s2"))
    lag = lambda x, k: A.at_week_offset(x, -k, ["one"])
    return w.select(
        "week",
        F.col("spread").alias("x1"),
        (F.col("spread") - lag("spread", 13)).alias("x2"),
        (F.col("s3") - lag("s3", 13)).alias("x3"),
        (S.safe_ln("s4") - S.safe_ln(lag("s4", 26))).alias("x4"),
        S.safe_ln(F.col("s5") / F.col("s1")).alias("x5"),
    )


@query(FEATURES_SQL + " SELECT week, " + ", ".join(f"round(x{k}, 6) AS x{k}" for k in range(1, 6)) + " FROM f")
def feature_block(spark, d):
    return features(spark, d).select("week", *[r6(F.col(f"x{k}"), f"x{k}") for k in range(1, 6)])


@query(
    FEATURES_SQL
    + """, g AS (SELECT week, unnest(['x1','x2','x3','x4','x5']) AS feature, unnest([x1,x2,x3,x4,x5]) AS x FROM f),
h AS (SELECT week, feature, x, median(x) OVER o AS med, mad(x) OVER o AS mad FROM g WHERE x IS NOT NULL WINDOW o AS (PARTITION BY feature ORDER BY week)),
i AS (SELECT week, feature, (x - med) / (1.4826 * mad + 1e-8) AS z FROM h)
SELECT week, feature, round(greatest(-5, least(5, 4 * ((exp(z / 2) - 1) / (exp(z / 2) + 1)))), 6) AS scaled FROM i WHERE z < 1000 AND z > -1000"""
)
def weekly_features(spark, d):
    """Flagship: features of each week, scaled by the expanding median and MAD and squashed."""
    long = features(spark, d).unpivot("week", [f"x{k}" for k in range(1, 6)], "feature", "x").where("x is not null")
    z = W.robust_z(long, "x", ["feature"])
    return z.where("z < 1000 and z > -1000").select("week", "feature", r6(S.squash("z"), "scaled"))


@query(
    f"""{WEEKLY}, h AS (SELECT series_id, week, value, median(value) OVER o AS med, mad(value) OVER o AS mad FROM weekly WINDOW o AS (PARTITION BY series_id ORDER BY week))
SELECT series_id, week, round(med, 6) AS med, round(mad, 6) AS mad, round((value - med) / (1.4826 * mad + 1e-8), 6) AS z FROM h"""
)
def robust_zscore_expanding(spark, d):
    return W.robust_z(weekly_prices(spark, d), "value", ID).select("series_id", "week", r6(F.col("med"), "med"), r6(F.col("mad"), "mad"), r6(F.col("z"), "z"))


@query(f"{FEATURES_SQL} SELECT week FROM f WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND x4 IS NOT NULL AND x5 IS NOT NULL")
def complete_weeks(spark, d):
    return features(spark, d).dropna("any").select("week")


@query(f"{FEATURES_SQL}, u AS (SELECT week, (x4 IS NOT NULL) AS ok FROM f) SELECT coalesce(max(week) FILTER (ok) < min(week) FILTER (NOT ok), count(*) FILTER (ok) > 0) AS contiguous, count(*) FILTER (ok) AS n_usable FROM u")
def contiguous_prefix(spark, d):
    ok = F.col("x4").isNotNull()
    agg = features(spark, d).agg(F.max(F.when(ok, F.col("week"))).alias("a"), F.min(F.when(~ok, F.col("week"))).alias("b"), F.count_if(ok).alias("n_usable"))
    return agg.select(F.coalesce(F.col("a") < F.col("b"), F.col("n_usable") > 0).alias("contiguous"), "n_usable")


RETURNS = f"WITH {T.PRICES}, r AS (SELECT series_id, obs_date, value, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY obs_date)) AS r FROM prices)"


def daily_returns(spark, d):
    return T.prices(spark, d).withColumn("r", W.log_return("value", by_day()))


@query(f"{RETURNS} SELECT series_id, obs_date, round(r, 6) AS r FROM r")
def log_returns(spark, d):
    return daily_returns(spark, d).select("series_id", "obs_date", r6(F.col("r"), "r"))


@query(
    f"""{RETURNS}, v AS (SELECT series_id, obs_date, CASE WHEN count(r) OVER o = 20 THEN sqrt(252 * avg(r * r) OVER o) * 100 END AS rv FROM r WINDOW o AS (PARTITION BY series_id ORDER BY obs_date ROWS 19 PRECEDING))
SELECT series_id, obs_date, round(rv, 4) AS rv20 FROM v WHERE isodow(obs_date) = 5 AND rv IS NOT NULL"""
)
def rv20(spark, d):
    out = daily_returns(spark, d).select("series_id", "obs_date", F.round(W.rms("r", by_day(), 20, 252.0) * 100, 4).alias("rv20"))
    return out.where(C.is_friday("obs_date") & F.col("rv20").isNotNull())


@query(
    f"""{RETURNS}, v AS (SELECT series_id, obs_date, CASE WHEN count(r) OVER o = 20 AND bool_and(value > 0) OVER (PARTITION BY series_id ORDER BY obs_date) THEN sqrt(252 * avg(r * r) OVER o) * 100 END AS rv FROM r WINDOW o AS (PARTITION BY series_id ORDER BY obs_date ROWS 19 PRECEDING))
SELECT series_id, CAST({T.friday('obs_date')} AS DATE) AS week, round(arg_max_null(rv, obs_date), 4) AS rv FROM v GROUP BY 1, 2"""
)
def rv20_weekly(spark, d):
    whole = F.bool_and(F.col("value") > 0).over(by_day().rowsBetween(W.UP, 0))
    rv = daily_returns(spark, d).withColumn("value", F.when(whole, W.rms("r", by_day(), 20, 252.0) * 100))
    return A.weekly_values(rv).select("series_id", "week", F.round("value", 4).alias("rv"))


WEEKLY_RETURNS = f"{WEEKLY}, r AS (SELECT series_id, week, value, ln(value) - ln(lag(value) OVER (PARTITION BY series_id ORDER BY week)) AS r FROM weekly)"


def weekly_returns_df(spark, d):
    return weekly_prices(spark, d).withColumn("r", W.log_return("value", by_week()))


@query(f"{WEEKLY_RETURNS} SELECT series_id, week, round(r, 6) AS r FROM r")
def weekly_returns(spark, d):
    return weekly_returns_df(spark, d).select("series_id", "week", r6(F.col("r"), "r"))


@query(f"{WEEKLY_RETURNS} SELECT series_id, week, CASE WHEN count(r) OVER o = 52 THEN round(sqrt(avg(r * r) OVER o), 6) END AS rv52 FROM r WINDOW o AS (PARTITION BY series_id ORDER BY week ROWS 51 PRECEDING)")
def rv52(spark, d):
    return weekly_returns_df(spark, d).select("series_id", "week", r6(W.rms("r", by_week(), 52), "rv52"))


@query(f"{WEEKLY} SELECT series_id, week, round(ln(value) - lag(ln(value), 4) OVER o, 6) AS d4, round(value - lag(value) OVER o, 6) AS d1 FROM weekly WINDOW o AS (PARTITION BY series_id ORDER BY week)")
def row_differences(spark, d):
    return weekly_prices(spark, d).select("series_id", "week", r6(W.log_return("value", by_week(), 4), "d4"), r6(F.col("value") - F.lag("value").over(by_week()), "d1"))


@query(
    f"""{WEEKLY_RETURNS} SELECT series_id, week, CASE WHEN count(r) OVER o >= 26 THEN round(avg(r) OVER o, 6) END AS m, CASE WHEN count(r) OVER o >= 26 THEN round(stddev_pop(r) OVER o, 6) END AS s
FROM r WINDOW o AS (PARTITION BY series_id ORDER BY week ROWS BETWEEN 104 PRECEDING AND 53 PRECEDING)"""
)
def rolling_lagged_stats(spark, d):
    f = by_week().rowsBetween(-104, -53)
    enough = F.count("r").over(f) >= 26
    return weekly_returns_df(spark, d).select("series_id", "week", r6(F.when(enough, F.avg("r").over(f)), "m"), r6(F.when(enough, F.stddev_pop("r").over(f)), "s"))


@query(
    f"""{WEEKLY_RETURNS} SELECT series_id, week, round(ln(value) - ln(lag(value, 26) OVER o), 6) AS trend, CASE WHEN count(r) OVER p = 13 THEN round(stddev_pop(r) OVER p, 6) END AS vol
FROM r WINDOW o AS (PARTITION BY series_id ORDER BY week), p AS (PARTITION BY series_id ORDER BY week ROWS 12 PRECEDING)"""
)
def trend_and_vol(spark, d):
    f = by_week().rowsBetween(-12, 0)
    return weekly_returns_df(spark, d).select("series_id", "week", r6(W.log_return("value", by_week(), 26), "trend"), r6(F.when(F.count("r").over(f) == 13, F.stddev_pop("r").over(f)), "vol"))


@query(
    f"""{WEEKLY_RETURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week) AS i FROM r),
p AS (SELECT a.series_id, a.week, b.i - a.i AS k, b.value, max(b.value) OVER (PARTITION BY a.series_id, a.week ORDER BY b.i) AS peak, count(*) OVER (PARTITION BY a.series_id, a.week) AS n FROM n a JOIN n b ON a.series_id = b.series_id AND b.i BETWEEN a.i AND a.i + 13),
dd AS (SELECT series_id, week, CASE WHEN max(n) = 14 THEN max(1 - value / peak) END AS fall FROM p GROUP BY 1, 2),
v AS (SELECT series_id, week, CASE WHEN count(r) OVER o = 13 THEN stddev_pop(r) OVER o END AS risk FROM r WINDOW o AS (PARTITION BY series_id ORDER BY week ROWS BETWEEN 13 FOLLOWING AND 25 FOLLOWING))
SELECT v.series_id, v.week, round(risk, 6) AS forward_risk, round(fall, 6) AS forward_drawdown FROM v JOIN dd ON v.series_id = dd.series_id AND v.week = dd.week"""
)
def forward_drawdown(spark, d):
    ahead, path = by_week().rowsBetween(13, 25), by_week().rowsBetween(0, 13)
    rows = weekly_returns_df(spark, d).withColumn("risk", F.when(F.count("r").over(ahead) == 13, F.stddev_pop("r").over(ahead))).withColumn("path", F.collect_list("value").over(path))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))

    def step(acc, v):
        peak = F.greatest(acc["peak"], v)
        return F.struct(peak.alias("peak"), F.greatest(acc["fall"], 1 - v / peak).alias("fall"))

    fall = F.when(F.size("path") == 14, F.aggregate("path", start, step)["fall"])
    return rows.select("series_id", "week", r6(F.col("risk"), "forward_risk"), r6(fall, "forward_drawdown"))


@query(
    f"""{RETURNS} SELECT series_id, obs_date, round(value / avg(value) OVER h, 6) AS ratio, round(abs(lag(r) OVER o), 6) AS lagged_abs, round(abs(lead(r) OVER o), 6) AS next_abs,
CASE WHEN count(r) OVER f = 5 THEN round(sqrt(avg(r * r) OVER f), 6) END AS rv5 FROM r WINDOW o AS (PARTITION BY series_id ORDER BY obs_date), h AS (PARTITION BY series_id ORDER BY obs_date ROWS 21 PRECEDING), f AS (PARTITION BY series_id ORDER BY obs_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"""
)
def signal_builders(spark, d):
    o, f = by_day(), by_day().rowsBetween(1, 5)
    rv5 = F.when(F.count("r").over(f) == 5, F.sqrt(F.avg(F.col("r") * F.col("r")).over(f)))
    return daily_returns(spark, d).select("series_id", "obs_date", r6(F.col("value") / F.avg("value").over(o.rowsBetween(-21, 0)), "ratio"), r6(F.abs(F.lag("r").over(o)), "lagged_abs"), r6(F.abs(F.lead("r").over(o)), "next_abs"), r6(rv5, "rv5"))


@query(
    f"""{RETURNS} SELECT series_id, obs_date, round(sqrt(avg(r * r) OVER a), 6) AS rv1, CASE WHEN count(r) OVER b = 5 THEN round(sqrt(avg(r * r) OVER b), 6) END AS rv5, CASE WHEN count(r) OVER c = 22 THEN round(sqrt(avg(r * r) OVER c), 6) END AS rv22
FROM r WINDOW a AS (PARTITION BY series_id ORDER BY obs_date ROWS 0 PRECEDING), b AS (PARTITION BY series_id ORDER BY obs_date ROWS 4 PRECEDING), c AS (PARTITION BY series_id ORDER BY obs_date ROWS 21 PRECEDING)"""
)
def har_components(spark, d):
    return daily_returns(spark, d).select("series_id", "obs_date", *[r6(W.rms("r", by_day(), n), f"rv{n}") for n in (1, 5, 22)])


@query(
    f"""WITH {T.PRICES}, {T.VOLATILITY}, {T.weekly('prices')}, {T.weekly('vols', 'wv')}
SELECT p.series_id AS asset_id, p.week, coalesce(a.value, CASE WHEN p.week >= DATE '1995-06-30' THEN b.value END) AS vol, CASE WHEN a.value IS NOT NULL THEN 'primary' WHEN p.week >= DATE '1995-06-30' AND b.value IS NOT NULL THEN 'proxy' ELSE 'rv_only' END AS mode
FROM weekly p LEFT JOIN wv a ON a.week = p.week AND a.series_id = CASE p.series_id WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'F' END LEFT JOIN wv b ON b.week = p.week AND b.series_id = 'O'"""
)
def coalesce_vol(spark, d):
    """Registry star join, then three tiers. The registry names each asset's volatility index; 'O' is the proxy from mid-1995."""
    registry = spark.createDataFrame([("A", "F"), ("N", "O"), ("R", "F")], "asset_id string, series_id string")
    vols = A.weekly_values(T.volatility(spark, d))
    primary = vols.join(F.broadcast(registry), "series_id")
    proxy = vols.where("series_id = 'O' and week >= date'1995-06-30'").crossJoin(F.broadcast(registry.select("asset_id")))
    realised = weekly_prices(spark, d).select(F.col("series_id").alias("asset_id"), "week", "value")
    return A.tiered(primary, proxy, realised).select("asset_id", "week", "vol", "mode")


@query(
    f"""WITH {T.VOLATILITY}, {T.PRICES}, cal AS (SELECT DISTINCT obs_date AS day FROM prices WHERE isodow(obs_date) <= 5), ids AS (SELECT DISTINCT series_id FROM vols)
SELECT i.series_id, c.day, last_value(v.value IGNORE NULLS) OVER (PARTITION BY i.series_id ORDER BY c.day) AS value FROM cal c CROSS JOIN ids i LEFT JOIN vols v ON v.series_id = i.series_id AND v.obs_date = c.day"""
)
def ffill_calendar(spark, d):
    days = T.prices(spark, d).select(F.col("obs_date").alias("day")).distinct().where("weekday(day) < 5")
    return A.filled_forward(days, T.volatility(spark, d))


@query(f"WITH {T.PRICES} SELECT series_id, CAST({T.friday('obs_date')} AS DATE) AS week, arg_max(value, obs_date) AS last_value, count(*) AS n_days FROM prices GROUP BY 1, 2")
def resample_weekly(spark, d):
    return T.prices(spark, d).groupBy("series_id", C.next_friday("obs_date").alias("week")).agg(F.max_by("value", "obs_date").alias("last_value"), F.count("*").alias("n_days"))


@query("WITH v AS (SELECT n_regionkey, max(DATE '1995-01-06' + n_nationkey * 11) AS d FROM nation GROUP BY 1) SELECT CAST(m + ((12 - isodow(m)) % 7)::INT + 7 * (312 - 1 + 53) AS DATE) AS effective_start FROM (SELECT max(d) AS m FROM v)")
def strict_effective_start(spark, d):
    first = T.table(spark, d, "nation").select(F.expr("date_add(date'1995-01-06', n_nationkey * 11)").alias("first_date"))
    return C.strict_start(first)


@query(
    f"""{WEEKLY_RETURNS}, c AS (SELECT series_id, week, r IS NOT NULL AS ok, count(*) FILTER (r IS NOT NULL) OVER (PARTITION BY series_id ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 98 DAY PRECEDING) AS n FROM r)
SELECT series_id, min(week) FILTER (ok AND n >= 104) AS effective_start FROM c GROUP BY 1"""
)
def effective_start(spark, d):
    return C.effective_start(weekly_returns_df(spark, d), F.col("r").isNotNull(), 104, 14, ID)


@query(
    f"""{WEEKLY}, ready AS (SELECT series_id, min(week) AS first_week, count(*) AS n FROM weekly GROUP BY 1)
SELECT CAST(max(first_week) + 7 * (104 - 1 + 14) AS DATE) AS effective_start, CAST(floor(date_diff('day', min(first_week), max(first_week)) / 7) + 1 AS BIGINT) AS weeks_apart FROM ready"""
)
def panel_effective_start(spark, d):
    ready = weekly_prices(spark, d).groupBy("series_id").agg(F.min("week").alias("first_date"))
    start = C.strict_start(ready, 104, 14)
    return start.crossJoin(ready.agg(C.weeks_between(F.min("first_date"), F.max("first_date")).cast("bigint").alias("weeks_apart")))


@query(
    f"""{WEEKLY}, w AS (SELECT DISTINCT week FROM weekly), t AS (SELECT a.week AS as_of, count(*) AS n FROM w a JOIN w b ON b.week <= a.week - 98 GROUP BY 1 HAVING count(*) >= 104)
SELECT t.as_of, least(t.n, 208) AS n_rows, (SELECT week FROM (SELECT week, row_number() OVER (ORDER BY week) AS i FROM w) x WHERE x.i = t.n - least(t.n, 208) + 1) AS first_week, (SELECT max(week) FROM w WHERE week <= t.as_of - 98) AS last_week FROM t"""
)
def embargo_training_rows(spark, d):
    weeks = weekly_prices(spark, d).select("week").distinct()
    return A.training_sets(weeks.select(F.col("week").alias("as_of")), weeks, 14, 104, 208).select("as_of", F.col("n_rows").cast("bigint").alias("n_rows"), "first_week", "last_week")


@query(f"{WEEKLY}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week DESC) AS i FROM weekly WHERE week <= DATE '2000-06-30') SELECT series_id, week, value FROM n WHERE i <= 104")
def last_rows(spark, d):
    n = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("week")))
    return weekly_prices(spark, d).where("week <= date'2000-06-30'").withColumn("i", n).where("i <= 104").drop("i")


@query(f"{WEEKLY}, b AS (SELECT w.*, (SELECT p.value FROM weekly p WHERE p.series_id = w.series_id AND p.week <= w.week - 364 ORDER BY p.week DESC LIMIT 1) AS before FROM weekly w) SELECT series_id, week, round(value - before, 6) AS change FROM b WHERE before IS NOT NULL")
def year_ago_change(spark, d):
    """Against the last week at least 52 weeks earlier, whatever gaps there are."""
    w = by_week().orderBy(F.unix_date("week")).rangeBetween(Window.unboundedPreceding, -364)
    return weekly_prices(spark, d).withColumn("before", F.last("value").over(w)).where("before is not null").select("series_id", "week", r6(F.col("value") - F.col("before"), "change"))
