"""Backtest metrics, run lengths, gates, bootstraps and orchestration counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import quantiles as Q
from tidemark.operators import performance as P
from tidemark.operators import windows as W
from tidemark.queries.distribution import FORECAST, PINBALL, QS, RAW, forecast, raw_scores
from tidemark.queries.series import ID, WEEKLY_RETURNS, r6, weekly_prices, weekly_returns_df
from tidemark.sources import tables as T


@query(f"{WEEKLY_RETURNS} SELECT series_id, round(52 * (avg(r) - 0.5::DOUBLE * coalesce(var_samp(r), 0)), 6) AS ceq FROM r WHERE r IS NOT NULL GROUP BY 1")
def ceq(spark, d):
    return weekly_returns_df(spark, d).where("r is not null").groupBy("series_id").agg(r6(P.certainty_equivalent("r"), "ceq"))


@query(
    f"""{WEEKLY_RETURNS}, w AS (SELECT series_id, week, exp(sum(r) OVER o) AS wealth FROM r WHERE r IS NOT NULL WINDOW o AS (PARTITION BY series_id ORDER BY week)),
p AS (SELECT series_id, wealth, greatest(1, max(wealth) OVER (PARTITION BY series_id ORDER BY week)) AS peak FROM w) SELECT series_id, round(max(1 - wealth / peak), 6) AS max_drawdown FROM p GROUP BY 1"""
)
def max_drawdown(spark, d):
    return W.drawdown("r", ID, "week", weekly_returns_df(spark, d).where("r is not null")).select("series_id", r6(F.col("max_drawdown"), "max_drawdown"))


@query(f"{RAW}, m AS (SELECT series_id, abs(raw - lag(raw) OVER (PARTITION BY series_id ORDER BY week)) AS move FROM s) SELECT series_id, round(52 * avg(move) / 100, 6) AS turnover FROM m GROUP BY 1")
def turnover(spark, d):
    return P.turnover(raw_scores(spark, d), "raw", ID, "week").select("series_id", r6(F.col("turnover"), "turnover"))


MODES = f"{RAW}, b AS (SELECT series_id, week, CASE WHEN raw < 20 THEN 'BLOCKED' WHEN raw < 35 THEN 'DEGRADED' ELSE 'NORMAL' END AS mode FROM s)"


def modes(spark, d) -> DataFrame:
    return raw_scores(spark, d).select("series_id", "week", F.when(F.col("raw") < 20, "BLOCKED").when(F.col("raw") < 35, "DEGRADED").otherwise("NORMAL").alias("mode"))


@query(f"{MODES} SELECT series_id, round(avg(CASE WHEN mode = 'BLOCKED' THEN 1.0::DOUBLE ELSE 0 END), 6) AS blocked, count(*) FILTER (mode = 'NORMAL') AS n_normal, count(*) FILTER (mode = 'DEGRADED') AS n_degraded FROM b GROUP BY 1")
def blocked_rate(spark, d):
    return modes(spark, d).groupBy("series_id").agg(r6(F.coalesce(F.avg((F.col("mode") == "BLOCKED").cast("double")), F.lit(1.0)), "blocked"), F.count_if(F.col("mode") == "NORMAL").alias("n_normal"), F.count_if(F.col("mode") == "DEGRADED").alias("n_degraded"))


@query(f"{MODES} SELECT series_id, mode, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY series_id))::DOUBLE, 6) AS share FROM b GROUP BY 1, 2")
def mode_shares(spark, d):
    n = modes(spark, d).groupBy("series_id", "mode").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("series_id")), 6))


@query(f"{FORECAST}, s AS (SELECT series_id, week, {PINBALL} AS p FROM fc) SELECT week, round(avg(p), 6) AS panel_mean, count(*) AS n_assets FROM s GROUP BY 1")
def panel_mean(spark, d):
    return forecast(spark, d).groupBy("week").agg(r6(F.avg(Q.pinball("y", QS)), "panel_mean"), F.count("*").alias("n_assets"))


RUNS = "e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER o IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)"


def event_runs(spark, d) -> DataFrame:
    rows = T.table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return W.islands(rows, "event_type", ["user_id"], "at")


@query(f"WITH {RUNS} SELECT event_id, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS dwell FROM i")
def dwell_runs(spark, d):
    return event_runs(spark, d).select("event_id", F.col("run").cast("bigint").alias("run"), F.col("dwell").cast("bigint").alias("dwell"))


@query(f"WITH {RUNS}, r AS (SELECT user_id, run, event_type, count(*) AS n FROM i GROUP BY 1, 2, 3) SELECT event_type, count(*) AS n_runs, round(avg(n), 6) AS mean_dwell, CAST(max(n) AS BIGINT) AS longest FROM r GROUP BY 1")
def duration_by_state(spark, d):
    runs = event_runs(spark, d).groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))
    return runs.groupBy("event_type").agg(F.count("*").alias("n_runs"), r6(F.avg("n"), "mean_dwell"), F.max("n").alias("longest"))


@query(
    """WITH h AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT CAST(day AS DATE) AS day, event_type, n / (sum(n) OVER (PARTITION BY day))::DOUBLE AS p FROM h),
r AS (SELECT *, avg(p) OVER w AS a, count(p) OVER w AS k FROM p WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING)) SELECT event_type, bool_or(a < 0.15::DOUBLE) AS degenerate, round(min(a), 6) AS least FROM r WHERE k = 7 GROUP BY 1"""
)
def degenerate_occupancy(spark, d):
    n = T.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("day")))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)
    r = p.withColumn("a", F.avg("p").over(w)).withColumn("k", F.count("p").over(w)).where("k = 7")
    return r.groupBy("event_type").agg(F.bool_or(F.col("a") < 0.15).alias("degenerate"), r6(F.min("a"), "least"))


@query(f"{WEEKLY_RETURNS}, f AS (SELECT series_id, week, lead(r, 13) OVER (PARTITION BY series_id ORDER BY week) AS y, 1 + abs(r) AS w, CASE WHEN r > 0 THEN 1 ELSE 0 END AS state FROM r), a AS (SELECT series_id, state, sum(w * y) / sum(w) AS m FROM f WHERE y IS NOT NULL AND w IS NOT NULL GROUP BY 1, 2) SELECT series_id, CAST(state AS INT) AS state, round(m, 6) AS mean_return, CAST(row_number() OVER (PARTITION BY series_id ORDER BY m, state) AS INT) AS label_rank FROM a")
def state_label_order(spark, d):
    """States by weighted mean of the return that follows, least first; ties by state."""
    rows = weekly_returns_df(spark, d).withColumn("y", F.lead("r", 13).over(Window.partitionBy("series_id").orderBy("week"))).where("y is not null and r is not null")
    rows = rows.select("series_id", "y", (1 + F.abs("r")).alias("w"), (F.col("r") > 0).cast("int").alias("state"))
    m = rows.groupBy("series_id", "state").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    return m.select("series_id", "state", r6(F.col("m"), "mean_return"), F.row_number().over(Window.partitionBy("series_id").orderBy("m", "state")).alias("label_rank"))


@query(
    f"""{FORECAST}, m AS (SELECT avg(CASE WHEN y <= q2 THEN 1.0::DOUBLE ELSE 0 END) AS c10, avg(CASE WHEN y <= q6 THEN 1.0::DOUBLE ELSE 0 END) AS c90, 1 - avg({PINBALL}) / avg(abs(y)) AS gain, count(*)::DOUBLE AS n FROM fc)
SELECT gate, round(observed, 6) AS observed, passed FROM (SELECT 'coverage_q10' AS gate, c10 AS observed, abs(c10 - 0.1::DOUBLE) <= 0.05::DOUBLE AS passed FROM m UNION ALL SELECT 'coverage_q90', c90, abs(c90 - 0.9::DOUBLE) <= 0.05::DOUBLE FROM m UNION ALL SELECT 'crps_improvement', gain, gain >= 0.05::DOUBLE FROM m UNION ALL SELECT 'sample', n, n >= 100 FROM m)"""
)
def acceptance_gates(spark, d):
    hit = lambda x: F.avg((F.col("y") <= F.col(x)).cast("double"))
    m = forecast(spark, d).agg(hit("q2").alias("c10"), hit("q6").alias("c90"), (1 - F.avg(Q.pinball("y", QS)) / F.avg(F.abs("y"))).alias("gain"), F.count("*").alias("n"))
    c = F.col
    rules = [("coverage_q10", c("c10"), F.abs(c("c10") - 0.1) <= 0.05), ("coverage_q90", c("c90"), F.abs(c("c90") - 0.9) <= 0.05), ("crps_improvement", c("gain"), c("gain") >= 0.05), ("sample", c("n"), c("n") >= 100)]
    return P.gates(m, rules).select("gate", r6(F.col("observed"), "observed"), "passed")


@query(f"{FORECAST}, a AS (SELECT week, {PINBALL} AS p, abs(y) AS b FROM fc WHERE series_id = 'A'), n AS (SELECT week, {PINBALL} AS p FROM fc WHERE series_id = 'N'), j AS (SELECT a.week, a.p AS production, n.p AS challenger, a.b AS baseline FROM a JOIN n USING (week)) SELECT model, round(avg(score), 6) AS crps, count(*) AS n FROM (UNPIVOT j ON production, challenger, baseline INTO NAME model VALUE score) GROUP BY 1")
def model_comparison(spark, d):
    """Scores of production, challenger and baseline over the weeks that all have."""
    s = forecast(spark, d).select("series_id", "week", Q.pinball("y", QS).alias("p"), F.abs("y").alias("b"))
    a = s.where("series_id = 'A'").select("week", F.col("p").alias("production"), F.col("b").alias("baseline"))
    n = s.where("series_id = 'N'").select("week", F.col("p").alias("challenger"))
    return a.join(n, "week").unpivot("week", ["production", "challenger", "baseline"], "model", "score").groupBy("model").agg(r6(F.avg("score"), "crps"), F.count("*").alias("n"))


@query(f"{FORECAST}, a AS (SELECT week FROM fc WHERE series_id = 'A'), n AS (SELECT week, q4 FROM fc WHERE series_id = 'N') SELECT count(*) AS n_strict, count(n.week) AS n_challenger, count(*) - count(n.week) AS gap, count(*) FILTER (q4 < 0) AS n_negative FROM a LEFT JOIN n USING (week)")
def coverage_gap(spark, d):
    f = forecast(spark, d)
    a, n = f.where("series_id = 'A'").select("week"), f.where("series_id = 'N'").select("week", "q4", F.lit(1).alias("has"))
    return a.join(n, "week", "left").agg(F.count("*").alias("n_strict"), F.count("has").alias("n_challenger"), (F.count("*") - F.count("has")).alias("gap"), F.count_if(F.col("q4") < 0).alias("n_negative"))


#: Of the bootstraps, for every series.
REPS, LENGTHS, SEED = 2000, [52, 78], 42
LCG = f"* {P.LCG_A} + {P.LCG_C}) % {P.LCG_M}"


CLUSTER = f"{FORECAST.replace('WITH prices', 'WITH RECURSIVE prices', 1)}, wk AS (SELECT week, sum({PINBALL}) AS p, sum(abs(y)) AS b FROM fc GROUP BY 1), mx AS (SELECT row_number() OVER (ORDER BY week) - 1 AS idx, p, b FROM wk)"


def week_rows(spark, d) -> DataFrame:
    weeks = forecast(spark, d).groupBy("week").agg(F.sum(Q.pinball("y", QS)).alias("p"), F.sum(F.abs("y")).alias("b"))
    return weeks.withColumn("idx", (F.row_number().over(Window.orderBy("week")) - 1).cast("bigint"))


def streams_sql(keys: str) -> str:
    """st (keys, block_length, rep, pos, idx) over mx (keys, idx, ...), by recursion from position to position."""
    k = "".join(f"{x}, " for x in keys.split())
    each = f" GROUP BY {', '.join(keys.split())}" if keys else ""
    return f"""nn AS (SELECT {k}CAST(count(*) AS BIGINT) AS n FROM mx{each}), st AS (SELECT {k}n, len AS block_length, r AS rep, 0 AS k, CAST(({SEED} + r * 7919) % {P.LCG_M} AS HUGEINT) AS s, CAST(-1 AS BIGINT) AS i FROM nn, range({REPS}) t(r), (VALUES {', '.join(f'({x})' for x in LENGTHS)}) l(len) UNION ALL
SELECT {k}n, block_length, rep, k + 1, s2, CASE WHEN i < 0 OR s1 * block_length < {P.LCG_M} THEN CAST(s2 * n // {P.LCG_M} AS BIGINT) ELSE (i + 1) % n END FROM (SELECT *, (s1 {LCG} AS s2 FROM (SELECT *, (s {LCG} AS s1 FROM st) x WHERE k < n) y),
bs AS (SELECT {k}block_length, rep, k - 1 AS pos, i AS idx FROM st WHERE k > 0)"""


EACH = f"{FORECAST.replace('WITH prices', 'WITH RECURSIVE prices', 1)}, mx AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS idx, {PINBALL} AS p, abs(y) AS b, y FROM fc)"


def all_metric_rows(spark, d) -> DataFrame:
    """(series_id, idx, p, b, y) of every series."""
    return forecast(spark, d).select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("week")) - 1).cast("bigint").alias("idx"), Q.pinball("y", QS).alias("p"), F.abs("y").alias("b"), "y")


def each_series(spark, d) -> tuple[DataFrame, DataFrame]:
    """The metric rows of every series, and the streams of their replications."""
    rows = all_metric_rows(spark, d)
    return rows, P.index_streams(rows.groupBy("series_id").agg(F.count("*").alias("n")), ["series_id"], REPS, LENGTHS, SEED)


@query(f"{EACH}, {streams_sql('series_id')} SELECT series_id, block_length, CAST(rep AS BIGINT) AS rep, count(*) AS n, CAST(sum(idx) AS BIGINT) AS checksum FROM bs GROUP BY 1, 2, 3")
def bootstrap_stream(spark, d):
    return each_series(spark, d)[1].groupBy("series_id", "block_length", "rep").agg(F.count("*").alias("n"), F.sum("idx").alias("checksum"))


P05 = "v AS (SELECT series_id, block_length, rep, 1 - avg(p) / avg(b) AS gain, 52 * (avg(y) - 0.5::DOUBLE * var_samp(y)) AS ceq FROM bs JOIN mx USING (series_id, idx) GROUP BY 1, 2, 3)"


@query(f"{EACH}, {streams_sql('series_id')}, {P05} SELECT series_id, block_length, round(quantile_cont(gain, 0.05::DOUBLE), 6) AS gain_p05, round(quantile_cont(ceq, 0.05::DOUBLE), 6) AS ceq_p05 FROM v GROUP BY 1, 2")
def bootstrap_p05(spark, d):
    rows, streams = each_series(spark, d)
    stats = streams.join(F.broadcast(rows), ["series_id", "idx"]).groupBy("series_id", "block_length", "rep").agg((1 - F.try_divide(F.avg("p"), F.avg("b"))).alias("gain"), P.certainty_equivalent("y").alias("ceq"))
    return stats.groupBy("series_id", "block_length").agg(r6(F.percentile("gain", F.lit(0.05)), "gain_p05"), r6(F.percentile("ceq", F.lit(0.05)), "ceq_p05"))


@query(f"{CLUSTER}, {streams_sql('')}, v AS (SELECT block_length, rep, 1 - sum(p) / sum(b) AS gain FROM bs JOIN mx USING (idx) GROUP BY 1, 2) SELECT block_length, round(quantile_cont(gain, 0.05::DOUBLE), 6) AS gain_p05, round(avg(gain), 6) AS gain_mean FROM v GROUP BY 1")
def cluster_bootstrap_p05(spark, d):
    """Whole weeks of all assets are drawn together."""
    rows = week_rows(spark, d)
    streams = P.index_streams(rows.agg(F.count("*").alias("n")), [], REPS, LENGTHS, SEED)
    v = streams.join(F.broadcast(rows), "idx").groupBy("block_length", "rep").agg((1 - F.sum("p") / F.sum("b")).alias("gain"))
    return v.groupBy("block_length").agg(r6(F.percentile("gain", F.lit(0.05)), "gain_p05"), r6(F.avg("gain"), "gain_mean"))


@query(
    f"""{EACH.replace('WITH RECURSIVE', 'WITH', 1)}, k AS (SELECT series_id, count(*) AS n FROM mx GROUP BY 1), bl AS (SELECT series_id, r AS rep, b AS block, CAST((CAST({SEED} + r * 7919 + b * 104729 AS HUGEINT) {LCG} AS HUGEINT) AS s, n FROM k, range(400) t(r), range(100) u(b) WHERE b * 20 < n),
ix AS (SELECT series_id, rep, block * 20 + o AS pos, CAST(s * (n - 19) // {P.LCG_M} AS BIGINT) + o AS idx, n FROM bl, range(20) v(o)), gx AS (SELECT series_id, rep, avg(b - p) AS m FROM ix JOIN mx USING (series_id, idx) WHERE pos < n GROUP BY 1, 2)
SELECT series_id, round(count(*) FILTER (m > 0) / 400.0::DOUBLE, 6) AS positive_share, round(avg(m), 6) AS mean_gain FROM gx GROUP BY 1"""
)
def block_sign_stability(spark, d):
    rows = all_metric_rows(spark, d)
    blocks = P.moving_blocks(rows.groupBy("series_id").agg(F.count("*").alias("n")), 400, 20, SEED)
    means = blocks.join(F.broadcast(rows), ["series_id", "idx"]).groupBy("series_id", "rep").agg(F.avg(F.col("b") - F.col("p")).alias("m"))
    return means.groupBy("series_id").agg(r6(F.count_if(F.col("m") > 0) / F.lit(400.0), "positive_share"), r6(F.avg("m"), "mean_gain"))


@query(f"{RAW} SELECT series_id, arg_max_null(week, raw) AS best_week, round(max(raw), 4) AS best FROM (SELECT series_id, raw, min(week) AS week FROM s GROUP BY 1, 2) GROUP BY 1")
def top_candidate(spark, d):
    """Best score of each series; the first week wins ties."""
    w = Window.partitionBy("series_id").orderBy(F.desc("raw"), "week")
    return raw_scores(spark, d).withColumn("i", F.row_number().over(w)).where("i = 1").select("series_id", F.col("week").alias("best_week"), F.round("raw", 4).alias("best"))


@query(f"{WEEKLY_RETURNS} SELECT series_id, week, CAST(ntile(7) OVER (PARTITION BY series_id ORDER BY week) AS INT) AS chunk FROM r")
def work_chunks(spark, d):
    return weekly_prices(spark, d).select("series_id", "week", F.ntile(7).over(Window.partitionBy("series_id").orderBy("week")).alias("chunk"))
