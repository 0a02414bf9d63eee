"""Acceptance: strict metric rows, the production and panel gates, staged decisions and the cycle protocol."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, query
from tidemark.functions import quantiles as Q
from tidemark.functions import scalar as S
from tidemark.operators import alignment as A
from tidemark.operators import calendar as C
from tidemark.operators import evaluate as V
from tidemark.operators import performance as P
from tidemark.operators import windows as W
from tidemark.queries.backtest import LCG, LENGTHS, REPS, SEED, streams_sql
from tidemark.queries.distribution import QS, RAW, forecast, missing_guard, raw_scores
from tidemark.queries.series import ID, WEEKLY_RETURNS, by_week, r6, weekly_returns_df
from tidemark.queries.storage import materialised
from tidemark.sources import tables as T

PS = [f"p{k}" for k in range(1, 8)]
#: Weeks between the first vintage of the last macro series and the first week that counts.
WARM_UP = 26


@dataclass(frozen=True)
class Limits:
    """Thresholds of the production gates; those of the panel where they differ."""

    coverage: float = 0.03
    improvement: float = 0.05
    ceq_floor: float = -0.005
    drawdown: float = 0.03
    turnover: float = 1.5
    blocked: float = 0.15
    panel_coverage: float = 0.05
    collapse: float = 0.08


LIMITS = Limits()
#: Structural gates that tests establish outside the data.
STRUCTURAL = {"bit_identical_determinism": True, "vintage_strict_pit": True, "research_firewall": True, "state_label_map_stability": True}


def pinball_sql(y: str, q: list[str]) -> str:
    return "2 * (" + " + ".join(f"greatest({t}::DOUBLE * ({y} - {x}), ({t}::DOUBLE - 1) * ({y} - {x}))" for t, x in zip(Q.TAUS, q, strict=True)) + ") / 7"


CURVE_SQL = "fc.q2 - 0.6::DOUBLE * (fc.q3 - fc.q2) AS p1, fc.q2 AS p2, fc.q3 AS p3, fc.q4 AS p4, fc.q5 AS p5, fc.q6 AS p6, fc.q6 + 0.6::DOUBLE * (fc.q6 - fc.q5) AS p7"
OUTS = f"""{RAW.replace('WITH prices', 'WITH RECURSIVE prices', 1)}, guard AS ({ORACLES['missing_guard']}),
vs AS (WITH {T.VINTAGES} SELECT CAST({T.friday('max(m)')} AS DATE) AS strict_start FROM (SELECT min(realtime_start) AS m FROM known GROUP BY series_id) x),
outs AS (SELECT fc.series_id, fc.week, CASE WHEN fc.week >= strict_start THEN 'strict' ELSE 'pseudo' END AS vintage_mode, strict_start + {7 * WARM_UP} AS effective, coalesce(guard.mode, 'BLOCKED') AS mode, fc.y, {', '.join(f'fc.{q}' for q in QS)}, {CURVE_SQL}, CASE WHEN guard.mode = 'NORMAL' THEN s.raw ELSE 50::DOUBLE END AS offense
FROM fc JOIN s USING (series_id, week) LEFT JOIN guard ON guard.week = fc.week CROSS JOIN vs),
sr AS (SELECT series_id, week, CASE WHEN y <= p2 THEN 1.0::DOUBLE ELSE 0 END AS hit10, CASE WHEN y <= p6 THEN 1.0::DOUBLE ELSE 0 END AS hit90, {pinball_sql('y', PS)} AS p, {pinball_sql('y', QS)} AS b, offense / 100 * y AS r1, 0.5::DOUBLE * y AS r0 FROM outs WHERE vintage_mode = 'strict' AND week >= effective AND isfinite(y) AND isfinite(p1 + p2 + p3 + p4 + p5 + p6 + p7))"""


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """Weekly outputs of each series: vintage mode, guard mode, the outcome y, the baseline's curve q1..q7, the production
    curve p1..p7 (tails from the inner quantiles) and the final score, which is neutral unless the week is normal."""
    first = T.vintages(spark, d).groupBy("series_id").agg(F.min("realtime_start").alias("m"))
    start = first.agg(C.next_friday(F.max("m")).alias("strict_start"))
    low, high = Q.extrapolated("q2", "q3", "q5", "q6")
    rows = forecast(spark, d).join(raw_scores(spark, d), ["series_id", "week"]).join(missing_guard(spark, d).select("week", "mode"), "week", "left").join(F.broadcast(start), F.lit(True))
    mode = F.coalesce("mode", F.lit("BLOCKED"))
    return rows.select("series_id", "week", F.when(F.col("week") >= F.col("strict_start"), "strict").otherwise("pseudo").alias("vintage_mode"), F.date_add("strict_start", 7 * WARM_UP).alias("effective"), mode.alias("mode"), "y", *QS, low.alias("p1"), *[F.col(f"q{k}").alias(f"p{k}") for k in range(2, 7)], high.alias("p7"), F.when(mode == "NORMAL", F.col("raw")).otherwise(F.lit(50.0)).alias("offense"))


def strict_rows(outs: DataFrame) -> DataFrame:
    """Metric rows of the strict weeks from the effective start on, with a finite outcome and a finite curve."""
    finite = S.finite(F.col("y")).isNotNull() & S.finite(Q.total([F.col(p) for p in PS])).isNotNull()
    rows = outs.where((F.col("vintage_mode") == "strict") & (F.col("week") >= F.col("effective")) & finite)
    hit = lambda p: (F.col("y") <= F.col(p)).cast("double")
    return rows.select("series_id", "week", hit("p2").alias("hit10"), hit("p6").alias("hit90"), Q.pinball("y", PS).alias("p"), Q.pinball("y", QS).alias("b"), (F.col("offense") / 100 * F.col("y")).alias("r1"), (0.5 * F.col("y")).alias("r0"))


@query(f"{OUTS} SELECT series_id, week, hit10, hit90, round(p, 6) AS crps, round(b, 6) AS crps_baseline, round(r1, 6) AS production_return, round(r0, 6) AS baseline_return FROM sr")
def strict_metric_rows(spark, d):
    return strict_rows(outputs(spark, d)).select("series_id", "week", "hit10", "hit90", r6(F.col("p"), "crps"), r6(F.col("b"), "crps_baseline"), r6(F.col("r1"), "production_return"), r6(F.col("r0"), "baseline_return"))


def gate_rows(metrics: DataFrame, keys: list[str], gates: list[tuple[str, dict[str, Column], Column]]) -> DataFrame:
    """(keys, gate, measure, observed, passed) of each gate (name, measures, condition). A missing value fails."""
    rows = [F.struct(F.lit(name).alias("gate"), F.lit(m).alias("measure"), x.cast("double").alias("observed"), F.coalesce(ok, F.lit(False)).alias("passed")) for name, seen, ok in gates for m, x in seen.items()]
    return metrics.select(*keys, F.explode(F.array(*rows)).alias("g")).select(*keys, "g.gate", "g.measure", r6(F.col("g.observed"), "observed"), "g.passed")


def gates_sql(keys: str, source: str, gates: list[tuple[str, dict[str, str], str]]) -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {k}'{name}' AS gate, '{m}' AS measure, round(CAST({x} AS DOUBLE), 6) AS observed, coalesce({ok}, FALSE) AS passed FROM {source}" for name, seen, ok in gates for m, x in seen.items())


def drawdown_sql(r: str, name: str) -> str:
    return f"""{name}w AS (SELECT series_id, week, exp(sum({r}) OVER (PARTITION BY series_id ORDER BY week)) AS wealth FROM sr), {name}p AS (SELECT series_id, wealth, greatest(1, max(wealth) OVER (PARTITION BY series_id ORDER BY week)) AS peak FROM {name}w), {name} AS (SELECT series_id, max(1 - wealth / peak) AS {name} FROM {name}p GROUP BY 1)"""


PRODUCTION_SQL = f"""{OUTS}, mx AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY week) - 1 AS idx FROM sr), {streams_sql('series_id')},
v AS (SELECT series_id, block_length, rep, 1 - avg(p) / avg(b) AS gain, 52 * (avg(r1) - 0.5::DOUBLE * coalesce(var_samp(r1), 0)) - 52 * (avg(r0) - 0.5::DOUBLE * coalesce(var_samp(r0), 0)) AS ceq FROM bs JOIN mx USING (series_id, idx) GROUP BY 1, 2, 3),
bp AS (SELECT series_id, block_length, quantile_cont(gain, 0.05::DOUBLE) AS gain, quantile_cont(ceq, 0.05::DOUBLE) AS ceq FROM v GROUP BY 1, 2),
bw AS (SELECT series_id, {', '.join(f'max(gain) FILTER (block_length = {n}) AS gain{n}, max(ceq) FILTER (block_length = {n}) AS ceq{n}' for n in LENGTHS)} FROM bp GROUP BY 1),
{drawdown_sql('r1', 'dd1')}, {drawdown_sql('r0', 'dd0')},
ms AS (SELECT series_id, abs(avg(hit10) - 0.1::DOUBLE) AS e10, abs(avg(hit90) - 0.9::DOUBLE) AS e90, 1 - avg(p) / avg(b) AS gain, 52 * (avg(r1) - 0.5::DOUBLE * coalesce(var_samp(r1), 0)) - 52 * (avg(r0) - 0.5::DOUBLE * coalesce(var_samp(r0), 0)) AS ceq FROM sr GROUP BY 1),
tn AS (SELECT series_id, 52 * avg(abs(step)) / 100 AS turnover FROM (SELECT series_id, offense - lag(offense) OVER (PARTITION BY series_id ORDER BY week) AS step FROM outs) x GROUP BY 1),
os AS (SELECT series_id, avg(CASE WHEN mode = 'BLOCKED' THEN 1.0::DOUBLE ELSE 0 END) AS blocked, avg(CASE WHEN p1 <= p2 AND p2 <= p3 AND p3 <= p4 AND p4 <= p5 AND p5 <= p6 AND p6 <= p7 THEN 1.0::DOUBLE ELSE 0 END) AS ordered, avg(CASE WHEN isfinite(p1 + p2 + p3 + p4 + p5 + p6 + p7 + offense) THEN 1.0::DOUBLE ELSE 0 END) AS finite FROM outs GROUP BY 1),
gm AS (SELECT * FROM os LEFT JOIN ms USING (series_id) LEFT JOIN tn USING (series_id) LEFT JOIN bw USING (series_id) LEFT JOIN dd1 USING (series_id) LEFT JOIN dd0 USING (series_id))"""


def production_gate_list(c, column, both) -> list[tuple]:
    """The eleven gates. c: a column by name; column: a constant; both: conjunction of conditions given as (column, operator, limit)."""
    n1, n2 = LENGTHS
    return [
        *[(name, {"passed": column(1.0 if ok else 0.0)}, both([(column(1.0 if ok else 0.0), ">", 0.5)])) for name, ok in STRUCTURAL.items()],
        ("quantile_non_crossing", {"share": c("ordered")}, both([(c("ordered"), ">=", 1.0)])),
        ("tail_extrapolation_safety", {"finite": c("finite")}, both([(c("finite"), ">=", 1.0)])),
        ("interior_coverage", {"q10_error": c("e10"), "q90_error": c("e90")}, both([(c("e10"), "<=", LIMITS.coverage), (c("e90"), "<=", LIMITS.coverage)])),
        ("crps_vs_baseline_a", {"improvement": c("gain"), f"p05_{n1}": c(f"gain{n1}"), f"p05_{n2}": c(f"gain{n2}")}, both([(c("gain"), ">=", LIMITS.improvement), (c(f"gain{n1}"), ">", 0.0), (c(f"gain{n2}"), ">", 0.0)])),
        ("ceq_vs_baseline_b", {"diff": c("ceq"), f"p05_{n1}": c(f"ceq{n1}"), f"p05_{n2}": c(f"ceq{n2}")}, both([(c("ceq"), ">", LIMITS.ceq_floor), (c(f"ceq{n1}"), ">", LIMITS.ceq_floor), (c(f"ceq{n2}"), ">", LIMITS.ceq_floor)])),
        ("max_drawdown_vs_baseline_b", {"diff": c("dd")}, both([(c("dd"), "<=", LIMITS.drawdown)])),
        ("turnover_and_blocked_proportion", {"turnover": c("turnover"), "blocked_proportion": c("blocked")}, both([(c("turnover"), "<=", LIMITS.turnover), (c("blocked"), "<=", LIMITS.blocked)])),
    ]


def in_sql(gates, **known: str) -> list[tuple]:
    """The gates as SQL; known: expressions that stand for a name."""
    return gates(lambda n: known.get(n, n), lambda v: f"{v}::DOUBLE", lambda cs: " AND ".join(f"{x} {op} {v}::DOUBLE" for x, op, v in cs))


def in_spark(gates) -> list[tuple]:
    compare = {">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<=": lambda x, v: x <= v}
    return gates(F.col, F.lit, lambda cs: reduce(lambda a, b: a & b, [compare[op](x, F.lit(v)) for x, op, v in cs]))


def lower_quantiles(streams: DataFrame, rows: DataFrame, on: list[str], keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """The 5 % quantile of each statistic over the replications, a column for each statistic and block length. rows has a row per week."""
    each = streams.join(F.broadcast(rows), on).groupBy(*keys, "block_length", "rep").agg(*[x.alias(n) for n, x in stats.items()])
    low = each.groupBy(*keys, "block_length").agg(*[F.percentile(n, F.lit(0.05)).alias(n) for n in stats])
    return low.groupBy(*keys).agg(*[F.max(F.when(F.col("block_length") == n, F.col(x))).alias(f"{x}{n}") for n in LENGTHS for x in stats])


@query(PRODUCTION_SQL + " " + gates_sql("series_id", "gm", in_sql(production_gate_list, dd="(dd1 - dd0)")))
def production_gates(spark, d):
    """The eleven production gates of each series, with 2,000 replications at both block lengths."""
    outs = materialised(spark, outputs(spark, d), "outputs")
    rows = strict_rows(outs)
    ceq = P.certainty_equivalent("r1") - P.certainty_equivalent("r0")
    gain = 1 - F.try_divide(F.avg("p"), F.avg("b"))
    ms = rows.groupBy("series_id").agg(F.abs(F.avg("hit10") - 0.1).alias("e10"), F.abs(F.avg("hit90") - 0.9).alias("e90"), gain.alias("gain"), ceq.alias("ceq"))
    placed = rows.withColumn("idx", (F.row_number().over(by_week()) - 1).cast("bigint"))
    streams = P.index_streams(rows.groupBy("series_id").agg(F.count("*").alias("n")), ID, REPS, LENGTHS, SEED)
    low = lower_quantiles(streams, placed, ["series_id", "idx"], ID, {"gain": gain, "ceq": ceq})
    falls = W.drawdown("r1", ID, "week", rows).withColumnRenamed("max_drawdown", "dd1").join(W.drawdown("r0", ID, "week", rows).withColumnRenamed("max_drawdown", "dd0"), "series_id").select("series_id", (F.col("dd1") - F.col("dd0")).alias("dd"))
    share = lambda x: F.avg(x.cast("double"))
    finite = S.finite(Q.total([F.col(p) for p in [*PS, "offense"]])).isNotNull()
    os = outs.groupBy("series_id").agg(share(F.col("mode") == "BLOCKED").alias("blocked"), share(Q.is_monotone(PS)).alias("ordered"), share(finite).alias("finite"))
    gm = reduce(lambda a, b: a.join(b, "series_id", "left"), [os, ms, P.turnover(outs, "offense", ID, "week"), low, falls])
    return gate_rows(gm, ID, in_spark(production_gate_list))


PANEL_SQL = f"""{OUTS}, wk AS (SELECT week, avg(p) AS p, avg(b) AS b FROM sr GROUP BY 1), mx AS (SELECT *, row_number() OVER (ORDER BY week) - 1 AS idx FROM wk), {streams_sql('')},
v AS (SELECT block_length, rep, 1 - avg(p) / avg(b) AS gain FROM bs JOIN mx USING (idx) GROUP BY 1, 2), bp AS (SELECT block_length, quantile_cont(gain, 0.05::DOUBLE) AS gain FROM v GROUP BY 1),
ma AS (SELECT series_id, avg(hit10) AS c10, avg(hit90) AS c90, avg(p) AS p, avg(b) AS b FROM sr GROUP BY 1),
gm AS (SELECT (SELECT max(abs(c10 - 0.1::DOUBLE)) FROM ma) AS e10, (SELECT max(abs(c90 - 0.9::DOUBLE)) FROM ma) AS e90, (SELECT 1 - avg(p) / avg(b) FROM ma WHERE b > 0) AS gain, {', '.join(f'(SELECT gain FROM bp WHERE block_length = {n}) AS gain{n}' for n in LENGTHS)},
(SELECT avg(CASE WHEN mode = 'BLOCKED' THEN 1.0::DOUBLE ELSE 0 END) FROM (SELECT DISTINCT week, mode FROM outs) x) AS blocked, (SELECT avg(CASE WHEN isfinite(p1 + p2 + p3 + p4 + p5 + p6 + p7) THEN 1.0::DOUBLE ELSE 0 END) FROM outs) AS finite)"""


def panel_gate_list(c, column, both) -> list[tuple]:
    n1, n2 = LENGTHS
    return [
        ("per_asset_q10_coverage", {"worst_error": c("e10")}, both([(c("e10"), "<=", LIMITS.panel_coverage)])),
        ("per_asset_q90_coverage", {"worst_error": c("e90")}, both([(c("e90"), "<=", LIMITS.panel_coverage)])),
        ("panel_crps_vs_baseline_a", {"improvement": c("gain"), f"p05_{n1}": c(f"gain{n1}"), f"p05_{n2}": c(f"gain{n2}")}, both([(c("gain"), ">=", LIMITS.improvement), (c(f"gain{n1}"), ">", 0.0), (c(f"gain{n2}"), ">", 0.0)])),
        ("no_asset_coverage_collapse", {"q10_error": c("e10"), "q90_error": c("e90")}, both([(c("e10"), "<=", LIMITS.collapse), (c("e90"), "<=", LIMITS.collapse)])),
        ("blocked_proportion", {"blocked_proportion": c("blocked")}, both([(c("blocked"), "<=", LIMITS.blocked)])),
        ("finite_output_safety", {"all_finite": c("finite")}, both([(c("finite"), ">=", 1.0)])),
    ]


def panel_metrics(outs: DataFrame) -> DataFrame:
    rows = strict_rows(outs)
    ma = rows.groupBy("series_id").agg(F.avg("hit10").alias("c10"), F.avg("hit90").alias("c90"), F.avg("p").alias("p"), F.avg("b").alias("b"))
    worst = ma.agg(F.max(F.abs(F.col("c10") - 0.1)).alias("e10"), F.max(F.abs(F.col("c90") - 0.9)).alias("e90"), (1 - F.try_divide(F.avg(F.when(F.col("b") > 0, F.col("p"))), F.avg(F.when(F.col("b") > 0, F.col("b"))))).alias("gain"))
    weeks = rows.groupBy("week").agg(F.avg("p").alias("p"), F.avg("b").alias("b"))
    placed = weeks.withColumn("idx", (F.row_number().over(Window.orderBy("week")) - 1).cast("bigint"))
    streams = P.index_streams(weeks.agg(F.count("*").alias("n")), [], REPS, LENGTHS, SEED)
    low = lower_quantiles(streams, placed, ["idx"], [], {"gain": 1 - F.try_divide(F.avg("p"), F.avg("b"))})
    blocked = outs.select("week", "mode").distinct().agg(F.avg((F.col("mode") == "BLOCKED").cast("double")).alias("blocked"))
    finite = outs.agg(F.avg(S.finite(Q.total([F.col(p) for p in PS])).isNotNull().cast("double")).alias("finite"))
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [worst, low, blocked, finite])


@query(PANEL_SQL + " " + gates_sql("", "gm", in_sql(panel_gate_list)))
def panel_gates(spark, d):
    """The six gates of the panel: an asset that fails one fails it for all; whole weeks are resampled."""
    return gate_rows(panel_metrics(materialised(spark, outputs(spark, d), "outputs")), [], in_spark(panel_gate_list))


#: Windows of the stages: a smoke year, a crisis year, everything.
STAGES = [("smoke", "1998-01-01", "1998-12-31"), ("crisis", "2000-01-01", "2000-12-31"), ("full", "1900-01-01", "2999-12-31")]
ORDERED_SQL = "p1 <= p2 AND p2 <= p3 AND p3 <= p4 AND p4 <= p5 AND p5 <= p6 AND p6 <= p7"


@query(
    f"""{PANEL_SQL}, gp AS (SELECT bool_and(passed) AS gates_passed FROM ({gates_sql('', 'gm', in_sql(panel_gate_list))}) x),
wo AS (SELECT week, max(mode) AS mode, count(*) AS n_assets, bool_and(isfinite(p1 + p2 + p3 + p4 + p5 + p6 + p7)) AS finite, bool_and({ORDERED_SQL}) AS ordered FROM outs GROUP BY 1),
sg AS (SELECT unnest([{', '.join(f"'{n}'" for n, _, _ in STAGES)}]) AS stage, unnest([{', '.join(f"DATE '{a}'" for _, a, _ in STAGES)}]) AS a, unnest([{', '.join(f"DATE '{b}'" for _, _, b in STAGES)}]) AS z),
st2 AS (SELECT stage, count(week) AS total_weeks, count(*) FILTER (mode = 'BLOCKED') AS blocked_weeks, count(*) FILTER (mode = 'DEGRADED') AS degraded_weeks, count(*) FILTER (NOT ordered) AS fallback_weeks, coalesce(bool_and(finite), TRUE) AS all_finite, coalesce(bool_and(ordered), TRUE) AS non_crossing, min(n_assets) AS fewest_assets FROM sg LEFT JOIN wo ON week BETWEEN a AND z GROUP BY 1),
ps AS (SELECT st2.*, CASE stage WHEN 'smoke' THEN total_weeks > 0 AND fallback_weeks = 0 AND all_finite WHEN 'crisis' THEN total_weeks > 0 AND all_finite AND non_crossing ELSE total_weeks > 0 AND gates_passed END AS passed FROM st2 CROSS JOIN gp)
SELECT stage, total_weeks, blocked_weeks, degraded_weeks, fallback_weeks, round(blocked_weeks / nullif(total_weeks, 0)::DOUBLE, 6) AS blocked_proportion, all_finite, non_crossing, fewest_assets, passed, CASE WHEN (SELECT bool_and(passed) FROM ps) THEN 'ACCEPTED' ELSE 'REJECTED' END AS conclusion FROM ps"""
)
def staged_acceptance(spark, d):
    """Stage statistics from the stored weekly outputs, each stage's verdict and the conclusion; the last stage needs all panel gates."""
    outs = materialised(spark, outputs(spark, d), "outputs")
    gates = gate_rows(panel_metrics(outs), [], in_spark(panel_gate_list)).agg(F.bool_and("passed").alias("gates_passed"))
    weeks = outs.groupBy("week").agg(F.max("mode").alias("mode"), F.count("*").alias("n_assets"), F.bool_and(S.finite(Q.total([F.col(p) for p in PS])).isNotNull()).alias("finite"), F.bool_and(Q.is_monotone(PS)).alias("ordered"))
    stages = spark.createDataFrame(STAGES, "stage string, a string, z string").select("stage", F.to_date("a").alias("a"), F.to_date("z").alias("z"))
    met = F.broadcast(stages).join(weeks, F.col("week").between(F.col("a"), F.col("z")), "left")
    stats = met.groupBy("stage").agg(F.count("week").alias("total_weeks"), F.count_if(F.col("mode") == "BLOCKED").alias("blocked_weeks"), F.count_if(F.col("mode") == "DEGRADED").alias("degraded_weeks"), F.count_if(~F.col("ordered")).alias("fallback_weeks"), F.coalesce(F.bool_and("finite"), F.lit(True)).alias("all_finite"), F.coalesce(F.bool_and("ordered"), F.lit(True)).alias("non_crossing"), F.min("n_assets").alias("fewest_assets"))
    some = F.col("total_weeks") > 0
    passed = F.when(F.col("stage") == "smoke", some & (F.col("fallback_weeks") == 0) & F.col("all_finite")).when(F.col("stage") == "crisis", some & F.col("all_finite") & F.col("non_crossing")).otherwise(some & F.col("gates_passed"))
    judged = stats.join(F.broadcast(gates), F.lit(True)).withColumn("passed", passed)
    whole = judged.agg(F.when(F.bool_and("passed"), "ACCEPTED").otherwise("REJECTED").alias("conclusion"))
    return judged.join(F.broadcast(whole), F.lit(True)).select("stage", "total_weeks", "blocked_weeks", "degraded_weeks", "fallback_weeks", r6(F.try_divide(F.col("blocked_weeks").cast("double"), F.col("total_weeks").cast("double")), "blocked_proportion"), "all_finite", "non_crossing", "fewest_assets", "passed", "conclusion")


STATES = ["CONTRACTION", "SLOWDOWN", "EXPANSION"]
OBJECTS = ["constant", "trend", "volatility", "production", "baseline"]
CURRENT = ("production", "baseline")
#: Crises whose start a signal may lead by up to LEAD weeks, and windows that a skill must survive.
CRISES = [("first", "1997-07-01", "1997-12-31"), ("second", "1998-08-01", "1998-12-31"), ("third", "2000-03-01", "2000-10-31")]
WINDOWS = [("1997", "1997-01-01", "1997-12-31"), ("1998", "1998-01-01", "1998-12-31"), ("1999", "1999-01-01", "1999-12-31")]
LEAD = 26
#: Limits of the protocol's layers.
LEAST_ROWS, CHURN, FALSE_ALARMS, DISPERSION = 12, 0.5, 0.6, 0.35
FLAT = 1e-12


def z_sql(x: str, by: str) -> str:
    return f"(({x}) - avg({x}) OVER (PARTITION BY {by})) / nullif(stddev_pop({x}) OVER (PARTITION BY {by}), 0)"


def state_sql(x: str) -> str:
    return f"CASE WHEN hi - lo <= {FLAT}::DOUBLE THEN 'SLOWDOWN' WHEN round({x}, 9) <= round(lo, 9) THEN 'CONTRACTION' WHEN round({x}, 9) >= round(hi, 9) THEN 'EXPANSION' ELSE 'SLOWDOWN' END"


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND stddev_pop({x}) > {FLAT}::DOUBLE AND stddev_pop({y}) > {FLAT}::DOUBLE THEN corr({x}, {y}) END"


def rank_sql(x: str) -> str:
    return f"rank() OVER (PARTITION BY series_id, object ORDER BY {x}) + (count(*) OVER (PARTITION BY series_id, object, {x}) - 1) / 2.0::DOUBLE"


PERIODS_SQL = {name: f"{name} AS (SELECT unnest([{', '.join(repr(n) for n, _, _ in rows)}]) AS period, unnest([{', '.join(f'DATE {a!r}' for _, a, _ in rows)}]) AS a, unnest([{', '.join(f'DATE {z!r}' for _, _, z in rows)}]) AS z)" for name, rows in (("crises", CRISES), ("windows", WINDOWS))}
CYCLE_SQL = f"""{OUTS}, fd AS ({ORACLES['forward_drawdown']}), tv AS ({ORACLES['trend_and_vol']}), {PERIODS_SQL['crises']}, {PERIODS_SQL['windows']},
la AS (SELECT f.series_id, f.week, f.y, forward_risk AS risk, forward_drawdown AS fall FROM f JOIN fd USING (series_id, week) WHERE f.y IS NOT NULL AND forward_risk IS NOT NULL AND forward_drawdown IS NOT NULL),
lz AS (SELECT *, {z_sql('y', 'series_id')} - 0.5::DOUBLE * {z_sql('risk', 'series_id')} - 0.5::DOUBLE * {z_sql('fall', 'series_id')} AS comp FROM la),
lb AS (SELECT series_id, quantile_cont(comp, 1 / 3.0::DOUBLE) AS lo, quantile_cont(comp, 2 / 3.0::DOUBLE) AS hi FROM lz GROUP BY 1),
lt AS (SELECT lz.*, {state_sql('comp')} AS truth FROM lz JOIN lb USING (series_id)),
ob AS (SELECT series_id, week, 'constant' AS object, 0::DOUBLE AS raw FROM lt UNION ALL SELECT series_id, week, 'trend', trend FROM tv WHERE trend IS NOT NULL UNION ALL SELECT series_id, week, 'volatility', -vol FROM tv WHERE vol IS NOT NULL UNION ALL SELECT series_id, week, 'production', -(p6 - p2) FROM outs UNION ALL SELECT series_id, week, 'baseline', -(q7 - q1) FROM outs),
oz AS (SELECT series_id, object, week, y, risk, fall, comp, truth, coalesce({z_sql('raw', 'series_id, object')}, 0) AS score FROM ob JOIN lt USING (series_id, week)),
oq AS (SELECT series_id, object, quantile_cont(score, 1 / 3.0::DOUBLE) AS lo, quantile_cont(score, 2 / 3.0::DOUBLE) AS hi FROM oz GROUP BY 1, 2),
ot AS (SELECT oz.*, {state_sql('score')} AS state FROM oz JOIN oq USING (series_id, object)),
om AS (SELECT *, {rank_sql('round(score, 9)')} AS rs, {rank_sql('y')} AS ry, {rank_sql('risk')} AS rr, lag(state) OVER (PARTITION BY series_id, object ORDER BY week) AS before, state = 'CONTRACTION' OR score < 0 AS alarm FROM ot),
di AS (SELECT series_id, object, count(*) AS n_obs, {corr_sql('score', 'y')} AS corr_return, {corr_sql('score', 'risk')} AS corr_risk, {corr_sql('score', 'fall')} AS corr_drawdown, {corr_sql('score', 'comp')} AS corr_composite, {corr_sql('rs', 'ry')} AS rank_return, {corr_sql('rs', 'rr')} AS rank_risk, avg(CASE WHEN before IS NOT NULL THEN CASE WHEN state <> before THEN 1.0::DOUBLE ELSE 0 END END) AS churn FROM om GROUP BY 1, 2),
cs AS (SELECT series_id, object, s.state, count(*) FILTER (om.state = s.state AND truth = s.state) AS tp, count(*) FILTER (truth = s.state) AS actual, count(*) FILTER (om.state = s.state) AS guessed FROM om CROSS JOIN (SELECT unnest([{', '.join(repr(s) for s in STATES)}]) AS state) s GROUP BY 1, 2, 3),
cl AS (SELECT series_id, object, avg(CASE WHEN actual > 0 THEN tp / actual::DOUBLE END) AS balanced_accuracy, 100 * avg(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (actual + guessed) ELSE 0 END) AS macro_f1_percent FROM cs GROUP BY 1, 2),
fa AS (SELECT series_id, object, avg(CASE WHEN alarm THEN 1.0::DOUBLE ELSE 0 END) AS false_alarms FROM om WHERE NOT EXISTS (SELECT 1 FROM crises WHERE week BETWEEN a - {7 * LEAD} AND z) GROUP BY 1, 2),
ld AS (SELECT series_id, object, count(*) AS n_leads, avg(lead) AS mean_lead FROM (SELECT series_id, object, period, max((a - week) // 7) AS lead FROM om JOIN crises ON week <= a AND (a - week) // 7 <= {LEAD} WHERE alarm GROUP BY 1, 2, 3) x GROUP BY 1, 2),
cw AS (SELECT series_id, object, period, {corr_sql('score', 'comp')} AS c FROM om JOIN windows ON week BETWEEN a AND z GROUP BY 1, 2, 3),
wd AS (SELECT series_id, object, stddev_pop(c) AS dispersion, min(c) AS worst FROM cw GROUP BY 1, 2),
al AS (SELECT *, coalesce(n_leads, 0) AS leads FROM di JOIN cl USING (series_id, object) LEFT JOIN fa USING (series_id, object) LEFT JOIN ld USING (series_id, object) LEFT JOIN wd USING (series_id, object)),
l1 AS (SELECT *, n_obs >= {LEAST_ROWS} AND coalesce(churn, 0) <= {CHURN}::DOUBLE AND corr_return IS NOT NULL AND corr_risk IS NOT NULL AS ok1 FROM al),
l2 AS (SELECT *, ok1 AND corr_return > 0 AND corr_risk < 0 AND rank_return > 0 AND rank_risk < 0 AND balanced_accuracy > 1 / 3.0::DOUBLE AND leads > 0 AND coalesce(false_alarms, 0) <= {FALSE_ALARMS}::DOUBLE AS ok2, ok1 AND coalesce(worst, 0) > 0 AND coalesce(dispersion, 0) <= {DISPERSION}::DOUBLE AS ok3 FROM l1)"""


def tercile_states(df: DataFrame, x: str, keys: list[str], name: str) -> DataFrame:
    """df with a state by terciles of x over keys; all are in the middle where x is flat. Values within rounding of a bound lie on it."""
    q = df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    state = F.when(hi - lo <= FLAT, "SLOWDOWN").when(F.round(x, 9) <= F.round(lo, 9), "CONTRACTION").when(F.round(x, 9) >= F.round(hi, 9), "EXPANSION").otherwise("SLOWDOWN")
    return df.join(F.broadcast(q), keys).withColumn(name, state).drop("q")


def guarded_corr(x: str, y: str) -> Column:
    return F.when((F.count("*") >= 3) & (F.stddev_pop(x) > FLAT) & (F.stddev_pop(y) > FLAT), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def cycle_scores(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, object, week, score, state, truth, y, risk, fall, comp): the five objects against labels of the market ahead."""
    from tidemark.queries.series import forward_drawdown, trend_and_vol, weekly_prices

    def z(x: Column, keys: list[str]) -> Column:
        w = Window.partitionBy(*keys)
        return F.try_divide(x - F.avg(x).over(w), F.stddev_pop(x).over(w))

    ahead = weekly_prices(spark, d).withColumn("y", A.forward_log_return("value", 13, ID)).select("series_id", "week", "y")
    labels = ahead.join(forward_drawdown(spark, d).select("series_id", "week", F.col("forward_risk").alias("risk"), F.col("forward_drawdown").alias("fall")), ["series_id", "week"]).dropna("any")
    c = F.col
    labels = tercile_states(labels.withColumn("comp", z(c("y"), ID) - 0.5 * z(c("risk"), ID) - 0.5 * z(c("fall"), ID)), "comp", ID, "truth")
    outs, tv = materialised(spark, outputs(spark, d), "outputs"), trend_and_vol(spark, d)
    raw = {"constant": (labels, F.lit(0.0)), "trend": (tv, c("trend")), "volatility": (tv, -c("vol")), "production": (outs, -(c("p6") - c("p2"))), "baseline": (outs, -(c("q7") - c("q1")))}
    objects = reduce(DataFrame.unionByName, [df.select("series_id", "week", F.lit(name).alias("object"), x.alias("raw")).where("raw is not null") for name, (df, x) in raw.items()])
    keys = ["series_id", "object"]
    scored = objects.join(labels, ["series_id", "week"]).withColumn("score", F.coalesce(z(c("raw"), keys), F.lit(0.0)))
    return tercile_states(scored, "score", keys, "state").drop("raw")


def cycle_metrics(rows: DataFrame) -> DataFrame:
    """A row of metrics and layer verdicts for each series and object."""
    spark, keys, c = rows.sparkSession, ["series_id", "object"], F.col
    periods = {n: F.broadcast(spark.createDataFrame(p, "period string, a string, z string").select("period", F.to_date("a").alias("a"), F.to_date("z").alias("z"))) for n, p in (("crises", CRISES), ("windows", WINDOWS))}
    rows = materialised(spark, rows.withColumn("tied", F.round("score", 9)), "cycle")  # read by every branch below
    om = V.average_ranks(rows, ["tied", "y", "risk"], keys).withColumn("before", F.lag("state").over(by_week(*keys))).withColumn("alarm", (c("state") == "CONTRACTION") | (c("score") < 0))
    named = {"corr_return": "y", "corr_risk": "risk", "corr_drawdown": "fall", "corr_composite": "comp"}
    di = om.groupBy(*keys).agg(F.count("*").alias("n_obs"), *[guarded_corr("score", x).alias(n) for n, x in named.items()], guarded_corr("rank_tied", "rank_y").alias("rank_return"), guarded_corr("rank_tied", "rank_risk").alias("rank_risk_"), F.avg((c("state") != c("before")).cast("double")).alias("churn")).withColumnRenamed("rank_risk_", "rank_risk")
    counts = [(F.count_if((c("state") == s) & (c("truth") == s)), F.count_if(c("truth") == s), F.count_if(c("state") == s)) for s in STATES]
    each = om.groupBy(*keys).agg(F.array(*[F.struct(tp.alias("tp"), a.alias("actual"), g.alias("guessed")) for tp, a, g in counts]).alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")
    cl = each.groupBy(*keys).agg(F.avg(F.when(c("actual") > 0, c("tp") / c("actual"))).alias("balanced_accuracy"), (100 * F.avg(F.when(c("tp") > 0, 2.0 * c("tp") / (c("actual") + c("guessed"))).otherwise(0.0))).alias("macro_f1_percent"))
    crises = periods["crises"]
    fa = om.join(crises, c("week").between(F.date_sub("a", 7 * LEAD), c("z")), "left_anti").groupBy(*keys).agg(F.avg(c("alarm").cast("double")).alias("false_alarms"))
    weeks = F.floor(F.datediff("a", "week") / 7)
    ld = om.where("alarm").join(crises, (c("week") <= c("a")) & (weeks <= LEAD)).groupBy(*keys, "period").agg(F.max(weeks).alias("lead")).groupBy(*keys).agg(F.count("*").alias("n_leads"), F.avg("lead").alias("mean_lead"))
    wd = om.join(periods["windows"], c("week").between(c("a"), c("z"))).groupBy(*keys, "period").agg(guarded_corr("score", "comp").alias("c")).groupBy(*keys).agg(F.stddev_pop("c").alias("dispersion"), F.min("c").alias("worst"))
    al = di.join(cl, keys).join(fa, keys, "left").join(ld, keys, "left").join(wd, keys, "left").withColumn("leads", F.coalesce("n_leads", F.lit(0)))
    no = lambda x: F.coalesce(c(x), F.lit(0.0))
    al = al.withColumn("ok1", (c("n_obs") >= LEAST_ROWS) & (no("churn") <= CHURN) & c("corr_return").isNotNull() & c("corr_risk").isNotNull())
    al = al.withColumn("ok2", c("ok1") & (c("corr_return") > 0) & (c("corr_risk") < 0) & (c("rank_return") > 0) & (c("rank_risk") < 0) & (c("balanced_accuracy") > 1 / 3) & (c("leads") > 0) & (no("false_alarms") <= FALSE_ALARMS))
    return al.withColumn("ok3", c("ok1") & (no("worst") > 0) & (no("dispersion") <= DISPERSION))


SHOWN = ["corr_return", "corr_risk", "corr_drawdown", "corr_composite", "rank_return", "rank_risk", "churn", "balanced_accuracy", "macro_f1_percent", "false_alarms", "mean_lead", "dispersion", "worst"]


@query(f"{CYCLE_SQL} SELECT series_id, object, n_obs, leads, {', '.join(f'round({x}, 6) AS {x}' for x in SHOWN)}, ok1 AS layer_1, coalesce(ok2, FALSE) AS layer_2, coalesce(ok3, FALSE) AS layer_3, CASE WHEN ok1 AND ok2 AND ok3 THEN 'PASS' WHEN ok1 THEN 'PARTIAL' ELSE 'FAIL' END AS overall FROM l2")
def cycle_protocol(spark, d):
    """The unified protocol over five objects: direction, states, stability, leads, windows, three layers of gates."""
    m = cycle_metrics(cycle_scores(spark, d))
    overall = F.when(F.col("ok1") & F.col("ok2") & F.col("ok3"), "PASS").when(F.col("ok1"), "PARTIAL").otherwise("FAIL")
    return m.select("series_id", "object", "n_obs", F.col("leads").cast("bigint").alias("leads"), *[r6(F.col(x), x) for x in SHOWN], F.col("ok1").alias("layer_1"), *[F.coalesce(f"ok{k}", F.lit(False)).alias(f"layer_{k}") for k in (2, 3)], overall.alias("overall"))


@query(f"{CYCLE_SQL} SELECT series_id, CASE WHEN bool_or(ok1 AND coalesce(ok2, FALSE) AND coalesce(ok3, FALSE)) THEN 'AUDITABLE' WHEN bool_or(ok1 AND coalesce(ok2, FALSE)) THEN 'LOCAL' ELSE 'NONE' END AS capability FROM l2 WHERE object IN {CURRENT} GROUP BY 1")
def cycle_decision(spark, d):
    """Whether an object of the current system passes all layers, the local ones, or none."""
    m = cycle_metrics(cycle_scores(spark, d)).where(F.col("object").isin(*CURRENT))
    both = F.col("ok1") & F.coalesce("ok2", F.lit(False))
    return m.groupBy("series_id").agg(F.when(F.bool_or(both & F.coalesce("ok3", F.lit(False))), "AUDITABLE").when(F.bool_or(both), "LOCAL").otherwise("NONE").alias("capability"))
