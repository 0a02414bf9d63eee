"""Distribution arithmetic: baseline quantiles, scores, tails, moments, decisions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import quantiles as Q
from tidemark.functions import scalar as S
from tidemark.operators import alignment as A
from tidemark.operators import windows as W
from tidemark.queries.series import FEATURES_SQL, ID, WEEKLY, by_week, features, r6, weekly_prices

QS = [f"q{k}" for k in range(1, 8)]
LEVELS = "[" + ", ".join(f"{t}::DOUBLE" for t in Q.TAUS) + "]"
FORECAST = (
    f"""{WEEKLY}, f AS (SELECT a.series_id, a.week, ln(b.value) - ln(a.value) AS y FROM weekly a JOIN weekly b ON a.series_id = b.series_id AND b.week = a.week + 91),
g AS (SELECT *, quantile_cont(y, {LEVELS}) OVER w AS q, count(y) OVER w AS n FROM f WINDOW w AS (PARTITION BY series_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fc AS (SELECT series_id, week, y, """
    + ", ".join(f"q[{k}] AS q{k}" for k in range(1, 8))
    + " FROM g WHERE n >= 26)"
)


def forecast(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, week, y, q1..q7): the 13-week forward return and the quantiles of all earlier rows' outcomes."""
    rows = weekly_prices(spark, d).withColumn("y", A.forward_log_return("value", 13, ID)).where("y is not null").select("series_id", "week", "y")
    w = by_week().rowsBetween(W.UP, -1)
    out = rows.withColumn("q", W.earlier_quantiles("y", Q.TAUS, ID)).withColumn("n", F.count("y").over(w)).where("n >= 26")
    return out.select("series_id", "week", "y", *[F.get("q", F.lit(k)).alias(f"q{k + 1}") for k in range(7)])


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({x}, 6) AS {x}" for x in names)


@query(f"{FORECAST} SELECT series_id, week, {rounded(['y', *QS])} FROM fc")
def baseline_quantiles(spark, d):
    return forecast(spark, d).select("series_id", "week", *[r6(F.col(x), x) for x in ["y", *QS]])


PINBALL = "2 * (" + " + ".join(f"greatest({t}::DOUBLE * (y - {x}), ({t}::DOUBLE - 1) * (y - {x}))" for t, x in zip(Q.TAUS, QS, strict=True)) + ") / 7"


@query(f"{FORECAST} SELECT series_id, round(avg({PINBALL}), 6) AS crps, count(*) AS n FROM fc GROUP BY 1")
def pinball_score(spark, d):
    return forecast(spark, d).groupBy("series_id").agg(r6(F.avg(Q.pinball("y", QS)), "crps"), F.count("*").alias("n"))


@query(f"{FORECAST} SELECT series_id, week, round(q2 - 0.6 * (q3 - q2), 6) AS q05, round(q6 + 0.6 * (q6 - q5), 6) AS q95, CASE WHEN q2 - 0.6 * (q3 - q2) <= q2 AND q2 <= q3 AND q3 <= q4 AND q4 <= q5 AND q5 <= q6 AND q6 <= q6 + 0.6 * (q6 - q5) THEN 'ok' ELSE 'fallback' END AS status FROM fc")
def tail_extrapolate(spark, d):
    low, high = Q.extrapolated("q2", "q3", "q5", "q6")
    status = F.when(Q.is_monotone([low, *QS[1:6], high]), "ok").otherwise("fallback")
    return forecast(spark, d).select("series_id", "week", r6(low, "q05"), r6(high, "q95"), status.alias("status"))


SEGMENTS = list(zip(Q.TAUS, Q.TAUS[1:], QS, QS[1:], strict=False))
MEAN = "((" + " + ".join(f"({b}::DOUBLE - {a}::DOUBLE) * ({x} + {y}) / 2" for a, b, x, y in SEGMENTS) + ") / 0.9::DOUBLE)"
SECOND = "((" + " + ".join(f"({b}::DOUBLE - {a}::DOUBLE) * ({x} * {x} + {x} * {y} + {y} * {y}) / 3" for a, b, x, y in SEGMENTS) + ") / 0.9::DOUBLE)"
P_LOSS = "CASE WHEN q1 >= 0 THEN 0 WHEN q7 < 0 THEN 1 " + " ".join(f"WHEN {x} <= 0 AND {y} >= 0 THEN CASE WHEN {y} > {x} THEN {a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) * (-{x}) / ({y} - {x}) ELSE {a} END" for a, b, x, y in SEGMENTS) + " END"
ES20 = "(-(0.05::DOUBLE * (q1 + q2) / 2 + 0.10::DOUBLE * (q2 + q2 + (q3 - q2) * (0.10::DOUBLE / 0.15::DOUBLE)) / 2) / 0.15::DOUBLE)"


@query(f"{FORECAST} SELECT series_id, week, round({MEAN}, 6) AS mu, round(sqrt(greatest(0, {SECOND} - {MEAN} * {MEAN})), 6) AS sigma FROM fc")
def quantile_moments(spark, d):
    return forecast(spark, d).select("series_id", "week", r6(Q.mean(QS), "mu"), r6(Q.deviation(QS), "sigma"))


@query(f"{FORECAST} SELECT series_id, week, round({P_LOSS}, 6) AS p_loss FROM fc")
def p_loss(spark, d):
    return forecast(spark, d).select("series_id", "week", r6(Q.loss_probability(QS), "p_loss"))


@query(f"{FORECAST} SELECT series_id, week, round({ES20}, 6) AS es20 FROM fc")
def es20(spark, d):
    return forecast(spark, d).select("series_id", "week", r6(Q.shortfall(QS), "es20"))


@query(f"{FORECAST} SELECT series_id, week, (q1 < q2 AND q2 < q3 AND q3 < q4 AND q4 < q5 AND q5 < q6 AND q6 < q7) AS non_crossing, isfinite(q1 + q2 + q3 + q4 + q5 + q6 + q7) AS all_finite FROM fc")
def quantile_checks(spark, d):
    q = F.array(*QS)
    apart = F.forall(F.zip_with(F.slice(q, 1, 6), F.slice(q, 2, 6), lambda a, b: a < b), lambda x: x)
    return forecast(spark, d).select("series_id", "week", apart.alias("non_crossing"), S.finite(Q.total([F.col(x) for x in QS])).isNotNull().alias("all_finite"))


@query(
    f"""{FORECAST}, a AS (SELECT series_id, week, list_sort([q3, q1, q5, q2, q4]) AS s FROM fc),
b AS (SELECT *, s[1] AS r1, greatest(s[2], s[1] + 0.02) AS r2 FROM a), c AS (SELECT *, greatest(s[3], r2 + 0.02) AS r3 FROM b), e AS (SELECT *, greatest(s[4], r3 + 0.02) AS r4 FROM c)
SELECT series_id, week, round(r1, 6) AS r1, round(r2, 6) AS r2, round(r3, 6) AS r3, round(r4, 6) AS r4, round(greatest(s[5], r4 + 0.02), 6) AS r5 FROM e"""
)
def rearranged_quantiles(spark, d):
    fixed = Q.rearranged(F.array("q3", "q1", "q5", "q2", "q4"), 0.02)
    return forecast(spark, d).withColumn("r", fixed).select("series_id", "week", *[r6(F.get("r", F.lit(k)), f"r{k + 1}") for k in range(5)])


@query(f"{FORECAST} SELECT series_id, week, round(q3, 6) AS m1, round(greatest(q3, q1), 6) AS m2, round(greatest(q3, q1, q5), 6) AS m3, round(greatest(q3, q1, q5, q2), 6) AS m4 FROM fc")
def monotone_quantiles(spark, d):
    fixed = Q.running_max(F.array("q3", "q1", "q5", "q2"))
    return forecast(spark, d).withColumn("r", fixed).select("series_id", "week", *[r6(F.get("r", F.lit(k)), f"m{k + 1}") for k in range(4)])


GRID = [k / 200 for k in range(1, 200)]
NORMAL = [round(NormalDist().inv_cdf(t), 9) for t in GRID]


@query(
    f"""{FORECAST}, grid AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in GRID)}]) AS tau, unnest([{', '.join(f'{z}::DOUBLE' for z in NORMAL)}]) AS z),
m AS (SELECT series_id, week, y, {MEAN} AS mu, sqrt({SECOND} - {MEAN} * {MEAN}) AS sigma FROM fc)
SELECT series_id, week, round(2 * sum(greatest(tau * (y - mu - sigma * z), (tau - 1) * (y - mu - sigma * z)) * CASE WHEN tau < 0.0051 OR tau > 0.9949 THEN 0.0025::DOUBLE ELSE 0.005::DOUBLE END), 6) AS crps FROM m CROSS JOIN grid GROUP BY 1, 2"""
)
def integrated_crps(spark, d):
    """Trapezoid over a fixed grid of levels, a normal law with the curve's moments; unrolled as an array expression."""
    weights = [0.0025 if k in (0, len(GRID) - 1) else 0.005 for k in range(len(GRID))]
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(z).alias("z"), F.lit(w).alias("w")) for t, z, w in zip(GRID, NORMAL, weights, strict=True)])
    m = forecast(spark, d).select("series_id", "week", "y", Q.mean(QS).alias("mu"), Q.deviation(QS).alias("sigma"))

    def step(acc, g):
        e = F.col("y") - F.col("mu") - F.col("sigma") * g["z"]
        return acc + F.greatest(g["t"] * e, (g["t"] - 1) * e) * g["w"]

    return m.select("series_id", "week", r6(2 * F.aggregate(table, F.lit(0.0), step), "crps"))


@query(f"{FORECAST} SELECT series_id, round(avg(CASE WHEN y <= q2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS q10, round(avg(CASE WHEN y <= q6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS q90, round(avg(CASE WHEN y BETWEEN q2 AND q6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS inside FROM fc GROUP BY 1")
def coverage(spark, d):
    share = lambda x: F.avg(x.cast("double"))
    return forecast(spark, d).groupBy("series_id").agg(r6(share(F.col("y") <= F.col("q2")), "q10"), r6(share(F.col("y") <= F.col("q6")), "q90"), r6(share(F.col("y").between(F.col("q2"), F.col("q6"))), "inside"))


@query(f"{FORECAST} SELECT series_id, week, round(avg(CASE WHEN y <= q2 THEN 1.0::DOUBLE ELSE 0 END) OVER w, 6) AS q10, round(avg(CASE WHEN y <= q6 THEN 1.0::DOUBLE ELSE 0 END) OVER w, 6) AS q90 FROM fc WINDOW w AS (PARTITION BY series_id ORDER BY week ROWS 103 PRECEDING)")
def trailing_coverage(spark, d):
    w = by_week().rowsBetween(-103, 0)
    return forecast(spark, d).select("series_id", "week", *[r6(F.avg((F.col("y") <= F.col(x)).cast("double")).over(w), n) for x, n in (("q2", "q10"), ("q6", "q90"))])


@query(f"{FORECAST}, s AS (SELECT series_id, {PINBALL} AS p, abs(y) AS b FROM fc) SELECT series_id, round(1 - avg(p) / avg(b), 6) AS improvement, round(avg(p) / stddev_samp(p), 6) AS normalised FROM s WHERE b > 0 GROUP BY 1")
def crps_improvement(spark, d):
    s = forecast(spark, d).select("series_id", Q.pinball("y", QS).alias("p"), F.abs("y").alias("b")).where("b > 0")
    return s.groupBy("series_id").agg(r6(1 - F.try_divide(F.avg("p"), F.avg("b")), "improvement"), r6(F.try_divide(F.avg("p"), F.stddev_samp("p")), "normalised"))


@query(f"{FORECAST}, i AS (SELECT f.series_id, f.week, arg_max_null(f.y, f.week) AS y, sum(CASE WHEN f.y > v.y THEN 1 ELSE 0 END) AS lower FROM fc f JOIN fc v ON f.series_id = v.series_id GROUP BY 1, 2), n AS (SELECT series_id, count(*) AS n FROM fc GROUP BY 1) SELECT series_id, week, round(lower / (n - 1)::DOUBLE, 6) AS rank FROM i JOIN n USING (series_id)")
def percentile_rank_interp(spark, d):
    """Ranks of values among the sorted values of their own series (here all distinct)."""
    values = forecast(spark, d)
    table = values.groupBy("series_id").agg(F.array_sort(F.collect_list("y")).alias("v"))
    return values.join(table, "series_id").select("series_id", "week", r6(Q.interpolated_rank("y", F.col("v")), "rank"))


def interpolated_sql(x: str, v: str) -> str:
    below = f"len(list_filter({v}, lambda el: el <= {x}))"
    return f"CASE WHEN {x} IS NULL THEN 0.5 WHEN {x} <= {v}[1] THEN 0 WHEN {x} >= {v}[-1] THEN 1 ELSE ({below} - 1 + ({x} - {v}[{below}]) / ({v}[{below} + 1] - {v}[{below}])) / (len({v}) - 1)::DOUBLE END"


@query(
    f"""{FORECAST}, m AS (SELECT series_id, week, {MEAN} AS a, -({ES20}) AS b, -({P_LOSS}) AS c FROM fc), t AS (SELECT series_id, list_sort(list(a) FILTER (week < DATE '1999-01-01')) AS va, list_sort(list(b) FILTER (week < DATE '1999-01-01')) AS vb, list_sort(list(c) FILTER (week < DATE '1999-01-01')) AS vc FROM m GROUP BY 1)
SELECT series_id, week, round(100 * ({interpolated_sql('a', 'va')} + {interpolated_sql('b', 'vb')} + {interpolated_sql('c', 'vc')}) / 3, 4) AS cycle_position FROM m JOIN t USING (series_id) WHERE week >= DATE '1999-01-01'"""
)
def cycle_position(spark, d):
    m = forecast(spark, d).select("series_id", "week", Q.mean(QS).alias("a"), (-Q.shortfall(QS)).alias("b"), (-Q.loss_probability(QS)).alias("c"))
    past = F.col("week") < "1999-01-01"
    table = m.groupBy("series_id").agg(*[F.array_sort(F.collect_list(F.when(past, F.col(x)))).alias(f"v{x}") for x in "abc"])
    rank = Q.total([Q.interpolated_rank(x, F.col(f"v{x}")) for x in "abc"])
    return m.join(table, "series_id").where("week >= date'1999-01-01'").select("series_id", "week", F.round(100 * rank / 3, 4).alias("cycle_position"))


KNOTS, SCORES = [-0.3, -0.1, -0.02, 0.05, 0.12, 0.3], [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]
UTILITY = f"({MEAN} - 1.2::DOUBLE * {ES20} - 0.8::DOUBLE * {P_LOSS})"


def piecewise_sql(x: str, knots: list[float], levels: list[float]) -> str:
    parts = [f"WHEN {x} <= {b}::DOUBLE THEN {p}::DOUBLE + ({x} - ({a}::DOUBLE)) * (({q}::DOUBLE - {p}::DOUBLE) / ({b}::DOUBLE - ({a}::DOUBLE)))" for a, b, p, q in zip(knots, knots[1:], levels, levels[1:], strict=False)]
    return f"CASE WHEN {x} <= {knots[0]}::DOUBLE THEN {levels[0]}::DOUBLE {' '.join(parts)} WHEN {x} IS NOT NULL THEN {levels[-1]}::DOUBLE END"


@query(f"{FORECAST} SELECT series_id, week, round({UTILITY}, 6) AS utility FROM fc")
def utility_score(spark, d):
    return forecast(spark, d).select("series_id", "week", r6(S.utility(Q.mean(QS), Q.shortfall(QS), Q.loss_probability(QS)), "utility"))


RAW = f"{FORECAST}, u AS (SELECT series_id, week, {UTILITY} + 0.5 AS u FROM fc), s AS (SELECT series_id, week, {piecewise_sql('u', KNOTS, SCORES)} AS raw FROM u)"


def raw_scores(spark, d):
    u = forecast(spark, d).select("series_id", "week", (S.utility(Q.mean(QS), Q.shortfall(QS), Q.loss_probability(QS)) + 0.5).alias("u"))
    return u.select("series_id", "week", S.piecewise("u", KNOTS, SCORES).alias("raw"))


@query(f"{RAW} SELECT series_id, week, round(raw, 4) AS offense, CASE WHEN raw <= 35 THEN 'DEFENSIVE' WHEN raw >= 65 THEN 'OFFENSIVE' ELSE 'NEUTRAL' END AS stance FROM s")
def offense_map(spark, d):
    return raw_scores(spark, d).select("series_id", "week", F.round("raw", 4).alias("offense"), S.stance("raw").alias("stance"))


@query(
    RAW.replace("WITH prices", "WITH RECURSIVE prices", 1)
    + """, n AS (SELECT series_id, week, round(raw, 6) AS raw, row_number() OVER (PARTITION BY series_id ORDER BY week) AS i FROM s),
h AS (SELECT series_id, week, raw, i, CASE WHEN abs(raw - 50) < 7 THEN 50::DOUBLE ELSE raw END AS final FROM n WHERE i = 1 UNION ALL
SELECT n.series_id, n.week, n.raw, n.i, CASE WHEN abs(n.raw - h.final) < 7 THEN h.final ELSE n.raw END FROM h JOIN n ON n.series_id = h.series_id AND n.i = h.i + 1)
SELECT series_id, week, round(final, 4) AS final FROM h"""
)
def hysteresis(spark, d):
    raw = raw_scores(spark, d).withColumn("raw", F.round("raw", 6))
    return W.hysteresis(raw, "raw", ID, "week").select("series_id", "week", F.round("final", 4).alias("final"))


@query(
    f"""{FEATURES_SQL}, c AS (SELECT week, (CASE WHEN x1 IS NULL THEN 1 ELSE 0 END + CASE WHEN x2 IS NULL THEN 1 ELSE 0 END + CASE WHEN x3 IS NULL THEN 1 ELSE 0 END + CASE WHEN x4 IS NULL THEN 1 ELSE 0 END + CASE WHEN x5 IS NULL THEN 1 ELSE 0 END) / 5.0::DOUBLE AS rate,
CASE WHEN x1 IS NULL AND x2 IS NULL THEN 1 ELSE 0 END + CASE WHEN x3 IS NULL AND x4 IS NULL THEN 1 ELSE 0 END AS blocks FROM f)
SELECT week, round(rate, 6) AS missing_rate, CAST(blocks AS BIGINT) AS missing_blocks, CASE WHEN rate > 0.2::DOUBLE OR blocks >= 2 THEN 'BLOCKED' WHEN rate >= 0.1::DOUBLE OR blocks >= 1 THEN 'DEGRADED' ELSE 'NORMAL' END AS mode FROM c"""
)
def missing_guard(spark, d):
    gone = lambda k: F.col(f"x{k}").isNull()
    rate = Q.total([gone(k).cast("int") for k in range(1, 6)]) / F.lit(5.0)
    blocks = (gone(1) & gone(2)).cast("int") + (gone(3) & gone(4)).cast("int")
    rows = features(spark, d).select("week", rate.alias("rate"), blocks.cast("bigint").alias("missing_blocks"))
    return rows.select("week", r6(F.col("rate"), "missing_rate"), "missing_blocks", S.guard_mode("rate", "missing_blocks").alias("mode"))


@query(
    f"""{FORECAST}, u AS (SELECT series_id, {UTILITY} AS u FROM fc), m AS (SELECT series_id, median(u) AS med, quantile_cont(u, [0.0::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE, 1.0::DOUBLE]) AS q, greatest(mad(u), 1e-8) AS mad FROM u GROUP BY 1)
SELECT series_id, round(med, 6) AS med, round(mad, 6) AS mad, round(q[1] - 3 * mad, 6) AS t1, round(q[2], 6) AS t2, round(q[3], 6) AS t3, round(q[4], 6) AS t4, round(q[5], 6) AS t5, round(q[6] + 3 * mad, 6) AS t6 FROM m"""
)
def score_thresholds(spark, d):
    """Median, MAD, and six score thresholds: quintile bounds with the ends moved out by three MADs, strictly increasing."""
    u = forecast(spark, d).select("series_id", S.utility(Q.mean(QS), Q.shortfall(QS), Q.loss_probability(QS)).alias("u"))
    first = u.groupBy("series_id").agg(F.percentile("u", F.lit(0.5)).alias("med"), F.percentile("u", F.array(*[F.lit(k / 5) for k in range(6)])).alias("q"))
    mad = u.join(first.select("series_id", "med"), "series_id").groupBy("series_id").agg(F.greatest(F.percentile(F.abs(F.col("u") - F.col("med")), F.lit(0.5)), F.lit(1e-8)).alias("mad"))
    q = lambda k: F.get("q", F.lit(k))
    ends = F.array(q(0) - 3 * F.col("mad"), *[q(k) for k in range(1, 5)], q(5) + 3 * F.col("mad"))
    rows = first.join(mad, "series_id").withColumn("t", Q.rearranged(ends, 1e-8))
    return rows.select("series_id", r6(F.col("med"), "med"), r6(F.col("mad"), "mad"), *[r6(F.get("t", F.lit(k)), f"t{k + 1}") for k in range(6)])


@query(f"{FORECAST} SELECT series_id, week, round(1 / (1 + exp(-greatest(-50, least(50, 8 * y)))), 6) AS p, round(0.1::DOUBLE + 0.5::DOUBLE * q4 - 0.2::DOUBLE * q2, 6) AS linear FROM fc")
def predictors(spark, d):
    return forecast(spark, d).select("series_id", "week", r6(S.logistic(8 * F.col("y")), "p"), r6(S.linear(F.lit(0.1), (F.lit(0.5), "q4"), (F.lit(-0.2), "q2")), "linear"))


@query(f"{FORECAST} SELECT series_id, week, round(CASE WHEN q4 <= 0 THEN 0.01::DOUBLE + q4 * (0.06::DOUBLE / 0.1::DOUBLE) ELSE 0.01::DOUBLE + q4 * (0.15::DOUBLE / 0.1::DOUBLE) END, 6) AS mapped FROM fc")
def quantile_remap(spark, d):
    return forecast(spark, d).select("series_id", "week", r6(Q.remapped("q4", [-0.1, 0.0, 0.1], [-0.05, 0.01, 0.16]), "mapped"))


@query(
    f"""{FORECAST}, e AS (SELECT *, (y - q4) / (q6 - q2) AS z FROM fc), r AS (SELECT *, count(z) OVER w AS n, avg(z) OVER w AS shift, stddev_pop(z) OVER w AS scale FROM e WINDOW w AS (PARTITION BY series_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, week, round(q4 + shift * (q6 - q2), 6) AS centre, round(scale * (q6 - q2), 6) AS spread FROM r WHERE n >= 26"""
)
def expanding_recalibration(spark, d):
    w = by_week().rowsBetween(W.UP, -1)
    width = F.col("q6") - F.col("q2")
    e = forecast(spark, d).withColumn("z", (F.col("y") - F.col("q4")) / width)
    r = e.withColumn("n", F.count("z").over(w)).withColumn("shift", F.avg("z").over(w)).withColumn("scale", F.stddev_pop("z").over(w)).where("n >= 26")
    return r.select("series_id", "week", r6(F.col("q4") + F.col("shift") * width, "centre"), r6(F.col("scale") * width, "spread"))


@query(
    f"""{FORECAST}, s AS (SELECT series_id, week, ln(q6 - q2) AS ls, q6 - q2 AS sd FROM fc), t AS (SELECT series_id, quantile_cont(ls, 0.1::DOUBLE) AS p10, quantile_cont(ls, 0.99::DOUBLE) AS p99, median(sd) AS med FROM s GROUP BY 1)
SELECT series_id, week, round(least(exp(greatest(p10 - 0.35::DOUBLE, least(p99, ls))), 3 * med), 6) AS sigma FROM s JOIN t USING (series_id)"""
)
def sigma_clip(spark, d):
    s = forecast(spark, d).select("series_id", "week", F.ln(F.col("q6") - F.col("q2")).alias("ls"), (F.col("q6") - F.col("q2")).alias("sd"))
    t = s.groupBy("series_id").agg(F.percentile("ls", F.lit(0.1)).alias("p10"), F.percentile("ls", F.lit(0.99)).alias("p99"), F.percentile("sd", F.lit(0.5)).alias("med"))
    return s.join(t, "series_id").select("series_id", "week", r6(S.sigma_clip("ls", "p10", "p99", "med"), "sigma"))
