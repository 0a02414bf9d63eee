"""Model fits and walk-forward runs. Closed forms are checked by SQL; iterative fits have tests of their own."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import quantiles as Q
from tidemark.operators import audit as AU
from tidemark.operators import moments as MO
from tidemark.operators import states as ST
from tidemark.operators import windows as W
from tidemark.plans import walkforward as WF
from tidemark.queries.distribution import FORECAST, forecast
from tidemark.queries.series import RETURNS, WEEKLY_RETURNS, by_week, daily_returns, r6, weekly_returns_df
from tidemark.sources import tables as T
from tidemark.sources.scratch import Folder

XY = f"{FORECAST}, p AS (SELECT series_id, week, q4 AS x, y FROM fc)"


def pairs(spark, d) -> DataFrame:
    return forecast(spark, d).select("series_id", "week", F.col("q4").alias("x"), "y")


@query(f"{XY}, m AS (SELECT series_id, avg(x) AS mx, avg(y) AS my, avg(x * y) - avg(x) * avg(y) AS cxy, avg(x * x) - avg(x) * avg(x) AS cxx, count(*) AS n FROM p GROUP BY 1) SELECT series_id, round(cxy / (cxx + 0.01::DOUBLE / n), 6) AS slope, round(my - mx * cxy / (cxx + 0.01::DOUBLE / n), 6) AS intercept FROM m")
def ridge(spark, d):
    """One regressor, penalty 0.01 on the slope only, from moment sums."""
    m = pairs(spark, d).groupBy("series_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("cxx"), F.count("*").alias("n"))
    slope = F.col("cxy") / (F.col("cxx") + F.lit(0.01) / F.col("n"))
    return m.select("series_id", r6(slope, "slope"), r6(F.col("my") - F.col("mx") * slope, "intercept"))


@query(f"{WEEKLY_RETURNS}, l AS (SELECT series_id, week, r, coalesce(lag(r) OVER (PARTITION BY series_id ORDER BY week), 0) AS b FROM r WHERE r IS NOT NULL) SELECT series_id, round(greatest(-1, least(1, sum(r * b) / sum(b * b))), 6) AS c FROM l GROUP BY 1")
def residual_persistence(spark, d):
    """Slope through the origin on the row before (0 for the first), clipped to [-1, 1]."""
    rows = weekly_returns_df(spark, d).where("r is not null").withColumn("b", F.coalesce(F.lag("r").over(by_week()), F.lit(0.0)))
    c = F.try_divide(F.sum(F.col("r") * F.col("b")), F.sum(F.col("b") * F.col("b")))
    return rows.groupBy("series_id").agg(r6(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)), "c"))


@query(
    """WITH e AS (SELECT label, vec_id, unnest(generate_series(1, len(embedding))) AS i, embedding FROM embeddings), v AS (SELECT label, vec_id, i, embedding[i]::DOUBLE AS x, 1.0::DOUBLE + vec_id % 3 AS w FROM e),
m AS (SELECT label, i, sum(w * x) / sum(w) AS m FROM v GROUP BY 1, 2), z AS (SELECT label, vec_id, i, w, x - m AS x FROM v JOIN m USING (label, i)),
c AS (SELECT a.label, a.i, b.i AS j, sum(a.w * a.x * b.x) / sum(a.w) AS c FROM z a JOIN z b ON a.label = b.label AND a.vec_id = b.vec_id GROUP BY 1, 2, 3),
q AS (SELECT a.label, a.vec_id, a.w, sum(a.x * b.x * c.c) AS q FROM z a JOIN z b ON a.label = b.label AND a.vec_id = b.vec_id JOIN c ON c.label = a.label AND c.i = a.i AND c.j = b.i GROUP BY 1, 2, 3),
n AS (SELECT label, vec_id, sum(x * x) AS n FROM z GROUP BY 1, 2), f AS (SELECT label, sum(c * c) AS f, sum(CASE WHEN i <> j THEN c * c ELSE 0 END) AS size FROM c GROUP BY 1),
s AS (SELECT q.label, greatest(0, least(1, sum(w * w * (n * n - 2 * q + f)) / pow(sum(w), 2) / any_value(size))) AS share FROM q JOIN n USING (label, vec_id) JOIN f ON f.label = q.label GROUP BY 1)
SELECT c.label, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(CASE WHEN i = j THEN c ELSE (1 - share) * c END, 5) AS cov FROM c JOIN s USING (label)"""
)
def weighted_covariance(spark, d):
    """Weighted covariance of all dimensions by label, shrunk to its diagonal by the noise in it."""
    e = T.table(spark, d, "embeddings").select("label", (F.lit(1.0) + F.col("vec_id") % 3).alias("w"), F.col("embedding").cast("array<double>").alias("x"))
    first = MO.sums(e.withColumn("centre", F.transform("x", lambda v: F.lit(0.0))).withColumn("x", F.concat(F.array(F.lit(1.0)), "x")).withColumn("centre", F.concat(F.array(F.lit(0.0)), "centre")))
    row = first.where(f"kind = {MO.GRAM} and i = 0").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("row"))
    centre = row.select("label", F.transform(F.slice("row", 2, F.size("row") - 1), lambda r: r["s"] / F.col("row")[0]["s"]).alias("centre"))
    out = MO.covariances(e.join(centre, "label"))
    return out.select("label", "i", "j", F.round("cov", 5).alias("cov"))


MU, SD, STAY = [-0.25, 0.0, 0.25], [0.3, 0.15, 0.3], 0.9
EMIT = [f"exp(-0.5::DOUBLE * ((r - ({m}::DOUBLE)) / {s}::DOUBLE) * ((r - ({m}::DOUBLE)) / {s}::DOUBLE)) / {s}::DOUBLE" for m, s in zip(MU, SD, strict=True)]
MOVE = [f"{EMIT[k].replace('r -', 'n.r -')} * (0.9::DOUBLE * a{k + 1} + 0.05::DOUBLE * (1 - a{k + 1}))" for k in range(3)]


@query(
    f"""{WEEKLY_RETURNS.replace('WITH prices', 'WITH RECURSIVE prices', 1)}, n AS (SELECT series_id, week, r, row_number() OVER (PARTITION BY series_id ORDER BY week) AS i FROM r WHERE r IS NOT NULL),
f AS (SELECT series_id, week, i, b1 / (b1 + b2 + b3) AS a1, b2 / (b1 + b2 + b3) AS a2, b3 / (b1 + b2 + b3) AS a3 FROM (SELECT series_id, week, i, {EMIT[0]} AS b1, {EMIT[1]} AS b2, {EMIT[2]} AS b3 FROM n WHERE i = 1) UNION ALL
SELECT series_id, week, i, b1 / (b1 + b2 + b3), b2 / (b1 + b2 + b3), b3 / (b1 + b2 + b3) FROM (SELECT n.series_id, n.week, n.i, {MOVE[0]} AS b1, {MOVE[1]} AS b2, {MOVE[2]} AS b3 FROM f JOIN n ON n.series_id = f.series_id AND n.i = f.i + 1) x)
SELECT series_id, week, round(a1, 5) AS p1, round(a2, 5) AS p2, round(a3, 5) AS p3 FROM f"""
)
def hmm_filter(spark, d):
    """Filtered probabilities of three fixed states with a constant chance to stay."""
    out = fixed_states(weekly_returns_df(spark, d).where("r is not null"))
    return out.select("series_id", "week", *[F.round(f, 5).alias(f"p{f[1]}") for f in ST.FILTERED])


def fixed_states(rows: DataFrame) -> DataFrame:
    """Posteriors of rows (series_id, week, r) under MU, SD and STAY."""
    log_emit = [-0.5 * ((F.col("r") - m) / s) * ((F.col("r") - m) / s) - F.ln(F.lit(s)) for m, s in zip(MU, SD, strict=True)]
    into = [F.lit(STAY if i == j else (1 - STAY) / 2) for i in range(3) for j in range(3)]
    return ST.posteriors(rows, "series_id", "week", log_emit, into)


@query(f"{RETURNS} SELECT series_id, obs_date, round(r / nullif(lag(r) OVER (PARTITION BY series_id ORDER BY obs_date), 0), 4) AS ratio FROM r WHERE r IS NOT NULL")
def residual_ratio(spark, d):
    rows = daily_returns(spark, d).where("r is not null")
    return rows.select("series_id", "obs_date", F.round(F.try_divide(F.col("r"), F.lag("r").over(Window.partitionBy("series_id").orderBy("obs_date"))), 4).alias("ratio"))


@query()
def pca_2d(spark, d):
    """Two shrunk components of each label's embeddings."""
    rows = T.table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = MO.components(rows, Folder(spark, "components"))
    return out.select("label", "vec_id", r6(F.col("pc1"), "pc1"), r6(F.col("pc2"), "pc2"))


@query()
def hmm_fit(spark, d):
    """Each start of each series is one task; the best likelihood wins, the first of equals."""
    return WF.best_hmm(weekly_returns_df(spark, d), restarts=50, iterations=200)


@query()
def quantile_regression(spark, d):
    """Joint non-crossing fit of each series: coefficients by level."""
    return WF.quantile_fits(pairs(spark, d))


@query()
def panel_quantile_regression(spark, d):
    return WF.panel_fit(pairs(spark, d))


@query()
def panel_spread_regression(spark, d):
    """The pooled spread law of the panel on the forecast median and its size."""
    return WF.spread_fit(pairs(spark, d))


@query()
def student_t_law(spark, d):
    return WF.student_fits(pairs(spark, d))


@query()
def har_sigma(spark, d):
    return WF.har_fits(daily_returns(spark, d))


@query()
def garch_family(spark, d):
    """Exponential and threshold models, normal and t laws, of weekly returns: one task each."""
    return WF.garch_fits(weekly_returns_df(spark, d).where("r is not null"))


@query()
def mle_tail(spark, d):
    return WF.tail_fits(weekly_returns_df(spark, d).where("r is not null"))


@query(
    f"""{XY}, n AS (SELECT series_id, week, y, row_number() OVER (PARTITION BY series_id ORDER BY x, week) AS i FROM p), c AS (SELECT *, sum(y) OVER (PARTITION BY series_id ORDER BY i) AS s FROM n),
m AS (SELECT a.series_id, b.i, min((b.s - a.s + a.y) / (b.i - a.i + 1)) OVER (PARTITION BY a.series_id, a.i ORDER BY b.i DESC) AS m FROM c a JOIN c b ON a.series_id = b.series_id AND b.i >= a.i)
SELECT series_id, week, round(max(m), 6) AS fitted FROM m JOIN n USING (series_id, i) GROUP BY 1, 2"""
)
def isotonic_recalibration(spark, d):
    return WF.isotonic_fits(pairs(spark, d))


@query()
def walkforward(spark, d):
    """Every week: fit on rows at least 14 weeks older, predict the week."""
    out = WF.run(pairs(spark, d), embargo=14, min_train=60)
    return out.where("status in ('ok', 'inaccurate')").select("series_id", "as_of", "n_train", *WF.NAMES)


POLICY_START = "1996-06-28"
COUNTED = f"""{XY}, t AS (SELECT a.series_id, a.week, count(b.week) AS n FROM p a LEFT JOIN p b ON b.series_id = a.series_id AND b.week <= a.week - 98 GROUP BY 1, 2),
e AS (SELECT *, min(CASE WHEN n >= 60 THEN week END) OVER (PARTITION BY series_id) AS effective_start FROM t), r AS (SELECT *, week < effective_start AS early FROM e WHERE week >= DATE '{POLICY_START}')"""


@query(
    f"""{COUNTED} SELECT series_id, effective_start, 'allow' AS policy, count(*) AS n_weeks, count(*) FILTER (early) AS n_failed, 0::BIGINT AS n_clipped FROM r GROUP BY 1, 2
UNION ALL SELECT series_id, effective_start, 'clip_diagnostic', count(*) FILTER (NOT early), 0, count(*) FILTER (early) FROM r GROUP BY 1, 2"""
)
def walkforward_policies(spark, d):
    """A run from mid-1996, before there are 60 training rows, under the policies that give rows."""
    outcomes = Folder(spark, "outcomes").cut(WF.run(pairs(spark, d), embargo=14, min_train=60))
    parts = []
    for policy in ("allow", "clip_diagnostic"):
        rows = WF.under_policy(outcomes, F.lit(POLICY_START).cast("date"), 60, policy)
        failed = F.count_if(F.col("status") == "insufficient_history").alias("n_failed")
        parts.append(rows.groupBy("series_id", "effective_start").agg(F.count("*").alias("n_weeks"), failed, F.max("n_clipped").alias("n_clipped")).withColumn("policy", F.lit(policy)))
    return parts[0].unionByName(parts[1]).select("series_id", "effective_start", "policy", "n_weeks", "n_failed", "n_clipped")


@query()
def challenger_run(spark, d):
    """Refit each 13 weeks with the parameters before as the start, so each series is one sequential task; every week is predicted."""
    return WF.challenger(pairs(spark, d), every=13, min_train=52, embargo=14)


@query()
def hypotheses(spark, d):
    """Four direct laws of the 13-week return on trend and volatility, fitted anew each week: mean score, coverage of the outer
    levels, and how scale goes with the size of the miss, by series."""
    x = weekly_returns_df(spark, d).select("series_id", "week", W.log_return("value", by_week(), 26).alias("trend"), F.col("r"), F.when(F.count("r").over(by_week().rowsBetween(-12, 0)) == 13, F.stddev_pop("r").over(by_week().rowsBetween(-12, 0))).alias("vol"))
    rows = forecast(spark, d).select("series_id", "week", "y").join(x.dropna("any"), ["series_id", "week"])
    out = WF.hypotheses(rows, ["trend", "r", "vol"], embargo=14, min_train=120)
    hit = lambda q: F.avg((F.col("y") <= F.col(q)).cast("double"))
    return out.groupBy("series_id", "hypothesis").agg(F.count("*").alias("n"), F.round(F.avg(Q.pinball("y", WF.NAMES, Q.CORE)), 5).alias("crps"), r6(hit("q10"), "coverage_q10"), r6(hit("q90"), "coverage_q90"), F.round(F.corr("sigma", F.abs(F.col("y") - F.col("mu"))), 5).alias("scale_corr"))


@query(
    f"""{WEEKLY_RETURNS}, bad AS (SELECT series_id, 1 AS stage, week FROM r WHERE value IS NULL UNION ALL SELECT series_id, 2, week FROM r WHERE r IS NULL UNION ALL SELECT series_id, 3, week FROM r WHERE r IS NULL OR r = 0)
SELECT series_id, CAST(stage AS INT) AS stage, week FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY stage, week) AS i FROM bad) x WHERE i = 1"""
)
def nonfinite_audit(spark, d):
    """First stage and week at which a value of the volatility pipeline isn't finite, by series."""
    r = weekly_returns_df(spark, d)
    stages = F.array(F.struct(F.lit(1).alias("stage"), F.col("value").alias("v")), F.struct(F.lit(2).alias("stage"), F.col("r").alias("v")), F.struct(F.lit(3).alias("stage"), F.when(F.col("r") != 0, F.ln(F.abs("r"))).alias("v")))
    bad = r.select("series_id", "week", F.explode(stages).alias("s")).where("s.v is null or isnan(s.v)")
    return bad.groupBy("series_id").agg(F.min(F.struct("s.stage", "week")).alias("first")).select("series_id", "first.stage", "first.week")


SIGMA_STAGES = ["value", "r", "rv", "m", "log_sigma", "corrected", "z"]


@query(
    f"""{RETURNS}, h AS (SELECT *, row_number() OVER o AS i, CASE WHEN count(r) OVER f = 5 THEN sqrt(avg(r * r) OVER f) END AS rv5, CASE WHEN count(r) OVER t = 22 THEN sqrt(avg(r * r) OVER t) END AS rv, lead(r) OVER o AS next FROM r WINDOW o AS (PARTITION BY series_id ORDER BY obs_date), f AS (PARTITION BY series_id ORDER BY obs_date ROWS 4 PRECEDING), t AS (PARTITION BY series_id ORDER BY obs_date ROWS 21 PRECEDING)),
l AS (SELECT *, CASE WHEN r <> 0 AND rv5 > 0 AND rv > 0 THEN (ln(abs(r)) + ln(rv5) + ln(rv)) / 3 END AS m, CASE WHEN next <> 0 THEN ln(abs(next)) END AS y FROM h WHERE next IS NOT NULL),
f AS (SELECT series_id, regr_slope(y, m) AS b, regr_intercept(y, m) AS a FROM l GROUP BY 1), p AS (SELECT l.*, a + b * m AS log_sigma, y - (a + b * m) AS e FROM l JOIN f USING (series_id)),
g AS (SELECT *, lag(e) OVER o AS pe, row_number() OVER o AS k FROM p WINDOW o AS (PARTITION BY series_id ORDER BY obs_date)), c AS (SELECT series_id, greatest(-1, least(1, sum(e * pe) / sum(pe * pe))) AS c FROM g WHERE e IS NOT NULL AND pe IS NOT NULL GROUP BY 1),
t AS (SELECT series_id, obs_date, value, r, rv, m, log_sigma, log_sigma + c * (CASE WHEN k = 1 THEN 0 ELSE pe END) AS corrected, next FROM g JOIN c USING (series_id)),
s AS (SELECT *, CASE WHEN value IS NULL THEN 1 WHEN r IS NULL THEN 2 WHEN rv IS NULL THEN 3 WHEN m IS NULL THEN 4 WHEN log_sigma IS NULL THEN 5 WHEN corrected IS NULL THEN 6 END AS stage FROM t),
w AS (SELECT count(*) AS n_all, count(*) FILTER (corrected IS NULL) AS n_bad_sigma FROM t)
SELECT series_id, CAST(stage AS INT) AS stage, min(obs_date) AS obs_date, count(*) AS n_rows, any_value(n_bad_sigma) AS n_bad_sigma, any_value(n_all) AS n_all FROM s, w GROUP BY 1, 2"""
)
def sigma_chain_audit(spark, d):
    """The chain from prices to standardised residuals (returns, realised volatility, mean log, fitted log sigma, correction by
    the residual before): the rows of each series by the stage at which they first break (none: null) and the first such day,
    with the counts that the same pass observed."""
    w = Window.partitionBy("series_id").orderBy("obs_date")
    h = daily_returns(spark, d).select("series_id", "obs_date", "value", "r", W.rms("r", w, 5).alias("rv5"), W.rms("r", w, 22).alias("rv"), F.lead("r").over(w).alias("next"))
    logs = F.when((F.col("r") != 0) & (F.col("rv5") > 0) & (F.col("rv") > 0), (F.ln(F.abs("r")) + F.ln("rv5") + F.ln("rv")) / 3)
    rows = h.where("next is not null").withColumn("m", logs).withColumn("y", F.when(F.col("next") != 0, F.ln(F.abs("next"))))
    fit = rows.groupBy("series_id").agg(F.regr_slope("y", "m").alias("b"), F.regr_intercept("y", "m").alias("a"))
    rows = rows.join(fit, "series_id").withColumn("log_sigma", F.col("a") + F.col("b") * F.col("m")).withColumn("e", F.col("y") - F.col("log_sigma"))
    rows = rows.withColumn("pe", F.lag("e").over(w)).withColumn("k", F.row_number().over(w))
    both = rows.where("e is not null and pe is not null").groupBy("series_id").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col("e") * F.col("pe")) / F.sum(F.col("pe") * F.col("pe")))).alias("c"))
    rows = rows.join(both, "series_id").withColumn("corrected", F.col("log_sigma") + F.col("c") * F.when(F.col("k") == 1, 0.0).otherwise(F.col("pe")))
    marked, seen = AU.observed(rows.withColumn("z", F.col("next") / F.exp("corrected")).select("series_id", "obs_date", *SIGMA_STAGES), SIGMA_STAGES)
    kept = Folder(spark, "sigma-chain").cut(marked)
    counts = seen.get
    out = AU.breaks(kept, ["series_id"], "obs_date")
    return out.withColumns({"n_bad_sigma": F.lit(counts["corrected"]).cast("bigint"), "n_all": F.lit(counts["rows"]).cast("bigint")})


@query()
def weekly_output(spark, d):
    """The nested weekly record of each series and week."""
    from tidemark.plans import inference
    from tidemark.queries.distribution import KNOTS, SCORES, missing_guard

    return inference.records(forecast(spark, d), missing_guard(spark, d), KNOTS, SCORES)
