"""Weekly records: distribution, decision and diagnostics of each as_of as one nested row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import quantiles as Q
from tidemark.functions import scalar as S

NAMES = ["q05", "q10", "q25", "q50", "q75", "q90", "q95"]
VERSION = "1"


def decision(mean: Column, es20: Column, p_loss: Column, mode: Column, knots: list[float], levels: list[float]) -> Column:
    """Blocked and degraded weeks get the neutral score."""
    utility = S.utility(mean, es20, p_loss)
    raw = S.piecewise(utility, knots, levels)
    final = F.when(mode == "NORMAL", raw).otherwise(F.lit(50.0))
    return F.struct(mean.alias("excess_return"), utility.alias("utility"), raw.alias("offense_raw"), final.alias("offense_final"), S.stance(final).alias("stance"))


def records(forecasts: DataFrame, guards: DataFrame, knots: list[float], levels: list[float]) -> DataFrame:
    """forecasts (series_id, week, q1..q7) and guards (week, missing_rate, missing_blocks, mode) -> nested records. A week
    without guards counts as blocked; tails come from the inner quantiles, and a crossing curve is sorted and marked."""
    inner = [F.col(f"q{k}") for k in range(2, 7)]
    low, high = Q.extrapolated("q2", "q3", "q5", "q6")
    curve = F.array(low, *inner, high)
    rows = forecasts.join(guards, "week", "left").withColumn("mode", F.coalesce("mode", F.lit("BLOCKED")))
    rows = rows.withColumn("ok", Q.is_monotone([low, *inner, high])).withColumn("curve", F.when(F.col("ok"), curve).otherwise(F.array_sort(curve)))
    q = [F.get("curve", F.lit(k)) for k in range(7)]
    mean, spread, es, loss = Q.mean(q), Q.deviation(q), Q.shortfall(q), Q.loss_probability(q)
    distribution = F.struct(*[x.alias(n) for x, n in zip(q, NAMES, strict=True)], mean.alias("mu_hat"), spread.alias("sigma_hat"), loss.alias("p_loss"), es.alias("es20"))
    diagnostics = F.struct(F.coalesce("missing_rate", F.lit(1.0)).alias("missing_rate"), F.when(F.col("ok"), "ok").otherwise("fallback").alias("tail_extrapolation_status"))
    return rows.select(F.col("week").cast("string").alias("as_of_date"), "series_id", F.lit(VERSION).alias("version"), "mode", distribution.alias("distribution"), decision(mean, es, loss, F.col("mode"), knots, levels).alias("decision"), diagnostics.alias("diagnostics"))
