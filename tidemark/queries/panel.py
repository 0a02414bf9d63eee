"""Jobs: the cached feature table, masked fills, state inputs, training artifacts, weekly inference and the panel run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, query
from tidemark.functions import quantiles as Q
from tidemark.functions import scalar as S
from tidemark.operators import alignment as A
from tidemark.operators import calendar as C
from tidemark.operators import windows as W
from tidemark.plans import panel as plan
from tidemark.plans import training
from tidemark.queries.distribution import FORECAST, QS, RAW, forecast, missing_guard, raw_scores
from tidemark.queries.series import FEATURES_SQL, ID, WEEKLY, by_week, coalesce_vol, features, r6, rv20_weekly, weekly_features, weekly_prices
from tidemark.queries.storage import materialised
from tidemark.sources import tables as T
from tidemark.sources.scratch import Folder

XS = [f"x{k}" for k in range(1, 6)]
COMPLETE_SQL = " AND ".join(f"{x} IS NOT NULL" for x in XS)


def features_and_targets(spark: SparkSession, d: str) -> DataFrame:
    ahead = weekly_prices(spark, d).select("series_id", "week", A.forward_log_return("value", 13, ID).alias("y"))
    return ahead.join(features(spark, d), "week").select("series_id", "week", *XS, "y")


@query(
    f"""WITH fe AS ({FEATURES_SQL} SELECT week, {', '.join(XS)} FROM f), ta AS ({WEEKLY} SELECT a.series_id, a.week, ln(b.value) - ln(a.value) AS y FROM weekly a LEFT JOIN weekly b ON a.series_id = b.series_id AND b.week = a.week + 91)
SELECT series_id, week, {', '.join(f'round({x}, 6) AS {x}' for x in XS)}, round(y, 6) AS y, count(*) FILTER ({COMPLETE_SQL}) OVER w AS n_complete, max(CASE WHEN {COMPLETE_SQL} THEN week END) OVER w AS last_complete FROM ta JOIN fe USING (week) WINDOW w AS (PARTITION BY series_id ORDER BY week)"""
)
def feature_cache(spark, d):
    """The weekly features and targets, computed once; each row knows how much of the table its as_of may use."""
    rows = materialised(spark, features_and_targets(spark, d), "features")
    whole = F.when(Q.total([F.col(x) for x in XS]).isNotNull(), F.col("week"))
    w = by_week().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("series_id", "week", *[r6(F.col(x), x) for x in [*XS, "y"]], F.count(whole).over(w).alias("n_complete"), F.max(whole).over(w).alias("last_complete"))


def filled(x: str, available: str):
    """0 where unavailable; an available value must be finite."""
    good = S.finite(F.col(x))
    return F.when(~F.col(available), 0.0).when(good.isNotNull(), good).otherwise(F.raise_error(F.lit(f"{x} is available but not finite")).cast("double"))


@query(
    f"""{WEEKLY}, v AS (WITH {T.VOLATILITY}, {T.weekly('vols', 'wv')} SELECT series_id AS vol_id, week, value AS vol FROM wv)
SELECT w.series_id, w.week, i.vol_id, v.vol IS NOT NULL AS available, round(coalesce(v.vol, 0), 6) AS vol FROM weekly w CROSS JOIN (SELECT DISTINCT vol_id FROM v) i LEFT JOIN v ON v.vol_id = i.vol_id AND v.week = w.week"""
)
def masked_fill(spark, d):
    """Each asset's week with each volatility series: unavailable values are 0 and marked, available ones must be finite."""
    vols = A.weekly_values(T.volatility(spark, d)).select(F.col("series_id").alias("vol_id"), "week", F.col("value").alias("vol"))
    ids = vols.agg(F.array_sort(F.collect_set("vol_id")).alias("ids"))
    rows = weekly_prices(spark, d).select("series_id", "week").join(F.broadcast(ids), F.lit(True)).select("series_id", "week", F.explode("ids").alias("vol_id"))
    met = rows.join(vols, ["vol_id", "week"], "left").withColumn("available", F.col("vol").isNotNull())
    return met.select("series_id", "week", "vol_id", "available", r6(filled("vol", "available"), "vol"))


def scaled_features(spark: SparkSession, d: str) -> DataFrame:
    """(week, z1..z5): scaled features of the weeks that have them all."""
    wide = weekly_features(spark, d).groupBy("week").pivot("feature", XS).agg(F.first("scaled"))
    return wide.select("week", *[F.col(x).alias(f"z{x[1]}") for x in XS]).dropna("any")


ZS = [f"z{x[1]}" for x in XS]


@query()
def hmm_inputs(spark, d):
    """Observations of the state model and its hazard covariate, from all scaled weeks; one macro panel is one group."""
    names = ["pc1", "pc2", "d_pc1", "d_pc2", "micro1", "micro2", "hazard"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        obs, h = training.state_inputs(pdf[ZS].to_numpy(float))
        return pd.DataFrame(np.column_stack([obs, h]).round(6), columns=names).assign(week=pdf["week"].to_numpy()[1:])[["week", *names]]

    return scaled_features(spark, d).withColumn("panel", F.lit("macro")).groupBy("panel").applyInPandas(fit, "week date, " + ", ".join(f"{n} double" for n in names))


def training_files(spark, d, restarts: int = 50, iterations: int = 200) -> DataFrame:
    rows = features_and_targets(spark, d).join(scaled_features(spark, d), "week")
    return training.trained(rows, ZS, XS, restarts, iterations)


def stored_files(spark, made: DataFrame) -> DataFrame:
    """(series_id, file, read) of made (series_id, file, text), written to a folder each and read back."""
    path = Folder(spark, "training").path()
    made.select("series_id", "file", "text").write.partitionBy("series_id", "file").text(path)
    return spark.read.text(path).select(F.col("series_id").cast("string").alias("series_id"), "file", F.col("value").alias("read"))


@query()
def training_job(spark, d):
    """The six files of each series' training run, written, read back and compared: size, digest, and whether they are the same."""
    made = materialised(spark, training_files(spark, d), "training-made")
    rows = made.join(stored_files(spark, made), ["series_id", "file"], "left")
    return rows.select("series_id", "file", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha256"), F.coalesce(F.col("text") == F.col("read"), F.lit(False)).alias("round_trip"))


@query()
def artifact_inference(spark, d):
    """The weeks after each series' training rows, inferred from the stored files of its training run: states, distribution,
    score, and modes for what is missing."""
    files = stored_files(spark, materialised(spark, training_files(spark, d), "training-made")).withColumnRenamed("read", "text")
    rows = materialised(spark, features_and_targets(spark, d).select("series_id", "week").join(scaled_features(spark, d), "week", "left"), "inference-rows")
    first = rows.groupBy("series_id").agg(F.date_sub(F.max("week"), 7 * training.EMBARGO - 7).alias("first"))
    return training.inferred(rows, ZS, files, first)


@query(
    f"""{RAW}, guard AS ({ORACLES['missing_guard']}), o AS (SELECT w.series_id, w.week, CASE WHEN fc.week IS NULL THEN 'insufficient_history' WHEN guard.mode IS NULL THEN 'no_features' WHEN guard.mode <> 'NORMAL' THEN 'missing_inputs' ELSE 'ok' END AS reason, CASE WHEN fc.week IS NULL OR guard.mode IS NULL THEN 'BLOCKED' ELSE guard.mode END AS mode, fc.q4, raw FROM weekly w LEFT JOIN fc USING (series_id, week) LEFT JOIN s USING (series_id, week) LEFT JOIN guard ON guard.week = w.week)
SELECT series_id, week, mode, reason, CASE WHEN mode = 'NORMAL' THEN round(q4, 6) WHEN mode = 'DEGRADED' THEN 0 END AS q50, round(CASE WHEN mode = 'NORMAL' THEN raw ELSE 50 END, 4) AS offense, CASE WHEN mode <> 'NORMAL' THEN 'NEUTRAL' WHEN raw <= 35 THEN 'DEFENSIVE' WHEN raw >= 65 THEN 'OFFENSIVE' ELSE 'NEUTRAL' END AS stance FROM o"""
)
def weekly_inference(spark, d):
    """Every week of every series gets an output: failures become modes. Too little history or no features block, missing
    inputs block or degrade; blocked weeks have no distribution, degraded ones a zero one, both the neutral score."""
    rows = weekly_prices(spark, d).select("series_id", "week").join(forecast(spark, d).select("series_id", "week", "q4"), ["series_id", "week"], "left")
    rows = rows.join(raw_scores(spark, d), ["series_id", "week"], "left").join(missing_guard(spark, d).select("week", F.col("mode").alias("guard")), "week", "left")
    short, blind = F.col("q4").isNull(), F.col("guard").isNull()
    mode = F.when(short | blind, "BLOCKED").otherwise(F.col("guard"))
    reason = F.when(short, "insufficient_history").when(blind, "no_features").when(F.col("guard") != "NORMAL", "missing_inputs").otherwise("ok")
    normal = mode == "NORMAL"
    return rows.select("series_id", "week", mode.alias("mode"), reason.alias("reason"), F.when(normal, F.round("q4", 6)).when(mode == "DEGRADED", 0.0).alias("q50"), F.round(F.when(normal, F.col("raw")).otherwise(50.0), 4).alias("offense"), F.when(normal, S.stance("raw")).otherwise("NEUTRAL").alias("stance"))


MICRO = ["m1", "m2", "m3"]


def panel_frame(spark: SparkSession, d: str | T.Stored) -> DataFrame:
    """(panel, series_id, week, z1..z5, m1..m3, mode, available, y): the week's macro features, each asset's volatility
    features and 13-week forward return. Of the volatility: its logarithm, that over 4 weeks, and against the realised one;
    an asset without an index has its realised volatility in place of it. Micro features are scaled like macro ones."""
    realised = rv20_weekly(spark, d).select(F.col("series_id").alias("asset_id"), "week", "rv")
    vol = coalesce_vol(spark, d).join(realised, ["asset_id", "week"], "left").withColumnRenamed("asset_id", "series_id")
    iv, rv = S.safe_ln(F.coalesce("vol", "rv")), S.safe_ln("rv")
    raw = vol.withColumn("m1", iv).withColumn("m2", F.col("m1") - A.at_week_offset("m1", -4, ID)).withColumn("m3", F.col("m1") - rv)
    long = raw.unpivot(["series_id", "week"], MICRO, "feature", "x").where("x is not null")
    z = W.robust_z(long, "x", ["series_id", "feature"]).select("series_id", "week", "feature", S.squash("z").alias("s"))
    scaled = z.groupBy("series_id", "week").pivot("feature", MICRO).agg(F.first("s"))
    outcome = weekly_prices(spark, d).select("series_id", "week", A.forward_log_return("value", 13, ID).alias("y"))
    rows = outcome.join(raw.select("series_id", "week", "mode"), ["series_id", "week"]).join(scaled, ["series_id", "week"], "left").join(scaled_features(spark, d), "week")
    available = Q.total([F.col(m) for m in MICRO]).isNotNull()
    return rows.withColumn("available", available).select(F.lit("panel").alias("panel"), "series_id", "week", *ZS, *[filled(m, "available").alias(m) for m in MICRO], "mode", "available", "y")


@query()
def panel_backtest(spark, d):
    """Every week of the panel: state, both laws with tails and scores, the expanding baseline's score, trailing coverage, mode.
    The tables have 340 weeks, fewer than the 52-week horizon with 312 training weeks needs: 13 weeks ahead, 14 of embargo, 60
    training rows. Fresh starts of the state model come every 13 weeks, the warm start's chain goes on each week."""
    run = plan.Run(embargo=14, least=60, fresh_every=13)
    d = T.stored(spark, d)
    frame = materialised(spark, panel_frame(spark, d), "panel-frame")
    q = plan.backtest(frame, ZS, MICRO, "A", run).join(frame.select("series_id", "week", F.col("mode").alias("micro_mode"), "y"), ["series_id", "week"])
    low, high = Q.extrapolated("q10", "q25", "q75", "q90")
    r_low, r_high = Q.extrapolated("r10", "r25", "r75", "r90")
    curve, spread = [low, *map(F.col, plan.NAMES), high], [r_low, *map(F.col, plan.SPREAD), r_high]
    w = by_week().rowsBetween(-103, 0)
    hit = lambda x: F.avg((F.col("y") <= F.col(x)).cast("double")).over(w)
    base = forecast(spark, d).select("series_id", "week", *QS)
    some = F.max(F.col("q50").isNotNull()).over(Window.partitionBy("panel", "week"))
    fallen = (F.col("solver") != "ok") | (F.col("hmm_status") != "ok")
    mode = F.when(~some, "BLOCKED").when(fallen, "DEGRADED").otherwise("NORMAL")
    rows = q.join(base, ["series_id", "week"], "left")
    state = ["hmm_status", "start", "p1", "p2", "p3", "state", "dwell", "hazard"]
    return rows.select("series_id", "week", "n_train", "micro_mode", mode.alias("mode"), *state, "solver", "r1_solver", r6(low, "q05"), *[r6(F.col(x), x) for x in plan.NAMES], r6(high, "q95"), r6(r_low, "r05"), *[r6(F.col(x), x) for x in plan.SPREAD], r6(r_high, "r95"), r6(Q.pinball("y", curve), "crps"), r6(Q.pinball("y", spread), "crps_r1"), r6(Q.pinball("y", QS), "crps_baseline"), r6(hit("q10"), "coverage_q10"), r6(hit("q90"), "coverage_q90"))
