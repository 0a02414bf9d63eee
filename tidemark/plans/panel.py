"""The panel's weekly walk-forward run.

Three parts, by what depends on what. Fresh starts of the state model depend on a week's training rows only: they are dealt
out as tasks of one week each. The chain of warm starts goes from week to week: it advances by chunks of weeks, one job a
chunk, all panels side by side, from the models that the chunk before has written; a lost job goes on from there. The laws
of a week depend on its state model only: they are dealt out as tasks of a few weeks. A task gets the rows that its weeks
can use: those of the training window and the embargo before them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models import hmm, pooled
from tidemark.plans import tasks
from tidemark.plans.training import state_inputs
from tidemark.sources.scratch import Folder


@dataclass(frozen=True)
class Run:
    """Weeks between training and forecast, training weeks at most and at least, starts and iterations of the state model,
    weeks from one set of fresh starts to the next, weeks of a chain's job and of a task of laws."""

    embargo: int = 53
    longest: int = 416
    least: int = 312
    restarts: int = 20
    iterations: int = 200
    fresh_every: int = 1
    chain: int = 52
    laws: int = 13


MODEL = "panel string, as_of date, status string, start string, loglik double, initial array<double>, hazard array<double>, means array<double>, covs array<double>, n_obs long"
COLUMNS = [x.split(" ")[0] for x in MODEL.split(", ")]


def packed(panel: str, as_of, model: hmm.Hmm | None, start: str | None, n: int, status: str = "ok") -> tuple:
    if model is None:
        return (panel, as_of, status, None, None, None, None, None, None, n)
    return (panel, as_of, "ok", start, model.loglik, model.initial.tolist(), model.hazard.ravel().tolist(), model.means.ravel().tolist(), model.covs.ravel().tolist(), n)


def unpacked(row) -> hmm.Hmm | None:
    if row is None or row.status != "ok":
        return None
    means = np.array(row.means).reshape(hmm.STATES, -1)
    d = means.shape[1]
    return hmm.Hmm(np.array(row.initial), np.array(row.hazard).reshape(hmm.STATES, 3), means, np.array(row.covs).reshape(hmm.STATES, d, d), row.loglik)


def days(x) -> np.ndarray:
    return pd.to_datetime(pd.Series(x)).to_numpy("datetime64[D]")


def window(week: np.ndarray, as_of: np.datetime64, run: Run) -> np.ndarray:
    """Training rows of a week: at least `embargo` weeks older, of the last `longest` weeks before that."""
    late = as_of - np.timedelta64(7 * run.embargo, "D")
    return (week <= late) & (week > late - np.timedelta64(7 * run.longest, "D"))


def fresh_start(x: np.ndarray, seeds: list[int], iterations: int) -> hmm.Hmm | None:
    """The best of several starts, the first of equals; none where none converges or rows are too few."""
    try:
        found = [m for m in hmm.fit_many(*state_inputs(x), seeds, iterations) if m is not None]
    except (ValueError, np.linalg.LinAlgError):
        return None
    return max(found, key=lambda m: round(m.loglik, 6), default=None)


def seeds_of(as_of: np.datetime64, run: Run) -> list[int]:
    first = int(as_of.astype(int)) * 1000
    return list(range(first, first + run.restarts))


def chosen(x: np.ndarray, warm: hmm.Hmm | None, fresh: hmm.Hmm | None, run: Run) -> tuple[hmm.Hmm | None, str | None]:
    """The warm start's fit unless a fresh one is better."""
    best, start = None, None
    if warm is not None:
        try:
            best = hmm.fit_many(*state_inputs(x), [0], run.iterations, warm=warm)[0]
            start = "warm"
        except (ValueError, np.linalg.LinAlgError):
            best = None
    if fresh is not None and (best is None or round(fresh.loglik, 6) > round(best.loglik, 6)):
        best, start = fresh, "fresh"
    return best, start if best is not None else None


def fresh_models(macro: DataFrame, bounds: DataFrame, features: list[str], run: Run) -> DataFrame:
    """macro (panel, week, features) -> MODEL of each week that draws fresh starts."""
    step = 7 * run.fresh_every
    at = F.datediff("week", "first") + 7 * run.embargo
    low = F.ceil(at / step)
    high = F.least(F.floor((at + 7 * run.longest - 1) / step), F.floor(F.datediff("last", "first") / step))
    dealt = macro.join(bounds, "panel").withColumn("k", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    dealt = dealt.withColumn("as_of", F.expr(f"date_add(first, cast(k * {step} as int))"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        panel, as_of = pdf["panel"].iloc[0], pdf["as_of"].iloc[0]
        if len(pdf) < run.least:
            return pd.DataFrame(columns=COLUMNS)
        model = fresh_start(pdf[features].to_numpy(float), seeds_of(np.datetime64(as_of, "D"), run), run.iterations)
        return pd.DataFrame([packed(panel, as_of, model, "fresh", len(pdf), "failed")], columns=COLUMNS)

    return tasks.dealt(dealt.select("panel", "as_of", "week", *features), "panel", "as_of").groupBy("panel", "as_of").applyInPandas(fit, MODEL)


def advancing(features: list[str], start: np.datetime64, run: Run):
    """The chain from week `start` on, over the weeks that it is given."""

    def advance(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        week, x = days(pdf["week"]), pdf[features].to_numpy(float)
        fresh_of = {np.datetime64(r.as_of, "D"): unpacked(r) for r in known.itertuples() if r.kind == "fresh"}
        warm = next((unpacked(r) for r in known.itertuples() if r.kind == "before"), None)
        out = []
        for as_of in week[week >= start]:
            train = window(week, as_of, run)
            n = int(train.sum())
            if n < run.least:
                continue
            fresh = fresh_of.get(as_of)
            if warm is None and as_of not in fresh_of:  # a broken chain starts anew at once
                fresh = fresh_start(x[train], seeds_of(as_of, run), run.iterations)
            warm, how = chosen(x[train], warm, fresh, run)
            out.append(packed(key[0], as_of.astype(object), warm, how, n, "failed"))
        return pd.DataFrame(out, columns=COLUMNS)

    return advance


def chained(macro: DataFrame, fresh: DataFrame, bounds: DataFrame, features: list[str], run: Run, tmp: Folder) -> DataFrame:
    """MODEL of every week with enough training rows: the chain of warm starts, a job for each chunk of weeks."""
    spark = macro.sparkSession
    first, last = bounds.agg(F.min("first"), F.max("last")).first()
    before = spark.createDataFrame([], MODEL)
    paths: list[str] = []
    start = first
    while first is not None and start <= last:
        end = start + pd.Timedelta(weeks=run.chain).to_pytimedelta()
        inside = (F.col("as_of") >= F.lit(start)) & (F.col("as_of") < F.lit(end))
        known = fresh.where(inside).withColumn("kind", F.lit("fresh")).unionByName(before.withColumn("kind", F.lit("before")))
        oldest = start - pd.Timedelta(weeks=run.embargo + run.longest).to_pytimedelta()
        rows = macro.where((F.col("week") > F.lit(oldest)) & (F.col("week") < F.lit(end)))

        path = tmp.path()
        known = known.toDF(*known.columns)
        tasks.dealt(rows, "panel").groupBy("panel").cogroup(tasks.dealt(known, "panel").groupBy("panel")).applyInPandas(advancing(features, np.datetime64(start, "D"), run), MODEL).write.parquet(path)
        done = spark.read.schema(MODEL).parquet(path)
        newest = done.groupBy("panel").agg(F.max_by(F.struct(*COLUMNS[1:]), "as_of").alias("m")).select("panel", "m.*")
        # a panel without a week in this chunk keeps what it had
        before = newest.unionByName(before.join(newest.select("panel"), "panel", "left_anti")) if paths else newest
        before = tmp.cut(before)
        paths.append(path)
        start = end
    return spark.read.schema(MODEL).parquet(*paths) if paths else before


NAMES = ["q10", "q25", "q50", "q75", "q90"]
SPREAD = [f"r{q[1:]}" for q in NAMES]
WEEKS = "panel string, series_id string, week date, n_train long, hmm_status string, start string, p1 double, p2 double, p3 double, state string, dwell long, hazard double, solver string, " + ", ".join(f"{q} double" for q in NAMES) + ", r1_solver string, " + ", ".join(f"{q} double" for q in SPREAD)


def posteriors(x: np.ndarray, model: hmm.Hmm | None) -> tuple[np.ndarray, float]:
    """Posterior by row of x (even where there is no model), and the last row's hazard covariate; a model's first row has none."""
    if model is None or len(x) < 3:
        return np.tile([0.25, 0.5, 0.25], (len(x), 1)), float("nan")
    obs, h = state_inputs(x)
    pi = hmm.posterior_path(model, obs, h)
    return np.vstack([pi[:1], pi]), float(h[-1])


def week_laws(pdf: pd.DataFrame, as_of: np.datetime64, model: hmm.Hmm | None, macro: list[str], micro: list[str], anchor: str, run: Run) -> list[tuple]:
    """Rows of one week: state, and both laws' quantiles of the assets that are available. pdf is sorted by series and week."""
    week, series = days(pdf["week"]), pdf["series_id"].to_numpy()
    now = week == as_of
    # every asset has the same macro rows: those of any one asset, by week
    history, place = np.unique(week[week <= as_of], return_index=True)
    x = pdf[macro].to_numpy(float)[np.flatnonzero(week <= as_of)[place]]
    train = window(history, as_of, run)
    pi, _ = posteriors(x[train], model)
    today, hazard = posteriors(x[history > as_of - np.timedelta64(7 * (run.embargo + run.longest), "D")], model)
    path = today.argmax(axis=1)
    state, dwell = int(path[-1]), int(hmm.dwell_path(path)[-1, path[-1]])
    y, ok = pdf["y"].to_numpy(float), pdf["available"].to_numpy(bool)
    use = window(week, as_of, run) & ok & np.isfinite(y)
    name = None
    if model is not None:
        own = use & (series == anchor)
        at = np.searchsorted(history[train], week[own])
        weight = np.maximum(pi[at].sum(axis=0), 1e-12)
        name = hmm.labels((pi[at] * y[own, None]).sum(axis=0) / weight)[state]
    assets, group = np.unique(series[use], return_inverse=True)
    rows, both = np.flatnonzero(now), {}
    if use.sum() >= run.least and len(assets):
        probs = pi[np.searchsorted(history[train], week[use])]
        xm, xi = pdf[macro].to_numpy(float), pdf[micro].to_numpy(float)
        shared = pooled.fit_shared(group, np.column_stack([xm[use], probs]), xi[use], y[use])
        spread = None
        try:
            spread, fit = pooled.fit_spreads(group, xm[use], xi[use], y[use])
            if fit.status != "ok":
                spread = None
        except np.linalg.LinAlgError:
            pass
        able = rows[ok[rows] & np.isin(series[rows], assets)]
        g = np.searchsorted(assets, series[able])
        q = shared.predict(g, np.column_stack([xm[able], np.tile(today[-1], (len(able), 1)), xi[able]]))
        r = spread.predict(g, xm[able], xi[able]) if spread else np.full((len(able), 5), np.nan)
        both = {i: (shared.status, *a.round(6), "ok" if spread else "per_asset_fallback", *b.round(6)) for i, a, b in zip(able, q, r, strict=True)}
    nothing = (None, *[None] * 5, None, *[None] * 5)
    common = ("ok" if model is not None else "failed", today[-1].round(6).tolist(), name, dwell, None if np.isnan(hazard) else round(hazard, 6))
    return [(series[i], int(use.sum()), common, both.get(i, nothing)) for i in rows]


def laws(rows: DataFrame, models: DataFrame, bounds: DataFrame, macro: list[str], micro: list[str], anchor: str, run: Run) -> DataFrame:
    """WEEKS of every modelled week; rows reach the tasks of the weeks that can use them."""
    step = 7 * run.laws
    at = F.datediff("week", "first")
    low = F.floor(at / step)
    high = F.least(F.floor((at + 7 * (run.embargo + run.longest)) / step), F.floor(F.datediff("last", "first") / step))
    dealt = rows.join(bounds, "panel").withColumn("chunk", F.explode(F.sequence(low, high)))
    own = models.join(bounds, "panel").withColumn("chunk", F.floor(F.datediff("as_of", "first") / step)).select("chunk", *COLUMNS)

    def fit(key: tuple, pdf: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["series_id", "week"])
        out = []
        for m in models.sort_values("as_of").itertuples():
            as_of = np.datetime64(m.as_of, "D")
            for series, n, (status, p, name, dwell, hazard), q in week_laws(pdf, as_of, unpacked(m), macro, micro, anchor, run):
                out.append((key[0], series, m.as_of, n, status, m.start, *p, name, dwell, hazard, *q))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in WEEKS.split(", ")])

    key = ["panel", "chunk"]
    return tasks.dealt(dealt, *key).groupBy(*key).cogroup(tasks.dealt(own, *key).groupBy(*key)).applyInPandas(fit, WEEKS)


def backtest(rows: DataFrame, macro: list[str], micro: list[str], anchor: str, run: Run) -> DataFrame:
    """rows (panel, series_id, week, macro, micro, available, y) -> WEEKS. Macro features are a week's, the same for all assets
    and never null; micro ones are 0 where available is false; y is null where it isn't known. bounds has a row a panel."""
    tmp = Folder(rows.sparkSession, "panel")
    rows = tmp.cut(rows.select("panel", "series_id", "week", *macro, *micro, "available", "y"))
    bounds = tmp.cut(rows.groupBy("panel").agg(F.min("week").alias("first"), F.max("week").alias("last")))
    weeks = tmp.cut(rows.groupBy("panel", "week").agg(*[F.first(x).alias(x) for x in macro]))
    fresh = tmp.cut(fresh_models(weeks, bounds, macro, run))
    models = chained(weeks, fresh, bounds, macro, run, tmp)
    return laws(rows, models, bounds, macro, micro, anchor, run)
