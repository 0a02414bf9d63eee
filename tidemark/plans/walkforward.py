"""Plans that fit models: by series, by start, and week by week."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import tasks

#: Starts of a state model that one task advances together.
TOGETHER = 25


def no_states(n: int) -> np.ndarray:
    return np.zeros((n, 0))


def best_hmm(returns: DataFrame, restarts: int, iterations: int) -> DataFrame:
    """returns (series_id, week, r) -> means, log likelihood and labels of the best start. Starts are dealt out as tasks."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import hmm

        pdf = pdf.sort_values("week")
        r, first = pdf["r"].to_numpy(float), int(pdf["first"].iloc[0])
        x = np.column_stack([r, np.abs(r)])
        starts = list(range(first, min(first + TOGETHER, restarts)))
        found = [(s, m) for s, m in zip(starts, hmm.fit_many(x, np.zeros(len(r)), starts, iterations), strict=True) if m is not None]
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "start": [s for s, _ in found], "loglik": [m.loglik for _, m in found], "means": [m.means[:, 0].tolist() for _, m in found]})

    rows = returns.where("r is not null").select("series_id", "week", "r").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1), F.lit(TOGETHER))))
    fits = tasks.dealt(rows, "series_id", "first").groupBy("series_id", "first").applyInPandas(fit, "series_id string, start int, loglik double, means array<double>")
    best = fits.groupBy("series_id").agg(F.max_by(F.struct("start", "loglik", "means"), F.struct(F.round("loglik", 6), -F.col("start"))).alias("b"))
    order = F.array_sort(F.transform(F.col("b.means"), lambda m, i: F.struct(m.alias("m"), i.alias("i"))))
    return best.select("series_id", "b.start", F.round("b.loglik", 3).alias("loglik"), F.transform(order, lambda s: s["i"].cast("int")).alias("states_by_return"))


def by_series(rows: DataFrame, f, schema: str) -> DataFrame:
    return rows.groupBy("series_id").applyInPandas(lambda pdf: f(pdf.sort_values("week")), schema)


def quantile_fits(pairs: DataFrame) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import quantreg

        coef, out = quantreg.fit_linear(pdf[["x"]].to_numpy(float), no_states(len(pdf)), pdf["y"].to_numpy(float))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "tau": quantreg.TAUS, "intercept": coef[:, 0].round(5), "slope": coef[:, 1].round(5), "objective": round(out.objective, 6), "status": out.status})

    return by_series(pairs, fit, "series_id string, tau double, intercept double, slope double, objective double, status string")


def one_group(rows: DataFrame, f, schema: str) -> DataFrame:
    """A joint fit over all assets of one panel. Its rows are weeks times assets, few by nature; panels are separate groups."""
    return rows.withColumn("panel", F.lit(0)).groupBy("panel").applyInPandas(lambda pdf: f(pdf.sort_values(["series_id", "week"])), schema)


def panel_fit(pairs: DataFrame) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import quantreg

        names, groups = np.unique(pdf["series_id"], return_inverse=True)
        theta, how = quantreg.fit_panel_or_each(groups, pdf[["x"]].to_numpy(float), pdf["y"].to_numpy(float), len(names))
        n = len(names)
        return pd.DataFrame([{"series_id": s, "tau": float(t), "intercept": round(theta[k, a], 5), "slope": round(theta[k, n] + theta[k, n + 1 + a], 5), "fit": how} for k, t in enumerate(quantreg.TAUS) for a, s in enumerate(names)])

    return one_group(pairs, fit, "series_id string, tau double, intercept double, slope double, fit string")


def spread_fit(pairs: DataFrame) -> DataFrame:
    """Median and four spreads of a panel's assets, their slopes pooled: each asset's own parameters, the shared ones and what
    the joint fit has reached."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import pooled

        names, groups = np.unique(pdf["series_id"], return_inverse=True)
        x = pdf[["x"]].to_numpy(float)
        law, _ = pooled.fit_spreads(groups, x, np.abs(x), pdf["y"].to_numpy(float))
        return pd.DataFrame({"series_id": names, "own": [o.round(5).tolist() for o in law.own], "shared": [law.shared.round(5).tolist()] * len(names), "objective": round(law.objective, 6), "status": law.status})

    return one_group(pairs, fit, "series_id string, own array<double>, shared array<double>, objective double, status string")


def student_fits(pairs: DataFrame) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import scale

        pi = np.full((len(pdf), 1), 1.0)
        theta, value, status = scale.fit_student(pdf[["x"]].to_numpy(float), pi, pdf["y"].to_numpy(float))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "theta": [theta.round(4).tolist()], "objective": round(value, 5), "status": status})

    return by_series(pairs, fit, "series_id string, theta array<double>, objective double, status string")


def har_fits(returns: DataFrame) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import scale

        r = pdf["r"].to_numpy(float)
        iv = pd.Series(np.abs(r)).rolling(10, min_periods=1).mean().to_numpy()
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "coef": [scale.har_sigma(r, iv).round(5).tolist()], "n": len(r)})

    rows = returns.where("r is not null").select("series_id", F.col("obs_date").alias("week"), "r")
    return by_series(rows, fit, "series_id string, coef array<double>, n long")


def garch_fits(returns: DataFrame) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import scale

        pdf = pdf.sort_values("week")
        kind, law = pdf["model"].iloc[0].split("-")
        _, nll, sigma = scale.fit_garch(pdf["r"].to_numpy(float), kind, law)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "model": [f"{kind}-{law}"], "nll": [round(nll, 2)], "sigma": [round(sigma, 4)]})

    rows = returns.select("series_id", "week", "r").withColumn("model", F.explode(F.array(*map(F.lit, ("egarch-normal", "egarch-t", "gjr-normal", "gjr-t")))))
    return rows.groupBy("series_id", "model").applyInPandas(fit, "series_id string, model string, nll double, sigma double")


def tail_fits(returns: DataFrame) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import scale

        r = pdf["r"].to_numpy(float)
        k, nu = scale.fit_tail((r - r.mean()) / r.std())
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "k": [round(k, 4)], "nu": [round(nu, 2)], "n": [len(r)]})

    return by_series(returns.select("series_id", "week", "r"), fit, "series_id string, k double, nu double, n long")


def isotonic_fits(pairs: DataFrame) -> DataFrame:
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models.numerics import isotonic

        pdf = pdf.sort_values(["x", "week"])
        return pd.DataFrame({"series_id": pdf["series_id"], "week": pdf["week"], "fitted": isotonic(pdf["y"].to_numpy(float)).round(6)})

    return by_series(pairs, fit, "series_id string, week date, fitted double")


def predict(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    from tidemark.models import quantreg

    coef, _ = quantreg.fit_linear(x, no_states(len(y)), y)
    q = coef[:, :1].T + at @ coef[:, 1:].T
    return np.maximum.accumulate(q, axis=1)


NAMES = ["q10", "q25", "q50", "q75", "q90"]
OUTCOMES = "series_id string, as_of date, n_train long, status string, " + ", ".join(f"{q} double" for q in NAMES)
#: Weeks that one task of a walk-forward run predicts.
WEEKS = 26


def run(pairs: DataFrame, embargo: int, min_train: int, every: int = 1, longest: int | None = None, weeks: int = WEEKS) -> DataFrame:
    """OUTCOMES of every so many weeks of each series. What goes wrong in a week is its status, not an error: too few rows
    (insufficient_history), no optimum (inaccurate), no solution (failed). A task predicts a block of weeks from the rows that
    these can use: with `longest`, those of so many weeks before the embargo, else all earlier ones."""
    number = F.floor(F.unix_date("week") / 7)
    last = F.max(number).over(Window.partitionBy("series_id"))
    upto = F.least(last, number + embargo + longest) if longest else last
    place = F.row_number().over(Window.partitionBy("series_id").orderBy("week")) - 1
    rows = pairs.select("series_id", "week", "x", "y", number.alias("number"), upto.alias("upto"), (place % every == 0).alias("asked"))
    dealt = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("number") / weeks), F.floor(F.col("upto") / weeks))))

    def predict_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import quantreg

        pdf = pdf.sort_values("week")
        number, x, y = pdf["number"].to_numpy(), pdf[["x"]].to_numpy(float), pdf["y"].to_numpy(float)
        out = []
        for i in np.flatnonzero((number // weeks == key[1]) & pdf["asked"].to_numpy()):
            train = number <= number[i] - embargo
            if longest:
                train &= number > number[i] - embargo - longest
            n, q, status = int(train.sum()), [None] * 5, "insufficient_history"
            if n >= min_train:
                try:
                    coef, fit = quantreg.fit_linear(x[train], no_states(n), y[train])
                    status = fit.status
                    q = np.maximum.accumulate(coef[:, 0] + coef[:, 1:] @ x[i]).round(5).tolist()
                except (ValueError, np.linalg.LinAlgError):
                    status = "failed"
            out.append((key[0], pdf["week"].iloc[i], n, status, *q))
        return pd.DataFrame(out, columns=["series_id", "as_of", "n_train", "status", *NAMES])

    return tasks.dealt(dealt, "series_id", "block").groupBy("series_id", "block").applyInPandas(predict_block, OUTCOMES)


def under_policy(outcomes: DataFrame, start, min_train: int, policy: str) -> DataFrame:
    """outcomes from a start on, with effective_start (a series' first week with enough rows) and what the policy does with
    weeks before it: allow keeps their failures as rows, clip_diagnostic leaves them out and tells how many in n_clipped,
    raise fails when such a week is read."""
    if policy not in ("allow", "raise", "clip_diagnostic"):
        raise ValueError(f"unknown policy {policy}")
    own = Window.partitionBy("series_id")
    ready = F.min(F.when(F.col("n_train") >= min_train, F.col("as_of"))).over(own)
    rows = outcomes.withColumn("effective_start", ready).where(F.col("as_of") >= start)
    early = F.col("effective_start").isNull() | (F.col("as_of") < F.col("effective_start"))
    if policy == "raise":
        error = F.raise_error(F.concat(F.lit("walk-forward start precedes the effective start of "), "series_id")).cast("string")
        return rows.withColumn("status", F.when(early, error).otherwise(F.col("status"))).withColumn("n_clipped", F.lit(0).cast("bigint"))
    if policy == "clip_diagnostic":
        return rows.withColumn("n_clipped", F.count_if(early).over(own)).where(~early)
    return rows.withColumn("n_clipped", F.lit(0).cast("bigint"))


def challenger(pairs: DataFrame, every: int, min_train: int, embargo: int) -> DataFrame:
    """A row of each week with enough training rows: quantiles by the last fit, the week of that fit (fitted) and its rows."""
    names = ["q05", "q10", "q25", "q50", "q75", "q90", "q95"]
    columns = ["series_id", "as_of", "fitted", "n_train", "objective", "status", *names]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models import scale

        x, y, week, out, theta, fitted = pdf[["x"]].to_numpy(float), pdf["y"].to_numpy(float), pd.to_datetime(pdf["week"]).to_numpy("datetime64[D]"), [], None, None
        for t in range(len(pdf)):
            n = int(np.searchsorted(week, week[t] - np.timedelta64(7 * embargo, "D"), "right"))
            if n < min_train:
                continue
            if fitted is None or week[t] >= week[fitted] + np.timedelta64(7 * every, "D"):
                theta, value, status = scale.fit_student(x[:n], np.ones((n, 1)), y[:n], theta, 40)
                fitted, rows = t, n
            q = scale.student_quantiles(np.array([theta[0] + x[t] @ theta[1:-1]]), np.exp(np.clip(theta[-1:], -8, 3)))[0]
            out.append((pdf["series_id"].iloc[0], pdf["week"].iloc[t], pdf["week"].iloc[fitted], rows, round(value, 5), status, *q.round(5)))
        return pd.DataFrame(out, columns=columns)

    return by_series(pairs, fit, "series_id string, as_of date, fitted date, n_train long, objective double, status string, " + ", ".join(f"{q} double" for q in names))


LAW_ROWS = "series_id string, as_of date, hypothesis string, n_train long, y double, mu double, sigma double, " + ", ".join(f"{q} double" for q in NAMES)


def hypotheses(rows: DataFrame, features: list[str], embargo: int, min_train: int, longest: int | None = None, weeks: int = WEEKS) -> DataFrame:
    """LAW_ROWS of every week of rows (series_id, week, features, y) with enough training rows, for each of the four laws. The
    last feature parts the states. Weeks are dealt as in run(); a law is fitted anew each week."""
    number = F.floor(F.unix_date("week") / 7)
    last = F.max(number).over(Window.partitionBy("series_id"))
    upto = F.least(last, number + embargo + longest) if longest else last
    numbered = rows.select("series_id", "week", *features, "y", number.alias("number"), upto.alias("upto"))
    dealt = numbered.withColumn("block", F.explode(F.sequence(F.floor(F.col("number") / weeks), F.floor(F.col("upto") / weeks))))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.models.laws import LAWS

        pdf = pdf.sort_values("week")
        number, y = pdf["number"].to_numpy(), pdf["y"].to_numpy(float)
        X = np.column_stack([np.ones(len(y)), pdf[features].to_numpy(float)])
        out = []
        for i in np.flatnonzero(number // weeks == key[1]):
            train = number <= number[i] - embargo
            if longest:
                train &= number > number[i] - embargo - longest
            n = int(train.sum())
            if n < min_train:
                continue
            for name, law in LAWS.items():
                mu, sigma, q = law(X[train], y[train], X[i : i + 1])
                out.append((key[0], pdf["week"].iloc[i], name, n, y[i], mu[0], sigma[0], *q[0]))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in LAW_ROWS.split(", ")])

    return tasks.dealt(dealt, "series_id", "block").groupBy("series_id", "block").applyInPandas(fit, LAW_ROWS)
