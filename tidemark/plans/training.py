"""The training job of each series."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models import hmm, quantreg
from tidemark.models.pca import two_components
from tidemark.plans import tasks

EMBARGO, LONGEST, LEAST = 14, 416, 60
#: Rank of the full curve's levels.
TAUS = np.array([0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95])


def state_inputs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observations [pc1, pc2, their changes, the last two features] of rows 1.. and the hazard's covariate, from scaled features."""
    if len(x) < 3:
        raise ValueError("too few rows")
    pc = two_components(x)
    change = pc[1:] - pc[:-1]
    return np.column_stack([pc[1:], change, x[1:, -2:]]), x[1:, 1] + 0.5 * x[1:, -1]


def mad(v: np.ndarray) -> float:
    return max(float(np.median(np.abs(v - np.median(v)))), 1e-8)


def full_curve(inner: np.ndarray) -> np.ndarray:
    """Rows of five inner quantiles with the tails they imply."""
    low = inner[:, 0] - 0.6 * (inner[:, 1] - inner[:, 0])
    high = inner[:, 4] + 0.6 * (inner[:, 4] - inner[:, 3])
    return np.column_stack([low, inner, high])


def moments(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, expected shortfall below 0.20 and probability of loss of each curve (linear between its levels)."""
    width = np.diff(TAUS)
    mean = ((q[:, 1:] + q[:, :-1]) / 2 * width).sum(axis=1) / width.sum()
    at20 = q[:, 1] + (q[:, 2] - q[:, 1]) * (0.10 / 0.15)
    es = -(0.05 * (q[:, 0] + q[:, 1]) / 2 + 0.10 * (q[:, 1] + at20) / 2) / 0.15
    loss = np.array([np.interp(0.0, row, TAUS, left=0.0, right=1.0) for row in np.maximum.accumulate(q, axis=1)])
    return mean, es, loss


def decision_stats(q: np.ndarray) -> tuple[dict, dict]:
    """Medians and MADs of the moments, and the score thresholds of the training rows' utilities."""
    names = ("er", "es20", "ploss")
    values = moments(q)
    stats = {f"{n}_{k}": v for n, x in zip(names, values, strict=True) for k, v in (("med", float(np.median(x))), ("mad", mad(x)))}
    z = [(x - stats[f"{n}_med"]) / stats[f"{n}_mad"] for n, x in zip(names, values, strict=True)]
    u = z[0] - 1.2 * z[1] - 0.8 * z[2]
    cut = np.quantile(u, [0, 0.2, 0.4, 0.6, 0.8, 1])
    cut[0], cut[-1] = cut[0] - 3 * mad(u), cut[-1] + 3 * mad(u)
    for k in range(1, 6):
        cut[k] = max(cut[k], cut[k - 1] + 1e-8)
    return stats, {f"u_q{k}": float(v) for k, v in zip((0, 20, 40, 60, 80, 100), cut, strict=True)}


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=True, sort_keys=True, separators=(",", ":"))


def artifact(x: np.ndarray, raw: np.ndarray, y: np.ndarray, seed: int | None, iterations: int) -> dict[str, str]:
    """The six files of a training run by name, as sorted compact JSON; no state model, no file of one.
    x, raw: scaled and raw features of the training rows; seed: of the best start, or null where none converged."""
    obs, h = state_inputs(x)
    x, raw, y = x[1:], raw[1:], y[1:]
    model = hmm.fit_many(obs, h, [seed], iterations)[0] if seed is not None else None
    names = {0: "DEFENSIVE", 1: "NEUTRAL", 2: "OFFENSIVE"}
    pi = np.tile([0.25, 0.5, 0.25], (len(y), 1))
    if model is not None:
        pi = hmm.posterior_path(model, obs, h)
        weight = np.maximum(pi.sum(axis=0), 1e-12)
        names = hmm.labels((pi * y[:, None]).sum(axis=0) / weight)
    coef, fit = quantreg.fit_linear(x, pi[:, :-1], y)
    inner = np.maximum.accumulate(np.column_stack([np.ones(len(y)), x, pi[:, :-1]]) @ coef.T, axis=1)
    stats, cuts = decision_stats(full_curve(inner))
    k = x.shape[1]
    out = {
        "utility_zstats.json": stats,
        "offense_thresholds.json": cuts,
        "state_label_map.json": {str(s): n for s, n in names.items()},
        "train_distributions.json": {f"x{j + 1}": raw[:, j].tolist() for j in range(raw.shape[1])},
        "qr_coefs.json": {"a": coef[:, 0].tolist(), "b": coef[:, 1 : 1 + k].tolist(), "c": coef[:, 1 + k :].tolist(), "solver_status": fit.status},
    }
    if model is not None:
        out["hmm_model.json"] = {"emission_cov": model.covs.tolist(), "emission_mean": model.means.tolist(), "label_map": {str(s): n for s, n in names.items()}, "log_likelihood": model.loglik, "transition_coefs": model.hazard.tolist()}
    return {name: compact(v) for name, v in out.items()}


def training_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows (series_id, week, scaled and raw features, y) -> those of each series' training set: complete, at least EMBARGO
    weeks before the last week, the last LONGEST of them."""
    from pyspark.sql import Window

    last = F.max("week").over(Window.partitionBy("series_id"))
    eligible = rows.withColumn("as_of", last).dropna("any").where(F.col("week") <= F.date_sub("as_of", 7 * EMBARGO))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("week")))
    return eligible.withColumn("back", rank).where(F.col("back") <= LONGEST).select("series_id", "week", *features, "y")


def trained(rows: DataFrame, scaled: list[str], raw: list[str], restarts: int = 50, iterations: int = 200, together: int = 25) -> DataFrame:
    """(series_id, file, text) of each series' artifact. The starts of the state model are dealt out as tasks; only the best
    one's seed comes back to the series' own task, which fits it again with everything else."""
    sets = training_rows(rows, [*scaled, *raw])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        first, series = int(pdf["first"].iloc[0]), pdf["series_id"].iloc[0]
        if len(pdf) < LEAST:
            return pd.DataFrame()
        own = list(range(first, min(first + together, restarts)))
        found = hmm.fit_many(*state_inputs(pdf[scaled].to_numpy(float)), own, iterations)
        return pd.DataFrame([(series, s, m.loglik) for s, m in zip(own, found, strict=True) if m is not None], columns=["series_id", "seed", "loglik"])

    dealt = sets.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1), F.lit(together))))
    fits = tasks.dealt(dealt, "series_id", "first").groupBy("series_id", "first").applyInPandas(starts, "series_id string, seed int, loglik double")
    best = fits.groupBy("series_id").agg(F.max_by("seed", F.struct(F.round("loglik", 6), -F.col("seed"))).alias("seed"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        if len(pdf) < LEAST:
            return pd.DataFrame()
        seed = None if pd.isna(pdf["seed"].iloc[0]) else int(pdf["seed"].iloc[0])
        files = artifact(pdf[scaled].to_numpy(float), pdf[raw].to_numpy(float), pdf["y"].to_numpy(float), seed, iterations)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "file": list(files), "text": list(files.values())})

    return sets.join(best, "series_id", "left").groupBy("series_id").applyInPandas(fit, "series_id string, file string, text string")


WEEKLY = "series_id string, week date, mode string, reason string, p1 double, p2 double, p3 double, state string, " + ", ".join(f"{q} double" for q in ("q05", "q10", "q25", "q50", "q75", "q90", "q95")) + ", er double, es20 double, p_loss double, offense double, stance string"
#: Scores at the thresholds of an artifact.
LEVELS = [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]


class Artifact:
    """A training run's files, read back. What is wrong with them is a mode and a reason for every week, not an error."""

    def __init__(self, files: dict[str, str]):
        self.mode, self.reason, self.model = "NORMAL", "ok", None
        try:
            read = {name: json.loads(text) for name, text in files.items()}
            if "qr_coefs.json" not in read:
                self.mode, self.reason = "BLOCKED", "no_artifact"
                return
            q = read["qr_coefs.json"]
            self.coef = np.column_stack([np.array(q["a"])[:, None], np.array(q["b"]), np.array(q["c"])])
            self.stats, self.cuts = read["utility_zstats.json"], [read["offense_thresholds.json"][f"u_q{k:.0f}"] for k in LEVELS]
            self.labels = read["state_label_map.json"]
            if q["solver_status"] not in ("ok", "inaccurate"):
                self.mode, self.reason = "BLOCKED", "quantile_solver_failed"
            elif "hmm_model.json" not in read:
                self.mode, self.reason = "DEGRADED", "em_nonconverge"
            else:
                m = read["hmm_model.json"]
                self.model = hmm.Hmm(np.full(hmm.STATES, 1 / hmm.STATES), np.array(m["transition_coefs"]), np.array(m["emission_mean"]), np.array(m["emission_cov"]), m["log_likelihood"])
        except (ValueError, KeyError, TypeError, IndexError):
            self.mode, self.reason = "BLOCKED", "invalid_artifact"

    def week(self, x: np.ndarray) -> tuple:
        """mode to stance of the last row of x, the scaled features of the weeks up to it."""
        neutral = ([0.25, 0.5, 0.25], None)
        if self.mode == "BLOCKED":
            return self.blank("BLOCKED", self.reason, *neutral)
        if not np.isfinite(x[-1]).all():
            return self.blank("BLOCKED", "missing_features", *neutral)
        if self.mode == "DEGRADED":
            return self.blank("DEGRADED", self.reason, *neutral)
        x = x[np.isfinite(x).all(axis=1)]
        if len(x) < 3:
            return self.blank("BLOCKED", "insufficient_history", *neutral)
        obs, h = state_inputs(x)
        pi = hmm.posterior_path(self.model, obs, h)[-1]
        if not np.isfinite(pi).all():
            return self.blank("DEGRADED", "invalid_posterior", *neutral)
        inner = np.maximum.accumulate(self.coef @ np.r_[1.0, x[-1], pi[:-1]])
        full = full_curve(inner[None])[0]
        values = [float(v[0]) for v in moments(full[None])]
        z = [(v - self.stats[f"{n}_med"]) / self.stats[f"{n}_mad"] for n, v in zip(("er", "es20", "ploss"), values, strict=True)]
        offense = float(np.interp(z[0] - 1.2 * z[1] - 0.8 * z[2], self.cuts, LEVELS))
        stance = "DEFENSIVE" if offense <= 35 else "OFFENSIVE" if offense >= 65 else "NEUTRAL"
        return ("NORMAL", "ok", *pi.round(6), self.labels[str(int(pi.argmax()))], *full.round(6), *(round(v, 6) for v in values), round(offense, 4), stance)

    @staticmethod
    def blank(mode: str, reason: str, pi: list[float], state: str | None) -> tuple:
        """Blocked weeks have no distribution, degraded ones a zero one; both have the neutral score."""
        number = 0.0 if mode == "DEGRADED" else None
        return (mode, reason, *pi, state, *[number] * 10, 50.0, "NEUTRAL")


def inferred(rows: DataFrame, scaled: list[str], files: DataFrame, first: DataFrame) -> DataFrame:
    """WEEKLY of each series from its stored files (series_id, file, text): all weeks of rows (series_id, week, scaled) from
    first (series_id, first) on, each from the LONGEST weeks up to it. A series without files is blocked."""
    dealt = rows.join(first, "series_id").select("series_id", "week", *scaled, "first")

    def infer(key: tuple, pdf: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week").reset_index(drop=True)
        columns = [c.split(" ")[0] for c in WEEKLY.split(", ")]
        if pdf.empty:
            return pd.DataFrame(columns=columns)
        artifact = Artifact(dict(zip(files["file"], files["text"], strict=True)))
        x = pdf[scaled].to_numpy(float)
        asked = np.flatnonzero(pdf["week"] >= pdf["first"].iloc[0])
        return pd.DataFrame([(key[0], pdf["week"].iloc[i], *artifact.week(x[max(0, i + 1 - LONGEST) : i + 1])) for i in asked], columns=columns)

    return dealt.groupBy("series_id").cogroup(files.select("series_id", "file", "text").groupBy("series_id")).applyInPandas(infer, WEEKLY)
