"""Posteriors of a latent state model along each series, by a scan over blocks of weeks.

A week is a matrix: what leads into it from each state, times how well each state explains it. Products of matrices are
associative, so blocks of weeks are multiplied side by side, a short pass over the blocks' products gives each block what
comes before and after it, and the blocks are then filled in side by side. No series is folded row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: Weeks of a block.
BLOCK = 256
FILTERED, SMOOTHED = [f"f{k}" for k in (1, 2, 3)], [f"s{k}" for k in (1, 2, 3)]
PAIRS = [f"x{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
CELLS = [f"m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


def scaled(m: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum(m.max(axis=(1, 2)), 1e-300)
    return m / top[:, None, None], log + np.log(top)


def prefix_products(m: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """m[0], m[0] m[1], ...: each as a matrix of largest cell 1 and a logarithm. Doubles the length at each step."""
    m, log = scaled(m, log)
    d = 1
    while d < len(m):
        new, new_log = scaled(m[:-d] @ m[d:], log[:-d] + log[d:])
        m, log = np.concatenate([m[:d], new]), np.concatenate([log[:d], new_log])
        d *= 2
    return m, log


def suffix_products(m: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, logs = prefix_products(m[::-1].transpose(0, 2, 1), log[::-1])
    return out[::-1].transpose(0, 2, 1), logs[::-1]


def matrices(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[CELLS].to_numpy(float).reshape(-1, K, K)


def block_product(pdf: pd.DataFrame) -> tuple[np.ndarray, float]:
    m, log = prefix_products(matrices(pdf), pdf["top"].to_numpy(float))
    return m[-1], float(log[-1])


def around_blocks(m: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block the state vector before it, its logarithm, and the vector after it. The first matrix holds the start."""
    ahead, ahead_log = prefix_products(m, log)
    behind, _ = suffix_products(m, np.zeros(len(m)))
    before = np.vstack([np.ones(K) / K, ahead[:-1].sum(axis=1) / K])
    after = np.vstack([behind[1:].sum(axis=2), np.ones(K)])
    total = before.sum(axis=1)
    return before / total[:, None], np.r_[0.0, ahead_log[:-1] + np.log(total[1:])], after / after.sum(axis=1, keepdims=True)


def filled(m: np.ndarray, top: np.ndarray, before: np.ndarray, log: float, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Filtered and smoothed states, pairs (state before, state) and log likelihood up to each week of one block."""
    ahead, ahead_log = prefix_products(m, top)
    f = before @ ahead
    total = f.sum(axis=1)
    f /= total[:, None]
    behind, _ = suffix_products(m, np.zeros(len(m)))
    b = np.vstack([behind[1:] @ after, after])
    b /= b.sum(axis=1, keepdims=True)
    s = f * b
    pairs = np.vstack([before, f[:-1]])[:, :, None] * m * b[:, None, :]
    return f, s / s.sum(axis=1, keepdims=True), pairs / pairs.sum(axis=(1, 2), keepdims=True), log + ahead_log + np.log(total)


def posteriors(rows: DataFrame, key: str, order: str, log_emit: list[Column], into: list[Column], block: int = BLOCK) -> DataFrame:
    """key, order, FILTERED, SMOOTHED, PAIRS (null in a series' first week), loglik. log_emit: by state; into: the nine
    probabilities that lead into a week from the week before; a series starts with equal probabilities."""
    w = Window.partitionBy(key).orderBy(order)
    place = F.row_number().over(w) - 1
    top = F.greatest(*log_emit)
    first = F.col("place") == 0
    cells = [F.when(first, 1.0 / K).otherwise(into[K * i + j]) * F.exp(log_emit[j] - top) for i in range(K) for j in range(K)]
    steps = rows.withColumn("place", place).select(key, order, "place", F.expr(f"place div {block}").alias("block"), top.alias("top"), *[c.alias(n) for c, n in zip(cells, CELLS, strict=True)])

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        m, log = block_product(pdf.sort_values("place"))
        return pd.DataFrame([(pdf[key].iloc[0], pdf["block"].iloc[0], *m.ravel(), log)], columns=[key, "block", *CELLS, "top"])

    kind = dict(rows.dtypes)
    nine = ", ".join(f"{c} double" for c in CELLS)
    products = steps.groupBy(key, "block").applyInPandas(multiply, f"{key} {kind[key]}, block long, {nine}, top double")

    def surround(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        before, log, after = around_blocks(matrices(pdf), pdf["top"].to_numpy(float))
        return pd.DataFrame({key: pdf[key].to_numpy(), "block": pdf["block"].to_numpy(), "before": before.tolist(), "log": log, "after": after.tolist()})

    around = products.groupBy(key).applyInPandas(surround, f"{key} {kind[key]}, block long, before array<double>, log double, after array<double>")
    names = [*FILTERED, *SMOOTHED, *PAIRS, "loglik"]

    def fill(_, pdf: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        a = around.iloc[0]
        f, s, x, log = filled(matrices(pdf), pdf["top"].to_numpy(float), np.array(a["before"]), float(a["log"]), np.array(a["after"]))
        x = x.reshape(-1, K * K)
        x[pdf["place"].to_numpy() == 0] = np.nan
        return pd.concat([pdf[[key, order]].reset_index(drop=True), pd.DataFrame(np.column_stack([f, s, x, log]), columns=names)], axis=1)

    around = around.toDF(*around.columns)
    out = steps.groupBy(key, "block").cogroup(around.groupBy(key, "block")).applyInPandas(fill, f"{key} {kind[key]}, {order} {kind[order]}, " + ", ".join(f"{n} double" for n in names))
    return out.select(key, order, *FILTERED, *SMOOTHED, *[F.nanvl(x, F.lit(None).cast("double")).alias(x) for x in PAIRS], "loglik")
