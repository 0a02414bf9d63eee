"""Medians, shrunk covariances and components of labelled vectors, from sums that merge.

No label's rows meet in a task: batches are reduced to counts and matrices, which Spark adds up. Exact medians are found
digit by digit of the values' bits, each pass counting one digit of the values that agree with what is known so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import Folder

DIGIT = 16


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of doubles."""
    bits = np.ascontiguousarray(x + 0.0, np.float64).view(np.uint64)  # + 0.0: no negative zero
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def doubles(bits: np.ndarray) -> np.ndarray:
    high = bits >> np.uint64(63)
    return np.where(high, bits ^ np.uint64(1 << 63), ~bits).view(np.float64)


def vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    rows = batch.column(batch.schema.get_field_index(name))
    return np.asarray(rows.flatten(), float).reshape(batch.num_rows, -1)


def of_label(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, int]]:
    """Each label of a batch with its rows and the first of them."""
    label = np.asarray(batch.column(batch.schema.get_field_index("label")))
    for k in np.unique(label):
        own = np.flatnonzero(label == k)
        yield int(k), own, int(own[0])


COUNTS = "label int, dim int, side int, digit int, n long"


def counting(shift: int, later: bool):
    """Counts one digit of the values that agree with the digits found before, for either middle value."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = ordered_bits(vectors(batch, "x"))
            for label, own, at in of_label(batch, "x"):
                digit = ((bits[own] >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                dim = np.broadcast_to(np.arange(bits.shape[1]), digit.shape)
                for side in (0, 1):
                    keep = np.ones(digit.shape, bool)
                    if later:
                        found = np.array(batch.column(batch.schema.get_field_index(f"found{side}"))[at].as_py(), np.int64).view(np.uint64)
                        keep = bits[own] >> np.uint64(shift + DIGIT) == found
                    seen, n = np.unique((dim << DIGIT | digit)[keep], return_counts=True)
                    cols = [np.full(len(seen), label), seen >> DIGIT, np.full(len(seen), side), seen & ((1 << DIGIT) - 1)]
                    yield pa.record_batch([*[pa.array(c, pa.int32()) for c in cols], pa.array(n, pa.int64())], names=["label", "dim", "side", "digit", "n"])

    return count


def narrowed(counts: DataFrame) -> DataFrame:
    """(label, dim, side, found, k) with the next digit of each middle value; k: its place among the values still in question."""
    one = Window.partitionBy("label", "dim", "side")
    upto = F.sum("n").over(one.orderBy("digit"))
    middle = F.expr("(total - 1 + side) div 2")
    rows = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(one)).withColumn("k", F.coalesce("k", middle))
    hit = rows.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
    found = F.shiftleft(F.coalesce("found", F.lit(0).cast("bigint")), DIGIT).bitwiseOR(F.col("digit"))
    return hit.select("label", "dim", "side", found.alias("found"), (F.col("k") - F.col("upto") + F.col("n")).alias("k"))


def both_sides(known: DataFrame) -> DataFrame:
    """(label, found0, found1): the digits found of both middle values, by dimension."""
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("dim", "found")))), lambda s: s["found"]).alias(f"found{k}")
    return known.groupBy("label").agg(side(0), side(1))


def medians(rows: DataFrame, tmp: Folder) -> DataFrame:
    """rows (label, x: array) -> (label, centre: array): the median of each dimension, the mean of the two middle ones where
    rows are even in number."""
    known = None
    nothing = F.lit(None).cast("bigint")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        dealt = rows.select("label", "x")
        if known is not None:
            dealt = dealt.join(both_sides(known), "label")
        counts = dealt.mapInArrow(counting(shift, known is not None), COUNTS).groupBy("label", "dim", "side", "digit").agg(F.sum("n").alias("n"))
        before = counts.join(known, ["label", "dim", "side"]) if known is not None else counts.withColumns({"found": nothing, "k": nothing})
        known = tmp.cut(narrowed(before))

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            middle = [[doubles(np.asarray(r[c], np.int64).view(np.uint64)) for c in ("found0", "found1")] for _, r in pdf.iterrows()]
            yield pd.DataFrame({"label": pdf["label"], "centre": [((low + high) / 2).tolist() for low, high in middle]})

    return both_sides(known).mapInPandas(values, "label int, centre array<double>")


SUMS = "label int, kind int, i int, j int, s double"
#: Kinds of sums: w x_i x_j, w^2 x_i x_j, and w, w^2, w^2 |x|^4 as i = 0, 1, 2.
GRAM, SQUARED, SCALARS = 0, 1, 2


def sums(rows: DataFrame) -> DataFrame:
    """rows (label, w, x, centre) -> SUMS of the centred vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch, "x") - vectors(batch, "centre")
            w = np.asarray(batch.column(batch.schema.get_field_index("w")), float)
            for label, own, _ in of_label(batch, "x"):
                v, u = x[own], w[own, None]
                i, j = np.indices((v.shape[1], v.shape[1]))
                norm = (v**2).sum(axis=1)
                scalars = [u.sum(), (u**2).sum(), ((u[:, 0] * norm) ** 2).sum()]
                n = i.size
                kind = np.repeat([GRAM, SQUARED, SCALARS], [n, n, 3])
                ii, jj = np.concatenate([i.ravel(), i.ravel(), np.arange(3)]), np.concatenate([j.ravel(), j.ravel(), np.zeros(3, int)])
                s = np.concatenate([((v * u).T @ v).ravel(), ((v * u * u).T @ v).ravel(), scalars])
                yield pa.record_batch([pa.array(np.full(len(s), label), pa.int32()), *[pa.array(a, pa.int32()) for a in (kind, ii, jj)], pa.array(s)], names=["label", "kind", "i", "j", "s"])

    return rows.select("label", "w", "x", "centre").mapInArrow(add, SUMS).groupBy("label", "kind", "i", "j").agg(F.sum("s").alias("s"))


def shrunk(pdf: pd.DataFrame) -> np.ndarray:
    """The covariance shrunk to its diagonal by the share of noise in the rest, from one label's SUMS."""
    d = int(pdf.loc[pdf["kind"] == GRAM, "i"].max()) + 1
    matrix = lambda kind: pdf[pdf["kind"] == kind].sort_values(["i", "j"])["s"].to_numpy(float).reshape(d, d)
    total, squares, fourth = pdf[pdf["kind"] == SCALARS].sort_values("i")["s"].to_numpy(float)
    cov = matrix(GRAM) / total
    target = np.diag(np.diag(cov))
    size = ((cov - target) ** 2).sum()
    if size == 0:
        return target
    noise = fourth - 2 * (matrix(SQUARED) * cov).sum() + squares * (cov**2).sum()
    share = min(1.0, max(0.0, noise / total**2 / size))
    return (1 - share) * cov + share * target


def covariances(rows: DataFrame) -> DataFrame:
    """(label, i, j, cov) of rows (label, w, x, centre), dimensions counted from 1. A label's own task has its sums only."""

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        c = shrunk(pdf)
        i, j = np.indices(c.shape)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "i": i.ravel() + 1, "j": j.ravel() + 1, "cov": c.ravel()})

    return sums(rows).groupBy("label").applyInPandas(cells, "label int, i int, j int, cov double")


def components(rows: DataFrame, tmp: Folder) -> DataFrame:
    """rows (label, x, others) with pc1 and pc2: scores on two components of each label's shrunk covariance about its medians."""
    from tidemark.models.pca import oriented

    centred = rows.join(tmp.cut(medians(rows, tmp)), "label").withColumn("w", F.lit(1.0))

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        top = oriented(shrunk(pdf))
        both = [top[:, k].tolist() if k < top.shape[1] else [0.0] * len(top) for k in (0, 1)]
        return pd.DataFrame([(pdf["label"].iloc[0], *both)], columns=["label", "v1", "v2"])

    found = tmp.cut(sums(centred).groupBy("label").applyInPandas(axes, "label int, v1 array<double>, v2 array<double>"))
    apart = F.zip_with("x", "centre", lambda a, b: a - b)
    score = lambda v: F.aggregate(F.zip_with(apart, v, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    return centred.join(found, "label").withColumn("pc1", score("v1")).withColumn("pc2", score("v2")).drop("centre", "w", "v1", "v2")
