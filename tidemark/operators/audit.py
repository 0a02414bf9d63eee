"""Where a chain of values first breaks, counted in the pass that computes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def broken(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def observed(rows: DataFrame, stages: list[str]) -> tuple[DataFrame, Observation]:
    """rows with first_bad (from 1; null where all stages are finite), and the counts of rows (rows) and of values that aren't
    finite (the stages' names), known once an action has read the rows: no pass of its own."""
    first = F.coalesce(*[F.when(broken(F.col(s)), F.lit(i)) for i, s in enumerate(stages, 1)])
    seen = Observation("stages")
    marked = rows.withColumn("first_bad", first)
    return marked.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(broken(F.col(s))).alias(s) for s in stages]), seen


def breaks(marked: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, stage, order, n_rows: each key's rows by the stage at which they first break (null: none), and the first of them."""
    return marked.groupBy(*keys, F.col("first_bad").alias("stage")).agg(F.min(order).alias(order), F.count("*").alias("n_rows"))
