"""Backtest metrics, gates and block bootstraps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Constants of a linear congruential generator (modulus 2**31).
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 1 << 31


def certainty_equivalent(r: str) -> Column:
    return 52 * (F.avg(r) - 0.5 * F.coalesce(F.var_samp(r), F.lit(0.0)))


def turnover(df: DataFrame, score: str, keys: list[str], order: str) -> DataFrame:
    moved = df.withColumn("move", F.abs(F.col(score) - F.lag(score).over(Window.partitionBy(*keys).orderBy(order))))
    return moved.groupBy(*keys).agg((52 * F.avg("move") / 100).alias("turnover"))


def gates(metrics: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """metrics of one row -> (gate, observed, passed) of each rule (name, observed, condition). A missing value fails."""
    rows = [F.struct(F.lit(name).alias("gate"), seen.cast("double").alias("observed"), F.coalesce(ok, F.lit(False)).alias("passed")) for name, seen, ok in rules]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.gate", "g.observed", "g.passed")


def jumps(spark: SparkSession, n: int) -> DataFrame:
    """(pos, a1, c1, a2, c2) of n positions: the generator's states 2 * pos + 1 and 2 * pos + 2 are a * start + c."""
    rows, a, c = [], 1, 0
    for pos in range(n):
        row = [pos]
        for _ in range(2):
            a, c = a * LCG_A % LCG_M, (c * LCG_A + LCG_C) % LCG_M
            row += [a, c]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, "pos bigint, a1 bigint, c1 bigint, a2 bigint, c2 bigint")


def index_streams(sizes: DataFrame, keys: list[str], reps: int, lengths: list[int], seed: int) -> DataFrame:
    """(keys, block_length, rep, pos, idx): stationary blocks of each mean length over the n circular positions of each row
    of sizes (keys, n). Two draws belong to each position, computed from the replication's start without those before; an
    index counts on from the last position where a block began. sizes has a row per series, n is its weeks."""
    longest = sizes.agg(F.max("n")).first()[0] or 0
    rows = sizes.select(*keys, "n", F.explode(F.array(*map(F.lit, lengths))).alias("block_length")).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).join(F.broadcast(jumps(sizes.sparkSession, longest)), "pos")
    start = F.pmod(F.lit(seed) + F.col("rep") * 7919, F.lit(LCG_M))
    draw = lambda k: F.pmod(F.pmod(F.col(f"a{k}") * start, F.lit(LCG_M)) + F.col(f"c{k}"), F.lit(LCG_M))
    fresh = F.when((F.col("pos") == 0) | (draw(1) * F.col("block_length") < LCG_M), F.struct("pos", F.floor(draw(2) * F.col("n") / LCG_M).alias("i")))
    w = Window.partitionBy(*keys, "block_length", "rep").orderBy("pos")
    begun = rows.withColumn("b", F.last(fresh, ignorenulls=True).over(w))
    return begun.select(*keys, "block_length", "rep", "pos", F.pmod(F.col("b.i") + F.col("pos") - F.col("b.pos"), F.col("n")).cast("bigint").alias("idx"))


def moving_blocks(sizes: DataFrame, reps: int, length: int, seed: int) -> DataFrame:
    """(keys, rep, pos, idx) for each row of sizes (keys, n): blocks of fixed length from starts 0..n - length, cut at n rows."""
    start = F.pmod((F.lit(seed) + F.col("rep") * 7919 + F.col("block") * 104729) * LCG_A + LCG_C, F.lit(LCG_M))
    rows = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))))
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, (n + {length - 1}) div {length} - 1)")))
    rows = rows.withColumn("start", F.floor(start * (F.col("n") - length + 1) / LCG_M)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    placed = rows.withColumn("pos", F.col("block") * length + F.col("k")).withColumn("idx", F.col("start") + F.col("k"))
    return placed.where(F.col("pos") < F.col("n")).drop("n", "block", "start", "k")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
