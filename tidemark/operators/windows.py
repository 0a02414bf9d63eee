"""Rolling, expanding and stateful expressions along a series."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.scalar import Col, c

UP = Window.unboundedPreceding


def log_return(value: str, w: WindowSpec, k: int = 1) -> Column:
    before = F.lag(value, k).over(w)
    return F.when((before > 0) & (F.col(value) > 0), F.ln(value) - F.ln(before))


def rms(x: Col, w: WindowSpec, n: int, scale: float = 1.0) -> Column:
    """Root mean square of the last n rows, all present."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c(x)).over(frame) == n, F.sqrt(F.avg(c(x) * c(x)).over(frame) * scale))


def robust_z(df: DataFrame, x: str, keys: list[str], order: str = "week") -> DataFrame:
    """With med, mad and z: each row against the median and the re-centred MAD of the rows up to it. Each key's rows meet in
    one task, in which a row costs the square of the logarithm of their number."""

    def scaled(table: pa.Table) -> pa.Table:
        from tidemark.models.orderstats import expanding_median_mad

        table = table.sort_by(order)
        med, mad = (pa.array(v, from_pandas=True) for v in expanding_median_mad(table.column(x).to_pandas().to_numpy(float)))
        return table.append_column("med", med).append_column("mad", mad)

    schema = StructType([*df.schema.fields, StructField("med", DoubleType()), StructField("mad", DoubleType())])
    rows = df.groupBy(*keys).applyInArrow(scaled, schema)
    return rows.withColumn("z", (F.col(x) - F.col("med")) / (1.4826 * F.col("mad") + 1e-8))


def earlier_quantiles(x: str, levels: list[float], keys: list[str], order: str = "week") -> Column:
    """Quantiles of the rows before this one."""
    return F.percentile(x, F.array(*[F.lit(t) for t in levels])).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(UP, -1))


def islands(df: DataFrame, state: str, keys: list[str], order: str) -> DataFrame:
    """With run (number of the island) and dwell (rows so far in it)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    runs = df.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w.rowsBetween(UP, 0)))
    return runs.withColumn("dwell", F.row_number().over(Window.partitionBy(*keys, "run").orderBy(order))).drop("changed")


def hysteresis(df: DataFrame, raw: str, keys: list[str], order: str, start: float = 50.0, band: float = 7.0) -> DataFrame:
    """final: the score before, unless the raw one differs by the band or more. One fold over each key's sorted rows."""
    rows = F.array_sort(F.collect_list(F.struct(order, raw)))
    zero = F.array().cast(f"array<struct<at:{dict(df.dtypes)[order]},raw:double,final:double>>")

    def step(acc: Column, x: Column) -> Column:
        before = F.when(F.size(acc) == 0, F.lit(start)).otherwise(F.get(acc, F.size(acc) - 1)["final"])
        return F.concat(acc, F.array(F.struct(x[order].alias("at"), x[raw].cast("double").alias("raw"), F.when(F.abs(x[raw] - before) < band, before).otherwise(x[raw].cast("double")).alias("final"))))

    folded = df.groupBy(*keys).agg(F.aggregate(rows, zero, step).alias("path"))
    return folded.select(*keys, F.explode("path").alias("p")).select(*keys, F.col("p.at").alias(order), F.col("p.raw").alias(raw), F.col("p.final").alias("final"))


def drawdown(log_return_: str, keys: list[str], order: str, df: DataFrame) -> DataFrame:
    """Largest loss from a running peak of the cumulated log returns, by keys; the start counts as a peak of 1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(UP, 0)
    wealth = df.withColumn("wealth", F.exp(F.sum(log_return_).over(w)))
    peak = wealth.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    return peak.groupBy(*keys).agg(F.max(1 - F.col("wealth") / F.col("peak")).alias("max_drawdown"))
