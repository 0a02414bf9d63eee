"""How fits are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASKS = 128


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in partitions of a given number. Rows to be fitted are few and take long: adaptive execution, which goes by
    size, would merge all their groups into one task; a number that was asked for stays."""
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
