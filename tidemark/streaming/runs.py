"""Streams over tables: parts arrive one after another, and each part is a run that goes on from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.scratch import Folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(spark: SparkSession, parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What `transform` of a stream puts out when `parts` arrive in turn. Every run but the first is a restart."""
    tmp = Folder(spark, name)
    source, sink, checkpoint = tmp.path(), tmp.path(), tmp.path()
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        for part in parts:
            part.write.mode("append").parquet(source)
            stream = transform(spark.readStream.schema(part.schema).parquet(source))
            stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.parquet(sink)
