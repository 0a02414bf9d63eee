"""Reading inputs and cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of this process if Spark is local, as in tests; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Folders made inside the innermost `scope`, if there is one.
_made: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession):
    """The scratch tables that operators write inside go when it ends: by then their results must be written elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


class Scratch:
    """Tables written to the shared folder during one operator call; drop() removes those no longer read. What a returned
    DataFrame still reads stays until the enclosing scope ends, or for the owner of the folder to remove."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _made:
            _made[-1].append(self.root)

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path), path

    def cut(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str | None = None) -> None:
        """One table, or all."""
        remove(self.spark, path or self.root)


def id_and_text(docs: DataFrame) -> list[Column]:
    """doc_id and text, as bigint and string. Columns that are so already get no alias, so that equal plans over them stay
    equal and share their exchanges."""
    kinds = dict(docs.dtypes)
    wanted = {"doc_id": "bigint", "text": "string"}
    return [F.col(c) if kinds[c] == k else F.col(c).cast(k).alias(c) for c, k in wanted.items()]
