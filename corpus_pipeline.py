"""A training-corpus pipeline over `documents`: STAGES in order, each writing what the next one reads.

Every stage judges rows, not ids. A null doc_id is a document that is equal to none; rows that share a doc_id are
documents of their own unless their texts are equal too. Columns other than those of `documents` go in the first stage,
so their names can't clash. Very long texts are read whole; empty tables pass through as empty ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, minhash, sentencepiece_np, suffixes
from tidemark.llm.store import read, remove, scope, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least posterior probability of a document's language.
SURE = 0.5
#: No stage can be stated in SQL as a whole.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language, which lang names from here on. Null, empty, letterless and doubtful texts go;
    where no row has a language to learn from, all go. Repeated rows and null ids are judged each."""
    named = langid.annotated(docs.select(*COLUMNS), COLUMNS)
    kept = named.where((F.col("lang_pred") != langid.NONE) & (F.col("score") >= SURE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (shingles of five words, similarity 0.8 or more): that of least doc_id.
    Texts without words and rows with a null doc_id stay. Rows equal in doc_id and text are one document: the least of the
    other columns stays. Rows of the group's least doc_id with other texts stay too, as none is less than the other."""
    rows = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept and doc_id is not null").select("doc_id", "text_key").distinct()
    rest = F.struct("lang", "source", "n_chars")
    named = rows.join(kept, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.min(rest).alias("rest"))
    return named.select("doc_id", "text", "rest.*").unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document of smaller doc_id has; texts of which nothing is left go, and
    characters that a cut has broken. A null text becomes nothing and goes; rows with a null doc_id keep their text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or b"").decode("utf-8", "ignore") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], names=["doc_id", "text", "lang", "source"])

    cut = suffixes.repeated_bytes(docs, window=50, keep=["lang", "source"]).select("doc_id", "kept", "rest.*")
    texts = cut.mapInArrow(decode, "doc_id bigint, text string, lang string, source string")
    return texts.where(F.trim("text") != "").select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of every benchmark item, judged row by row; null and empty texts hold nothing."""
    return decontaminate.without_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), least=3, share=0.5)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip of each row; a null text is encoded as an empty one."""
    return sentencepiece_np.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_free),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written to the shared folder and read again. What a stage has read, and its operator's
    own tables, go once it is written; the last written stage stays, since the result reads it."""
    docs, before = read(spark, sf_dir, "documents"), None
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{root}/{k}-{name}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
