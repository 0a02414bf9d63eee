"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of bytes, with thresholds by language.

The model has order 5 and is trained on trusted texts: all labelled documents of good quality. Documents are dealt once
into parts of about PART bytes by a hash of doc_id; three steps read that dealing.

1. Counts. Each part counts the five-grams abcde of its trusted documents and sends them by the middle pair cd to GROUPS
   shards, where they are added. Orders 5, 4 and 3 (contexts abcd, bcd and cd, and the continuation counts) need a
   shard's own rows only; order 2 needs the table of pairs de, which has at most 65,536 entries, and travels to each
   shard with the discounts.
2. Count join. Each part asks the shards for the log probability of its distinct five-grams, packed, once each however
   often its documents have them. A shard that is asked by many parts is salted: its counts are small beside what asks.
3. Scores. The answers come back to their part, whose documents add them up.

One trusted document in HELD, by a hash of doc_id, is held out: the counts never see it. A document is kept if its mean log
perplexity lies between two quantiles for its language, widened by SLACK: the upper one is that of the held-out documents,
as unseen good texts are less likely under the model than the counted ones; the lower one is the least of either kind's.
Languages with fewer than ENOUGH held-out documents, and null, use the quantiles over all languages; if none is held out,
those of the documents counted.

Nulls: null and empty texts have no perplexity and are not kept. Without any trusted text nothing is known and every
text is kept. A null doc_id is scored as any, and trusted by none. A doc_id labelled twice is trusted if any label is
good. Repeated rows are scored each, and counted each where they are trusted; very long texts are read whole, piece by
piece; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytesnp as B
from tidemark.llm.store import Scratch

ORDER, GROUPS = 5, 64
#: Text bytes of a part, and of all parts that ask one copy of a shard.
PART, ASKERS = 24 << 20, 64 << 30
LOW, HIGH, SLACK = 0.002, 0.995, 0.1
#: Of so many trusted documents one is held out.
HELD = 5
#: Held-out documents that a language needs for thresholds of its own.
ENOUGH = 10
#: Resolution of quantiles, in nats.
STEP = 1 / 512
PAD = 2
U = np.uint64


def grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Five-grams that end at each byte, in 40 bits; pad bytes precede each row."""
    n = len(off) - 1
    before = (ORDER - 1) * (np.repeat(np.arange(n), np.diff(off)) + 1)
    x = np.full(len(buf) + (ORDER - 1) * n, PAD, np.uint8)
    at = np.arange(len(buf)) + before
    x[at] = buf
    key = np.zeros(len(buf), U)
    for k in range(ORDER - 1, -1, -1):
        key = (key << U(8)) | x[at - k]
    return key


def group_of(key: np.ndarray) -> np.ndarray:
    pair = ((key >> U(8)) & U(0xFFFF)).astype(np.uint32)
    return ((pair * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.int64)


def by_group(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then key (keys are in order); and where each group begins."""
    g = group_of(key)
    order = np.argsort(g, kind="stable")
    return order, np.searchsorted(g[order], np.arange(GROUPS + 1))


def coded(key: np.ndarray) -> bytes:
    """Ascending keys as the planes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(key, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ORDER].T).tobytes()


def decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(ORDER, -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, :ORDER] = planes.T
    return np.cumsum(x.view("<u8")[:, 0], dtype=U)


def chunks(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of the table's texts: first row, last row + 1, bytes, offsets."""
    row = 0
    for batch in table.to_batches():
        for i, j, b, o in B.pieces(*B.column(batch, "text")):
            yield row + i, row + j, b, o
        row += batch.num_rows


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


COUNTS = "g int, keys binary, counts binary"


def count(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """A part's documents and trusted ids: counts of the trusted documents' grams by group."""
    docs = docs.filter(pc.is_in(docs["doc_id"], value_set=trusted["doc_id"].combine_chunks().drop_null()))
    found = [np.unique(grams(b, o), return_counts=True) for _, _, b, o in chunks(docs)]
    key, n = added([f[0] for f in found], [f[1] for f in found])
    order, at = by_group(key)
    rows = [(g, coded(key[order[a:z]]), n[order[a:z]].tobytes()) for g, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), B.binaries([r[1] for r in rows]), B.binaries([r[2] for r in rows])], names=["g", "keys", "counts"])


def runs_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that come together by the columns names, as they stream."""
    from itertools import groupby

    rows = (x for batch in batches for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist())
    yield from groupby(rows, lambda x: tuple(x[n] for n in names))


def spectrum(c: np.ndarray) -> np.ndarray:
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)], np.int64)


def lower(key: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of n_bytes of distinct keys, and how many keys have each."""
    return np.unique(key & U((1 << 8 * n_bytes) - 1), return_counts=True)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's counts, and what all shards need to know of it: spectra of orders 5, 4 and 3, and kinds of pairs."""
    for (g,), rows in runs_of(batches, "g"):
        keys, counts = [], []
        for x in rows:
            keys.append(decoded(x["keys"]))
            counts.append(np.frombuffer(x["counts"], np.int64))
            if len(keys) >= 64:
                keys, counts = ([v] for v in added(keys, counts))
        key, n = added(keys, counts)
        four, n4 = lower(key, 4)
        three, n3 = lower(four, 3)
        pairs = np.bincount((three & U(0xFFFF)).astype(np.int64), minlength=65536)
        facts = np.concatenate([spectrum(n), spectrum(n4), spectrum(n3), pairs])
        yield pa.record_batch([pa.array([g], pa.int32()), B.binaries([coded(key)]), B.binaries([n.tobytes()]), B.binaries([facts.tobytes()])], names=["g", "keys", "counts", "facts"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(12 + 65536, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.frombuffer(x.as_py(), np.int64)
    yield pa.record_batch([B.binaries([total.tobytes()])], names=["facts"])


def discounts(n: np.ndarray) -> np.ndarray:
    """For counts 0, 1, 2, 3 and more."""
    n = np.maximum(n.astype(float), 1e-9)
    if min(n) < 0.5:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0] + [float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05, k - 0.05)) for k in (1, 2, 3)])


class Level:
    """One order of a shard: discounted probabilities interpolated with the order below, and contexts' backoff weights."""

    def __init__(self, order: int, key: np.ndarray, n: np.ndarray, d: np.ndarray, below):
        self.mask, self.key, self.below = U((1 << 8 * order) - 1), key, below
        context = key >> U(8)
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.context = context[begin]
        off = d[np.minimum(n, 3)]
        total = np.add.reduceat(n, begin) if len(key) else np.zeros(0)
        self.back = np.add.reduceat(off, begin) / total if len(key) else np.zeros(0)
        size = np.diff(np.append(begin, len(key)))
        self.p = (n - off) / np.repeat(total, size) + np.repeat(self.back, size) * below(key)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Probability of the last byte of each key (of any length of at least this order) after those before it."""
        key = key & self.mask
        at, ok = find(self.key, key)
        out = np.empty(len(key))
        out[ok] = self.p[at[ok]]
        rest = key[~ok]
        at, known = find(self.context, rest >> U(8))
        weight = np.ones(len(rest))
        weight[known] = self.back[at[known]]
        out[~ok] = weight * self.below(rest)
        return out


def find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return at, table[at] == x if len(table) else np.zeros(len(x), bool)


def pair_level(facts: np.ndarray):
    """Order 2 from the kinds of each pair, over order 1 from the kinds of pairs that end with each byte, smoothed to all bytes."""
    one = facts[12:].reshape(256, 256)
    by_last = (one > 0).sum(axis=0)
    p1 = (by_last + 0.5) / (by_last.sum() + 128)
    d = discounts(spectrum(one[one > 0]))
    total, off = one.sum(axis=1, keepdims=True), d[np.minimum(one, 3)]
    with np.errstate(invalid="ignore", divide="ignore"):
        p2 = np.where(total > 0, (one - off) / total + off.sum(axis=1, keepdims=True) / total * p1, p1).ravel()
    return lambda key: p2[(key & U(0xFFFF)).astype(np.int64)]


def shard_model(key: np.ndarray, n: np.ndarray, facts: np.ndarray) -> Level:
    four, n4 = lower(key, 4)
    three, n3 = lower(four, 3)
    below = pair_level(facts)
    for order, (k, c) in ((3, (three, n3)), (4, (four, n4)), (5, (key, n))):
        below = Level(order, k, c, discounts(facts[4 * (5 - order) : 4 * (6 - order)]), below)
    return below


ASKS = "g int, part int, keys binary"


def ask(docs: pa.Table) -> pa.Table:
    """A part's distinct grams by group."""
    key = distinct(docs)
    order, at = by_group(key)
    rows = [(g, coded(key[order[a:z]])) for g, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([docs["part"][0].as_py()] * len(rows), pa.int32()), B.binaries([r[1] for r in rows])], names=["g", "part", "keys"])


def distinct(docs: pa.Table) -> np.ndarray:
    key = np.zeros(0, U)
    held: list[np.ndarray] = []
    for _, _, b, o in chunks(docs):
        held.append(np.unique(grams(b, o)))
        if len(held) >= 8:
            key, held = np.unique(np.concatenate([key, *held])), []
    return np.unique(np.concatenate([key, *held]))


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each copy of a shard: the facts of all shards, its counts (if it has any), then the parts that ask."""
    for _, rows in runs_of(batches, "g", "salt"):
        facts, key, n, model = np.zeros(12 + 65536, np.int64), np.zeros(0, U), np.zeros(0, np.int64), None
        for x in rows:
            if x["kind"] == 0:
                facts = np.frombuffer(x["a"], np.int64)
            elif x["kind"] == 1:
                key, n = decoded(x["a"]), np.frombuffer(x["b"], np.int64)
            else:
                model = model or shard_model(key, n, facts)
                logp = np.log(model(decoded(x["a"]))).astype(np.float32)
                yield pa.record_batch([pa.array([x["part"]], pa.int32()), pa.array([x["g"]], pa.int32()), B.binaries([logp.tobytes()])], names=["part", "g", "logp"])


def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Bytes and summed log probability of each of a part's documents."""
    total, size = np.zeros(docs.num_rows), np.zeros(docs.num_rows, np.int64)
    key = distinct(docs)
    order, _ = by_group(key)
    logp = np.zeros(len(key))
    if len(key):
        given = answers.sort_by("g")["logp"].to_pylist()
        logp[order] = np.concatenate([np.frombuffer(x, np.float32) for x in given])
    for i, j, b, o in chunks(docs):
        size[i:j] = np.diff(o)
        if len(b):
            name, back = np.unique(grams(b, o), return_inverse=True)
            sums = np.concatenate([[0], np.cumsum(logp[np.searchsorted(key, name)][back])])
            total[i:j] = sums[o[1:]] - sums[o[:-1]]
    return pa.table([docs["doc_id"], docs["lang"], pa.array(size), pa.array(total)], names=["doc_id", "lang", "n", "total"])


def scored(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, n, total) of each row: its bytes and the log probability of all of them under the trusted documents' model."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    salts = -(-size // ASKERS) or 1
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    dealt = rows.withColumn("part", F.pmod(F.coalesce(own, F.xxhash64("text")), F.lit(parts)).cast("int")).repartition(parts, "part")  # read three times below, dealt once
    known = trusted.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")).repartition(parts, "part")
    counts = dealt.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(count, COUNTS)
    model = counts.repartition(GROUPS, "g").sortWithinPartitions("g").mapInArrow(_add, COUNTS + ", facts binary")
    facts = model.select("facts").repartition(1).mapInArrow(_total, "facts binary")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    shards = F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1)))
    none = F.lit(None).cast("binary")
    told = facts.select(shards.alias("g"), F.col("facts").alias("a")).select("g", copies.alias("salt"), F.lit(0).alias("kind"), F.lit(-1).alias("part"), "a", none.alias("b"))
    held = model.select("g", copies.alias("salt"), F.lit(1).alias("kind"), F.lit(-1).alias("part"), F.col("keys").alias("a"), F.col("counts").alias("b"))
    asks = dealt.groupBy("part").applyInArrow(ask, ASKS)
    asked = asks.select("g", F.pmod("part", F.lit(salts)).alias("salt"), F.lit(2).alias("kind"), "part", F.col("keys").alias("a"), none.alias("b"))
    meet = told.unionByName(held).unionByName(asked).repartition(GROUPS * salts, "g", "salt").sortWithinPartitions("g", "salt", "kind", "part")
    answers = meet.mapInArrow(_answer, "part int, g int, logp binary").repartition(parts, "part")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, n bigint, total double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, low, high, keep, held_out). held_out: trusted, but not counted."""
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    trusted = labels.where("doc_id is not null and quality > 0").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    trusted = trusted.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0)
    rows = scored(docs, trusted.where("not held")).select("doc_id", "lang", "n", F.when(F.col("n") > 0, -F.col("total") / F.col("n")).alias("nats"))
    judged = scratch.cut(rows.join(trusted, "doc_id", "left"))
    known = judged.where("nats is not null and held is not null").withColumn("slot", F.floor(F.col("nats") / STEP))
    histogram = known.groupBy("held", "lang", "slot").agg(F.count("*").alias("k"))
    general = histogram.groupBy("held", "slot").agg(F.sum("k").alias("k")).select("held", F.lit(None).cast("string").alias("lang"), "slot", "k")
    run = Window.partitionBy("held", "lang").orderBy("slot")
    upto = histogram.where("lang is not null").unionByName(general)
    upto = upto.withColumn("below", F.sum("k").over(run)).withColumn("all", F.sum("k").over(Window.partitionBy("held", "lang")))
    limits = upto.groupBy("lang", "held").agg(F.max("all").alias("n"), F.min(F.when(F.col("below") >= LOW * F.col("all"), F.col("slot"))).alias("a"), F.min(F.when(F.col("below") >= HIGH * F.col("all"), F.col("slot"))).alias("b"))
    limits = limits.groupBy("lang").agg(F.sum(F.when(F.col("held"), F.col("n"))).alias("n_held"), (F.min("a") * STEP - SLACK).alias("low"), ((F.max_by("b", "held") + 1) * STEP + SLACK).alias("high"))
    own = limits.where(f"lang is not null and n_held >= {ENOUGH}").select("lang", "low", "high")
    one = limits.where("lang is null").select(F.col("low").alias("low_all"), F.col("high").alias("high_all"))
    ranged = judged.join(own, "lang", "left").join(F.broadcast(one), F.lit(True), "left")
    low, high = F.coalesce("low", "low_all"), F.coalesce("high", "high_all")
    keep = F.col("nats").isNotNull() & F.coalesce(F.col("nats").between(low, high), F.lit(True))
    held = F.coalesce("held", F.lit(False)).alias("held_out")
    return ranged.select("doc_id", "lang", F.col("n").alias("n_bytes"), F.exp("nats").alias("perplexity"), F.exp(low).alias("low"), F.exp(high).alias("high"), keep.alias("keep"), held)
