"""Near-duplicate groups of documents: MinHash signatures, banding, exact verification, connected components.

1. Each document's set of word shingles is hashed once (64 bits); `permutations` universal hashes give its minima.
   Documents with equal sets become one class, so copies cost one row from here on.
2. Bands of minima make bucket keys. In a bucket every class is compared with the least one (its hub); pairs whose
   signatures agree too little are passed over, the others are confirmed on the full sets.
3. The links' components label the classes. Buckets that still hold several components travel once more, with texts,
   in blocks of bounded size (a large bucket as all pairs of its blocks). In its task a block searches from component
   to component: signatures pass pairs on, full sets confirm them, and a class that is reached is not compared with
   its own component again. It puts out only links that join components, so no list of partners is cut and no
   bucket's pairs are emitted.

Nulls: a null text is empty; a null doc_id is kept as a row without links. Empty or blank texts have no shingles and
link with nothing. Repeated doc_ids: every row has a result; rows with equal sets share a class as any others; links of
any of an id's texts are links of that id. Empty tables give empty results; other columns are ignored. Very long texts
are hashed whole, piece by piece of their batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesnp as B
from tidemark.llm.components import components
from tidemark.llm.store import Scratch, id_and_text

#: 32 bands of 5: a pair of similarity 0.8 shares no bucket with probability 3e-6.
BANDS, ROWS = 32, 5
#: How much less than the wanted similarity signatures may agree: five standard deviations.
SLACK = 0.16
#: Classes of a bucket that meet in one task at most, twice.
BLOCK = 1024
_rng = np.random.Generator(np.random.PCG64(7))
MUL = _rng.integers(0, 2**64 - 1, BANDS * ROWS, dtype=B.U) | B.U(1)
ADD = _rng.integers(0, 2**64 - 1, BANDS * ROWS, dtype=B.U)
BAND_MUL = _rng.integers(0, 2**64 - 1, (BANDS, ROWS), dtype=B.U) | B.U(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    for _, _, b, o in B.pieces(buf, off):
        start, end, first = B.words(b, o)
        h, at = B.shingles(B.spans_hash(B.prefix(b, B.FOLDED), start, end), first, k)
        for i in range(len(at) - 1):
            x = np.sort(h[at[i] : at[i + 1]])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def minima(x: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 2**64 - 1, B.U)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512, None] * MUL + ADD).min(axis=0), out=out)
    return out


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = B.column(batch, "text")
            n, low, high, sig, bands = [], [], [], [], []
            for x in shingle_sets(buf, off, k):
                n.append(len(x))
                low.append(int(x.sum(dtype=B.U).view(np.int64)))
                high.append(int(np.bitwise_xor.reduce(B.mix(x + B.U(1))).view(np.int64)) if len(x) else 0)
                if not len(x):
                    sig.append(None)
                    bands.append(None)
                    continue
                m = minima(x)
                sig.append((B.mix(m) & B.U(255)).astype(np.uint8).tobytes())
                keys = B.mix((m.reshape(BANDS, ROWS) * BAND_MUL).sum(axis=1, dtype=B.U) + np.arange(BANDS, dtype=B.U))
                bands.append(keys.view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), B.binaries(sig), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "tk", "n_shingles", "low", "high", "sig", "bands"])

    return B.released(run)


def _confirm(k: int, percent: int):
    """Of pairs with both texts: those with 100 * |intersection| >= percent * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            a, b = shingle_sets(*B.column(batch, "text_u"), k), shingle_sets(*B.column(batch, "text_v"), k)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both) > 0
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keep)], names=["u", "v", "linked"])

    return B.released(run)


def _alike(least: float):
    """Of pairs with both signatures: those that agree in at least that share of minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(B.column(batch, c)[0], np.uint8).reshape(-1, BANDS * ROWS) for c in ("sig_u", "sig_v"))
            yield batch.filter(pa.array((x == y).mean(axis=1) >= least)).select(["u", "tk_u", "v", "tk_v"])

    return run


def search(rep: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int, least: float) -> list[tuple[int, int]]:
    """Links that join the components of one block. Each pair of different components is compared until they are joined."""
    size = np.array([len(x) for x in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mask = np.zeros(int(local.max()) + 1 if len(local) else 1, bool)
    names, comp = np.unique(comp, return_inverse=True)
    largest_first = np.argsort(-np.bincount(comp, minlength=len(names)), kind="stable")
    waiting = np.ones(len(rep), bool)
    links = []
    for c in largest_first:
        queue = np.flatnonzero((comp == c) & waiting).tolist()
        waiting[queue] = False
        left = np.flatnonzero(waiting)
        while queue and len(left):
            i = queue.pop()
            near = left[(100 * np.minimum(size[left], size[i]) >= percent * np.maximum(size[left], size[i])) & ((sig[left] == sig[i]).mean(axis=1) >= least)]
            if not len(near):
                continue
            own = local[at[i] : at[i + 1]]
            mask[own] = True
            part = np.concatenate([local[at[j] : at[j + 1]] for j in near])
            both = np.add.reduceat(mask[part], np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
            mask[own] = False
            reached = near[100 * both >= percent * (size[near] + size[i] - both)]
            if len(reached):
                which, first = np.unique(comp[reached], return_index=True)
                links += [(int(rep[i]), int(rep[j])) for j in reached[first]]
                new = left[np.isin(comp[left], which)]
                queue += new.tolist()
                waiting[new] = False
                left = np.flatnonzero(waiting)
    return links


def _across(k: int, percent: int, least: float):
    """From rows of whole blocks in order: the links found between their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        name = None

        def flush() -> pa.RecordBatch:
            rep, comp, sig = (np.concatenate([h[j] for h in held]) for j in range(3))
            found = search(rep, comp, sig, [x for h in held for x in h[3]], percent, least)
            return pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, low, high, rep, comp = (batch.column(j).to_numpy() for j in range(5))
            sig = np.frombuffer(B.column(batch, "sig")[0], np.uint8).reshape(-1, BANDS * ROWS)
            sets = list(shingle_sets(*B.column(batch, "text"), k))
            new = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                this = (key[a], low[a], high[a])
                if held and name != this:
                    yield flush()
                    held = []
                name = this
                held.append((rep[a:z], comp[a:z], sig[a:z], sets[a:z]))
        if held:
            yield flush()

    return B.released(run)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) of each row: component_id is the least doc_id that links reach, kept
    marks it, and text_key, a hash of the text, tells apart the rows of a repeated doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(*id_and_text(docs))
    signed = scratch.cut(texts.select("doc_id", "text", F.xxhash64("text").alias("tk")).mapInArrow(_sign(shingle), "doc_id bigint, tk bigint, n_shingles bigint, low bigint, high bigint, sig binary, bands array<bigint>"))
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("low", "high", "n_shingles").agg(F.min(F.struct("doc_id", "tk")).alias("first"))
    classes = classes.select("low", "high", "n_shingles", F.col("first.doc_id").alias("rep"), F.col("first.tk").alias("rep_tk"))
    members, _ = scratch.write(sets.select("doc_id", "tk", "low", "high", "n_shingles").join(classes, ["low", "high", "n_shingles"]).select("doc_id", "tk", "n_shingles", "rep", "rep_tk"))
    # A class is named by its least row. Nodes of the graph are doc_ids, so classes of one doc_id are one node with several texts.
    reps = members.where("doc_id = rep and tk = rep_tk").select("doc_id", "tk").distinct().hint("merge")
    own, _ = scratch.write(signed.join(reps, ["doc_id", "tk"], "left_semi").where("n_shingles > 0").select(F.col("doc_id").alias("rep"), "tk", "sig", "bands").dropDuplicates(["rep", "tk"]))
    sigs = own.select("rep", "tk", "sig")
    banded = own.select("rep", "tk", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min(F.struct("rep", "tk")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets, _ = scratch.write(banded.join(hubs.hint("merge"), "key").select("key", "rep", "tk", F.col("hub.rep").alias("hub"), F.col("hub.tk").alias("hub_tk")))
    low_share = percent / 100 - SLACK

    def named(df: DataFrame, end: str, *columns: str) -> DataFrame:
        """(rep, tk, columns) as one end of pairs."""
        return df.select(F.col("rep").alias(end), F.col("tk").alias(f"tk_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in columns])

    def texts_of(rows: DataFrame) -> DataFrame:
        """(rep, tk, text) of the classes named in rows (rep, tk)."""
        wanted = rows.select("rep", "tk").distinct()
        found = texts.where("doc_id is not null").select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("tk"), "text")
        return found.join(wanted.hint("merge"), ["rep", "tk"], "left_semi").dropDuplicates(["rep", "tk"])

    u, v = ["u", "tk_u"], ["v", "tk_v"]
    pairs = buckets.where("rep <> hub").select(F.col("rep").alias("u"), F.col("tk").alias("tk_u"), F.col("hub").alias("v"), F.col("hub_tk").alias("tk_v")).distinct()
    with_sig = pairs.join(named(sigs, "u", "sig").hint("merge"), u).join(named(sigs, "v", "sig").hint("merge"), v)
    pairs = scratch.cut(with_sig.select(*u, *v, "sig_u", "sig_v").mapInArrow(_alike(low_share), "u bigint, tk_u bigint, v bigint, tk_v bigint"))
    need = scratch.cut(texts_of(pairs.select(F.col("u").alias("rep"), F.col("tk_u").alias("tk")).unionByName(pairs.select(F.col("v").alias("rep"), F.col("tk_v").alias("tk")))))
    both = pairs.join(named(need, "u", "text").hint("merge"), u).join(named(need, "v", "text").hint("merge"), v)
    links = scratch.cut(both.select("u", "v", "text_u", "text_v").mapInArrow(_confirm(shingle, percent), "u bigint, v bigint, linked boolean").where("linked").select("u", "v"))
    labels = components(links, scratch)
    placed = buckets.select("key", "rep", "tk").join(labels.select(F.col("u").alias("rep"), F.col("v").alias("to")), "rep", "left").select("key", "rep", "tk", F.coalesce("to", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a < b").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own_block = F.pmod(F.xxhash64("rep", "tk"), F.col("blocks")).cast("int")
    rows = placed.join(mixed, "key").withColumn("own", own_block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "tk", "comp")
    fat = scratch.cut(texts_of(rows).join(sigs.hint("merge"), ["rep", "tk"]))
    across = rows.join(fat.hint("merge"), ["rep", "tk"]).select("key", "low", "high", "rep", "comp", "sig", "text").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    more = scratch.cut(across.mapInArrow(_across(shingle, percent, low_share), "u bigint, v bigint").distinct())
    if not more.isEmpty():
        labels = components(labels.unionByName(more), scratch)
    grouped = members.join(labels.select(F.col("u").alias("rep"), F.col("v").alias("to")), "rep", "left").select("doc_id", "n_shingles", F.coalesce("to", "rep").alias("component_id"), F.col("tk").alias("text_key"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("tk").alias("text_key"))
    result = grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return result.select("doc_id", "n_shingles", "component_id", "kept", "text_key")
