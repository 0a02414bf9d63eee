"""Prefix trie of conversations, merged family first.

A family is the conversations whose ids share a base, conv_id - conv_id % family. Cogrouped by base, its turns meet the
first turns of its members; there the conversations are rebuilt and combined into the family's own small trie. Only that
trie's nodes are shuffled on: nodes of one prefix from all families become one. A node's key is its depth and two sums of
its turns' digests, weighed by powers of two bases modulo a prime of 61 bits.

Nothing here holds a whole conversation. Turns are sorted by ranges, so that one conversation may fill many tasks, and
numbered and summed within a task; the few conversations that cross a border of tasks get what came before added. Families
are cogrouped by blocks of positions. A node belongs to its smallest member; since members only get fewer on the way down,
what a conversation owns is a tail of its path, a chain. So the sums over a node's subtree are the totals of its members'
chains, less what lies above the node on its own chain: no level of the trie waits for another. Lists of members that end
at one node are joined to text by ranges, in pieces, before one task hashes them as a stream.

Defined results: rows without a conv_id belong to no conversation and are left out; null roles and texts are empty; rows of
one conversation and turn (null turns are first) are in the order of the digest of role and text, and repeated rows are
turns of their own; texts count whole; other columns don't count; an empty table has no trie, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytesnp import released
from tidemark.llm.store import Scratch

PRIME = (1 << 61) - 1
BASES = (0x0F3A_5C71_9B2D_84E7, 0x1A6E_D02B_C3F5_9871)
#: Positions of a conversation that one group of a family holds at most.
BLOCK = 4096
#: Members' ids joined to one piece of text.
PIECE = 1 << 16
KEY = ["depth", "ha", "hb"]
WORD = r"[^\x20\x09-\x0D]+"

_LOW, _MID = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_P = np.uint64(PRIME)


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME, by halves of 31 bits."""
    xh, xl, yh, yl = x >> np.uint64(31), x & _LOW, y >> np.uint64(31), y & _LOW
    cross = xl * yh + xh * yl
    return _folded(_folded(xh * yh * np.uint64(2) + (cross >> np.uint64(30)) + ((cross & _MID) << np.uint64(31))) + _folded(xl * yl))


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo PRIME: a table of low powers times one of each thousand or so."""
    low = np.array([pow(base, k, PRIME) for k in range(1024)], np.uint64)
    high, which = np.unique(at >> 10, return_inverse=True)
    return times(low[at & 1023], np.array([pow(base, int(k) << 10, PRIME) for k in high], np.uint64)[which])


def sums(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME, by halves of 32 bits."""
    high, low = (np.cumsum(part) % _P for part in (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)))
    return _folded(times(high, np.full(len(x), 1 << 32, np.uint64)) + low)


def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _folded(x + _P - y)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two numbers of 60 bits from the digest of role and text, and the text's words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", "turn", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    value = [F.conv(F.substring("digest", at, 15), 16, 10).cast("bigint").alias(name) for at, name in ((1, "a"), (16, "b"))]
    return rows.select("conv_id", "turn", *value, "words", F.monotonically_increasing_id().alias("tie"))


NUMBERED = "part int, conv_id bigint, k bigint, ca bigint, cb bigint, words bigint"


@released
def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their place k in their conversation and the sums of its prefix, both as far as this task knows."""
    part = TaskContext.get().partitionId()
    last, k0, c0 = None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, a, b = (batch.column(i).to_numpy() for i in (0, 1, 2))
        starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        start = np.repeat(starts, np.diff(np.append(starts, len(conv))))
        k = np.arange(len(conv)) - start + 1
        goes_on = start == 0 if conv[0] == last else np.zeros(len(conv), bool)
        k[goes_on] += k0
        out = []
        for value, base, before in zip((a, b), BASES, c0):
            s = sums(times(value.astype(np.uint64), power(base, k)))
            s = less(s, np.where(start > 0, s[start - 1], np.uint64(0)))
            s[goes_on] = _folded(s[goes_on] + np.uint64(before))
            out.append(s)
        last, k0, c0 = conv[-1], int(k[-1]), [int(s[-1]) for s in out]
        yield pa.record_batch([pa.array(np.full(len(conv), part, np.int32)), batch.column(0), pa.array(k), *[pa.array(s.astype(np.int64)) for s in out], batch.column(3)], names=["part", "conv_id", "k", "ca", "cb", "words"])


def carried(runs: pd.DataFrame) -> pd.DataFrame:
    """What a conversation's earlier tasks hold, for each of its tasks but the first: at most one row a task."""
    rows, n, sum_of = [], 0, [0, 0]
    for r in runs.sort_values("part").itertuples():
        weight = [pow(base, n, PRIME) for base in BASES]
        rows.append((r.conv_id, r.part, n, *weight, *sum_of))
        sum_of = [(s + w * c) % PRIME for s, w, c in zip(sum_of, weight, (r.ca, r.cb))]
        n += r.n
    return pd.DataFrame(rows, columns=["conv_id", "part", "n", "wa", "wb", "sa", "sb"])


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, place, prefix sums and words of each numbered turn. Only a task's first and last conversation can go on in
    another task, so what is broadcast has at most two rows a task."""
    across = rows.groupBy("conv_id").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("conv_id")
    runs = rows.join(F.broadcast(across), "conv_id", "left_semi").groupBy("conv_id", "part")
    runs = runs.agg(F.max("k").alias("n"), F.max_by("ca", "k").alias("ca"), F.max_by("cb", "k").alias("cb"))
    before = runs.groupBy("conv_id").applyInPandas(carried, "conv_id bigint, part int, n bigint, wa bigint, wb bigint, sa bigint, sb bigint")
    wide = "decimal(19,0)"

    def moved(c: str, w: str, s: str) -> Column:
        inside = (F.col(c).cast(wide) * F.col(w).cast(wide) + F.col(s).cast(wide)) % F.lit(PRIME).cast(wide)
        return F.when(F.col("n").isNull(), F.col(c)).otherwise(inside.cast("bigint")).alias(c)

    joined = rows.join(F.broadcast(before), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("k") + F.coalesce("n", F.lit(0))).alias("place"), moved("ca", "wa", "sa"), moved("cb", "wb", "sb"), "words")


NODES = "base bigint, depth bigint, ha bigint, hb bigint, pa bigint, pb bigint, words bigint, members array<bigint>, ended array<bigint>"


def family_trie(heads_most: int, size: int):
    """Rebuilds a family's conversations over one block of `size` places and combines equal prefixes."""
    back = [np.array([pow(b, -k, PRIME) for k in range(heads_most)], np.uint64) for b in BASES]

    def build(key: tuple, turns: pa.Table, heads: pa.Table) -> pa.Table:
        base, block = key[0].as_py(), key[1].as_py()
        ids, sizes, first = (heads.column(c).to_pylist() for c in ("conv_id", "n", "head"))
        head = {c: sorted((h["place"], h["ca"], h["cb"], h["words"]) for h in f) for c, f in zip(ids, first)}
        length = dict(zip(ids, sizes))
        shared = head.get(base, [])
        conv, place, words = (turns.column(c).to_numpy() for c in ("conv_id", "place", "words"))
        prefix = [turns.column(c).to_numpy().astype(np.uint64) for c in ("ca", "cb")]
        order = np.lexsort((place, conv))
        conv, place, words, prefix = conv[order], place[order], words[order], [x[order] for x in prefix]
        nodes: dict[tuple, list] = {}

        def add(c: int, depth: int, at: tuple, above: tuple, n: int, final: bool) -> None:
            node = nodes.setdefault((depth, *at), [above, n, [], []])
            node[2].append(c)
            if final:
                node[3].append(c)

        for c in sorted(set(conv.tolist()) & set(ids)):
            h = zlib.crc32(str(c).encode()) % heads_most
            m = min(h, len(shared))
            last = m + max(0, length[c] - h)
            above = (0, 0)
            if block == 0:
                add(c, 0, (0, 0), (None, None), 0, last == 0)
            for d, (_, x, y, n) in enumerate(shared[:m], 1):
                if block == 0:
                    add(c, d, (x, y), above, n, last == d)
                above = (x, y)
            x, y = np.searchsorted(conv, [c, c + 1])
            x += np.searchsorted(place[x:y], h, "right")
            if x == y:
                continue
            own = head[c][h - 1][1:3] if h else (0, 0)
            at = [_folded(times(less(p[x:y], np.uint64(o)), np.full(y - x, inv[h - m], np.uint64)) + np.uint64(a)).tolist() for p, o, inv, a in zip(prefix, own, back, above)]
            for i, here, n in zip(place[x:y].tolist(), zip(*at), words[x:y].tolist()):
                if i > block * size:
                    d = i - (h - m)
                    add(c, d, here, above, n, last == d)
                above = here
        rows = [(base, d, x, y, *v[0], v[1], v[2], v[3]) for (d, x, y), v in nodes.items()]
        cols = zip(*rows) if rows else [[]] * 9
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * 2
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["base", "depth", "ha", "hb", "pa", "pb", "words", "members", "ended"])

    return build


def joined(most: int):
    """Ids sorted by node: the comma-joined ids of each node, in pieces of `most` ids at most, with their first id."""

    @released
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, done = None, [], []

        def packed() -> pa.RecordBatch:
            cols = zip(*done)
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()])], names=[*KEY, "least", "ids"])

        for batch in batches:
            for *at, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if ids and (at != key or len(ids) == most):
                    done.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = at
                ids.append(c)
            if done:
                yield packed()
                done = []
        if ids:
            done.append((*key, ids[0], ",".join(map(str, ids))))
            yield packed()

    return join


@released
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id: the digest of each node's ids, as a stream."""
    key, digest, done = None, None, []

    def packed() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), [pa.int64()] * 3 + [pa.string()])], names=[*KEY, "ends"])

    for batch in batches:
        for *at, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(4).to_pylist()):
            if at == key:
                digest.update(b",")
            else:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = at, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield packed()
            done = []
    if key:
        done.append((*key, digest.hexdigest()))
        yield packed()


def endings(nodes: DataFrame, piece: int = PIECE) -> DataFrame:
    """KEY, ends: SHA-256 of the ids that end at a node, joined by commas in ascending order."""
    ids = nodes.where("size(ended) > 0").select(*KEY, F.explode("ended").alias("c"))
    pieces = ids.repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(joined(piece), "depth bigint, ha bigint, hb bigint, least bigint, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_hashed, "depth bigint, ha bigint, hb bigint, ends string")


def prefix_trie(conversations: DataFrame, family: int = 20, heads_most: int = 4, size: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Conversation c takes its first crc32(c) % heads_most turns from that of c - c % family. size: places of a
    group; piece: ids joined at a time."""
    tmp = Scratch(conversations.sparkSession, "tries")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("tie")]
    ranged = turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "words")
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    rows = placed(tmp.cut(ranged.mapInArrow(numbered, NUMBERED)))
    block = F.expr(f"(place - 1) div {size}")

    first = F.when(F.col("place") < heads_most, F.struct("place", "ca", "cb", "words"))
    heads = rows.groupBy("conv_id").agg(F.max("place").alias("n"), F.collect_list(first).alias("head")).select(base, "*")
    heads = heads.withColumn("most", F.max("n").over(Window.partitionBy("base")))
    heads = heads.withColumn("block", F.explode(F.expr(f"sequence(0L, (most - 1) div {size})")))
    # a block's last turn is the parent of the next block's first
    blocks = F.when(F.col("place") % size == 0, F.array(block, block + 1)).otherwise(F.array(block))
    keyed = rows.select(base, F.explode(blocks).alias("block"), "conv_id", "place", "ca", "cb", "words")
    heads = heads.toDF(*heads.columns)
    tries = tmp.cut(keyed.groupBy("base", "block").cogroup(heads.groupBy("base", "block")).applyInArrow(family_trie(heads_most, size), NODES))

    combined = tries.groupBy(*KEY).agg(
        F.min(F.array_min("members")).alias("conv_id"),
        F.sum(F.size("members")).cast("bigint").alias("n_convs"),
        F.max("words").alias("words"),
        F.max(F.struct("pa", "pb")).alias("above"),
    )
    nodes = tmp.cut(combined)

    # A chain is what its conversation owns: from a depth, where it hangs on another's node, to the conversation's end.
    saves = (F.col("n_convs") - 1) * F.col("words")
    chains = nodes.groupBy("conv_id").agg(F.max("depth").alias("last"), F.min_by(F.struct("depth", "above"), "depth").alias("top"), F.sum(saves).alias("saved"))
    tops = chains.where("top.depth > 0").select("conv_id", (F.col("top.depth") - 1).alias("depth"), F.col("top.above.pa").alias("ha"), F.col("top.above.pb").alias("hb"))
    hung = tops.groupBy(*KEY).agg(F.count(F.lit(1)).alias("hung"))
    # a chain's last node is childless unless chains hang on it
    tails = nodes.join(chains.select("conv_id", F.col("last").alias("depth")), ["conv_id", "depth"], "left_semi")
    leaves = tails.join(hung, KEY, "left_anti").select("conv_id", F.lit(1).cast("bigint").alias("leaf"))
    totals = tmp.cut(chains.select("conv_id", "last", F.col("top.depth").alias("first"), "saved").join(leaves, "conv_id", "left").fillna(0, ["leaf"]))

    of = totals.select(base, "conv_id", F.struct("saved", "leaf").alias("v")).groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("conv_id", "v"))).alias("of"))

    def total(field: str) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.aggregate("members", zero, lambda acc, c: acc + F.coalesce(F.element_at("of", c)[field], zero))

    nothing = F.lit(0).cast("bigint")
    parts = tries.join(of, "base").select(*KEY, total("saved").alias("saved_below"), total("leaf").alias("n_leaves"), nothing.alias("hung"), F.lit(None).cast("string").alias("ends"))
    parts = parts.unionByName(hung.select(*KEY, nothing.alias("saved_below"), nothing.alias("n_leaves"), "hung", F.lit(None).cast("string").alias("ends")))
    parts = parts.unionByName(endings(tries, piece).select(*KEY, nothing.alias("saved_below"), nothing.alias("n_leaves"), nothing.alias("hung"), "ends"))
    below = parts.groupBy(*KEY).agg(F.sum("saved_below").alias("saved_below"), F.sum("n_leaves").alias("n_leaves"), F.sum("hung").alias("hung"), F.max("ends").alias("ends"))

    # What lies above a node on its chain: within blocks of depths, then over the blocks' totals.
    along = nodes.select("*", F.expr(f"depth div {size}").alias("cut"), saves.alias("saves"))
    inside = F.sum("saves").over(Window.partitionBy("conv_id", "cut").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.sum("of_cut").over(Window.partitionBy("conv_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1))
    cuts = along.groupBy("conv_id", "cut").agg(F.sum("saves").alias("of_cut")).select("conv_id", "cut", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    above = along.withColumn("inside", F.coalesce(inside, F.lit(0))).join(cuts, ["conv_id", "cut"])

    # The parent is on the same chain but for a chain's top. The root, on which most chains hang, is a single row.
    owner = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    root = owner.where("depth = 0").select("depth", "parent_conv_id")
    upper = tops.where("depth = 0").join(F.broadcast(root), "depth").select("conv_id", "parent_conv_id")
    upper = upper.unionByName(tops.where("depth > 0").join(owner, KEY).select("conv_id", "parent_conv_id"))
    placed_chains = totals.select("conv_id", "first", "last").join(upper, "conv_id", "left")

    out = above.join(placed_chains, "conv_id").join(below, KEY)
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.col("hung") + (F.col("depth") < F.col("last")).cast("bigint")).alias("n_children"),
        "n_leaves",
        (F.col("saved_below") - F.col("inside") - F.col("ahead")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
