"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, A-Z folded. Seeds are the hashes of `least` consecutive tokens of benchmark
items, from running sums (Karp-Rabin); documents probe them. For each document and item that share seeds, maximal
matches are marked longest first; a match that meets marked tokens is cut to its unmarked rest, and rests shorter
than `least` are dropped. The share of an item's tokens under marked tiles is its coverage, in whatever order the
document has them; the pair is reported from `share` on.

The benchmark is broadcast in slices of about SLICE bytes, one scan of the documents for each. Where there are several, one
slice's result is written and its seeds are let go before the next is read. A pair is tiled only if the item tokens under shared seeds, which
bound the coverage from above, reach the threshold.

Nulls: null texts are empty; documents with a null doc_id and items with a null id are reported with that null. Items
without tokens are never reported; items shorter than `least` match as a whole, wherever a document has all their tokens
in a row. Ties between matches of equal length go to the earlier place in the item, then in the document. Repeated rows
are compared each; empty tables give empty results; other columns are ignored. Very long texts are read whole: shared
seeds are kept as diagonal runs, so a document and an item that repeat one word take as many runs as they have tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesnp as B
from tidemark.llm.store import Scratch

SLICE = 16 << 20
#: Pairs of seeds that are spread at a time, and distinct seeds of rows that are looked up at a time.
PAIRS, DISTINCT = 1 << 18, 1 << 18


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = B.words(buf, off, B.GAP)
    return B.spans_hash(B.prefix(buf, B.FOLDED), start, end), first


class Seeds:
    """Items' seeds: distinct hashes in order, the places (item, place) of each, and each item's seeds by hash and place."""

    def __init__(self, ids: list, texts: list[str], least: int):
        self.ids, self.least = ids, least
        raw = [(t or "").encode() for t in texts]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        words, first = tokens(np.frombuffer(b"".join(raw), np.uint8), off)
        self.length = np.diff(first)
        h, at = B.shingles(words, first, least)
        item = np.repeat(np.arange(len(self.length)), np.diff(at))
        place = np.arange(len(h)) - at[:-1][item]
        self.hash, slot = np.unique(h, return_inverse=True)
        order = np.lexsort((place, item, slot))
        self.item, self.place = item[order], place[order]
        self.begin = np.searchsorted(slot[order], np.arange(len(self.hash) + 1))
        own = np.lexsort((place, slot, item))
        self.own_slot, self.own_place = slot[own], place[own]
        self.own_at = np.searchsorted(item[own], np.arange(len(self.length) + 1))


def seeds_by_length(ids: list, texts: list[str], least: int) -> list[Seeds]:
    """Seeds of `least` tokens, and for items of fewer tokens seeds of just their length."""
    whole = Seeds(ids, texts, least)
    sizes = np.minimum(whole.length, least)
    if not ((sizes > 0) & (sizes < least)).any():
        return [whole]
    return [Seeds([ids[i] for i in own], [texts[i] for i in own], int(k)) for k in np.unique(sizes[sizes > 0]) if len(own := np.flatnonzero(sizes == k))]


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges begin..end, and the range of each."""
    size = end - begin
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(np.arange(len(size)), size)


def runs(slot: np.ndarray, place: np.ndarray, item_slot: np.ndarray, item_place: np.ndarray) -> np.ndarray:
    """Maximal diagonal runs of shared seeds as rows (place in item, place in document, seeds), from a document's seeds
    (in order of place) and an item's (in order of slot). Pairs are spread block by block and kept only as runs: a run that
    reaches a block's last place goes on where the next block's first place continues its diagonal."""
    begin, end = np.searchsorted(item_slot, slot, "left"), np.searchsorted(item_slot, slot, "right")
    slot, place, begin, end = (x[end > begin] for x in (slot, place, begin, end))
    done, open_runs, lo = [], np.zeros((0, 3), np.int64), 0
    total = np.concatenate([[0], np.cumsum(end - begin)])
    while lo < len(slot):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        at, of = spread(begin[lo:hi], end[lo:hi])
        i, j = item_place[at], place[lo:hi][of]
        order = np.lexsort((j, j - i))
        i, j = i[order], j[order]
        head = np.flatnonzero(np.concatenate([[True], ((j - i)[1:] != (j - i)[:-1]) | (j[1:] != j[:-1] + 1)]))
        new = np.stack([i[head], j[head], np.diff(np.append(head, len(i)))], axis=1)
        if len(open_runs):
            both = np.concatenate([open_runs, new])
            both = both[np.lexsort((both[:, 1], both[:, 1] - both[:, 0]))]
            diagonal = both[:, 1] - both[:, 0]
            joins = np.concatenate([[False], (diagonal[1:] == diagonal[:-1]) & (both[1:, 1] == both[:-1, 1] + both[:-1, 2])])
            first = np.flatnonzero(~joins)
            new = np.column_stack([both[first, :2], np.add.reduceat(both[:, 2], first)])
        last = place[hi - 1]
        reaches = new[:, 1] + new[:, 2] > last
        done.append(new[~reaches])
        open_runs, lo = new[reaches], hi
    return np.concatenate([*done, open_runs])


def tiles(found: np.ndarray, least: int, n_item: int, n_doc: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from runs of seeds: (place in item, place in document, length in tokens) of each tile. Longest first;
    ties go to the earlier place in the item, then in the document."""
    heap = [(-(n + least - 1), i, j) for i, j, n in found.tolist()]
    heapq.heapify(heap)
    item, doc, out = np.zeros(n_item, bool), np.zeros(n_doc, bool), []
    left = n_item
    while heap and left >= least:
        n, i, j = heapq.heappop(heap)
        free = ~(item[i : i - n] | doc[j : j - n])
        if free.all():
            item[i : i - n] = doc[j : j - n] = True
            out.append((i, j, -n))
            left += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if z - a >= least:
                heapq.heappush(heap, (a - z, i + a, j + a))
    return sorted(out)


def matches(seeds: Seeds, h: np.ndarray, at: np.ndarray, share: float) -> Iterator[tuple[int, int, list]]:
    """(row, item, tiles) of all rows' pairs that reach the share."""
    if not len(seeds.hash) or not len(h):
        return
    slot = np.searchsorted(seeds.hash, h)
    slot[slot == len(seeds.hash)] = 0
    hit = np.flatnonzero(seeds.hash[slot] == h)
    slot = slot[hit]
    if not len(hit):
        return
    n_items = len(seeds.length)
    row = np.searchsorted(at, hit, "right") - 1
    begin = np.searchsorted(hit, at)
    # Item tokens under a row's distinct seeds bound its coverage: each seed adds what lies beyond the seed before it.
    once = np.unique(row * len(seeds.hash) + slot)
    starts = np.append(np.flatnonzero(np.diff(once // len(seeds.hash), prepend=-1)), len(once))
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + DISTINCT, "right")) - 1)
        block, lo = once[starts[lo] : starts[hi]], hi
        s = block % len(seeds.hash)
        post, of = spread(seeds.begin[s], seeds.begin[s + 1])
        pair = block[of] // len(seeds.hash) * n_items + seeds.item[post]
        order = np.lexsort((seeds.place[post], pair))
        pair, own = pair[order], seeds.place[post][order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        first = np.flatnonzero(new)
        gap = np.where(new, seeds.least, np.minimum(np.diff(own, prepend=0), seeds.least))
        bound = np.add.reduceat(gap, first)
        for p in pair[first[bound >= share * seeds.length[pair[first] % n_items]]].tolist():
            r, k = divmod(p, n_items)
            mine = slice(begin[r], begin[r + 1])
            a, z = seeds.own_at[k], seeds.own_at[k + 1]
            n_doc = int(at[r + 1] - at[r]) + seeds.least - 1
            found = tiles(runs(slot[mine], hit[mine] - at[r], seeds.own_slot[a:z], seeds.own_place[a:z]), seeds.least, int(seeds.length[k]), n_doc)
            if sum(t[2] for t in found) >= share * seeds.length[k]:
                yield r, k, found


def found_in(parts: list[Seeds], batch: pa.RecordBatch, share: float) -> Iterator[tuple[int, Seeds, int, list]]:
    """(row of the batch, seeds, item, tiles) of each pair of a document and an item that share enough."""
    for i, _, b, o in B.pieces(*B.column(batch, "text")):
        words, first = tokens(b, o)
        for seeds in parts:
            h, at = B.shingles(words, first, seeds.least)
            for r, k, found in matches(seeds, h, at, share):
                yield i + r, seeds, k, found


def _report(shared, share: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, seeds, k, found in found_in(shared.value, batch, share):
                covered = sum(t[2] for t in found)
                rows.append((batch.column(0)[r].as_py(), seeds.ids[k], len(found), covered, int(seeds.length[k]), covered / float(seeds.length[k]), [[t[1], t[2]] for t in found]))
            kinds = [batch.schema.field(0).type, id_type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.list_(pa.int64()))]
            yield pa.record_batch([pa.array([x[c] for x in rows], k) for c, k in enumerate(kinds)], names=["doc_id", "item_id", "n_tiles", "covered", "item_tokens", "coverage", "tiles"])

    return B.released(run)


def _drop(shared, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for r, *_ in found_in(shared.value, batch, share):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return B.released(run)


def slices(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark by a hash of its text, so that each slice has about SLICE bytes."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SLICE) or 1
    if n == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def shared_seeds(part: DataFrame, least: int):
    """A broadcast variable of one slice of the benchmark."""
    rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
    return part.sparkSession.sparkContext.broadcast(seeds_by_length([r["item_id"] for r in rows], [r["text"] for r in rows], least))


def by_slice(docs: DataFrame, benchmark: DataFrame, least: int, search, keep_all: bool) -> DataFrame:
    """search(docs, seeds) of each slice. One slice is searched when the result is read. Of several, each result is written
    before the next slice is read, and its seeds go, so driver and tasks hold one slice at a time; keep_all: all results are
    the result, else each search reads what the one before has left."""
    parts = slices(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")))
    if len(parts) == 1:
        return search(docs, shared_seeds(parts[0], least))
    tmp, results, before = Scratch(docs.sparkSession, "decontaminate"), [], None
    for part in parts:
        shared = shared_seeds(part, least)
        found, path = tmp.write(search(docs, shared))
        shared.destroy()
        if keep_all:
            results.append(found)
            continue
        if before:
            tmp.drop(before)
        docs, before = found, path
    return reduce(DataFrame.unionByName, results) if keep_all else docs


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, item_tokens, coverage, tiles) of each document and item that share enough; tiles: [token, length] in the document."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, item_id bigint, n_tiles bigint, covered bigint, item_tokens bigint, coverage double, tiles array<array<bigint>>"
    return by_slice(texts, benchmark, least, lambda d, shared: d.mapInArrow(_report(shared, share, pa.int64()), schema), True)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that share enough with no item: rows are judged one by one, whatever their doc_id."""
    return by_slice(docs, benchmark, least, lambda d, shared: d.mapInArrow(_drop(shared, share), d.schema), False)
