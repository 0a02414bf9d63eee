"""Removal of repeated 50-byte strings by a distributed merge sort of suffixes.

A byte goes if a `window`-byte string that covers it also starts in a document of smaller doc_id.

1. Sampling. Of the `GRAM`-byte strings inside a window, those of least hash are its anchors: equal windows have equal
   anchors at equal places, so only suffixes that start at anchors need sorting. Map tasks send each batch's anchor
   hashes (packed, by range of hash); those found in two documents come back as places in documents.
2. Runs. A place's key is its suffix (up to `window` bytes), then the bytes before it, backwards. Each batch sorts its
   distinct keys, front-codes the run (shared prefix, rest) and sends it by range of anchor hash, with the least
   document of each key: the batch's others are settled at once, since all their windows at this anchor are equal.
3. Merge. Each range's runs are combined by a loser tree that keeps shared prefixes (losertree.py). Equal keys follow
   each other: all but the least document lose the windows around the anchor. Keys that share only the anchor are
   split by each window's own bytes; there too the least document keeps its bytes.
4. The intervals go back to their documents.

Nulls: a null text is empty; rows with a null doc_id are compared with nothing and keep their bytes. Documents shorter
than the window keep all. Equal texts: all but the least doc_id lose everything. Rows of one doc_id are one document,
so they never remove each other's bytes. Empty tables give empty results; other columns are ignored. Very long texts are
cut into places as any other: no step holds more than one of them with its batch.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesnp as B
from tidemark.llm.losertree import merge
from tidemark.llm.store import Scratch, id_and_text

GRAM = 16
#: Text bytes for each range of anchor hashes.
PER_RANGE = 16 << 20
#: Text bytes whose keys are sorted as one run.
RUN = 8 << 20
#: Places whose keys are cut out together.
PLACES = 1 << 14


def anchors(buf: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, rows and hashes of the anchors of a chunk."""
    h = B.windows_hash(B.prefix(buf), GRAM)
    span = window - GRAM + 1
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, B.U)
    order = ((h * B.U(0x9FB21C651E98DF25)) >> B.U(32)).astype(np.uint32)  # apart from the bits that choose the range

    def sliding(x: np.ndarray, n: int, f) -> np.ndarray:
        have = 1
        while have * 2 <= n:
            x = f(x[:-have], x[have:])
            have *= 2
        return f(x[: len(x) - (n - have)], x[n - have :]) if n > have else x

    least = sliding(order, span, np.minimum)
    edge = np.zeros(span - 1, np.uint32)
    most = sliding(np.concatenate([edge, least, edge]), span, np.maximum)
    pos = np.flatnonzero(most == order)
    row = np.searchsorted(off, pos, "right") - 1
    ok = (pos + GRAM <= off[row + 1]) & (off[row + 1] - off[row] >= window)
    pos, row = pos[ok], row[ok]
    return pos, row, h[pos]


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of each number, one plane after the other, so that equal high bytes compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :width] = x.T
    return out.view("<u8")[:, 0]


def zigzag(x: np.ndarray) -> np.ndarray:
    d = np.diff(x, prepend=0)
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return np.cumsum((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64))


def _sample(window: int, ranges: int):
    """Per batch and range: anchors of single documents (hash, row, position), hashes of several; the latter's places apart, as range -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            if not len(ids):
                continue
            buf, off = B.column(batch, "text")
            pos, row, h = [], [], []
            for i, _, b, o in B.pieces(buf, off):
                p, r, x = anchors(b, o, window)
                pos.append(p - o[r])
                row.append(r + i)
                h.append(x)
            pos, row, h = np.concatenate(pos), np.concatenate(row), np.concatenate(h)
            order = np.argsort(h, kind="stable")
            pos, row, h = pos[order], row[order], h[order]
            if not len(h):
                continue
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(begin, len(h)))
            doc = ids[row]
            several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
            chunk = int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            in_several = np.repeat(several, size)
            out = []
            if in_several.any():
                out.append((-1, chunk, packed(doc[in_several], pos[in_several]), b"", b""))
            heads = h[begin[several]]
            alone = ~in_several
            to, to_heads = part_of(h[alone], ranges), part_of(heads, ranges)
            ha, da, pa_ = h[alone], row[alone], pos[alone]
            for r in range(ranges):
                lo, hi = np.searchsorted(to, [r, r + 1])
                a, z = np.searchsorted(to_heads, [r, r + 1])
                if hi > lo or z > a:
                    name, local = np.unique(da[lo:hi], return_inverse=True)
                    docs = planes(zigzag(ids[name]), 8)
                    body = planes(ha[lo:hi] >> B.U(16), 6) + planes(local, 4) + planes(pa_[lo:hi], 5)
                    out.append((r, chunk, body, docs, planes(heads[a:z] >> B.U(16), 6)))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), *[B.binaries([x[j] for x in out]) for j in (2, 3, 4)]], names=["r", "chunk", "body", "docs", "heads"])

    return B.released(run)


def part_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of equal width over the hash's top 32 bits; ordered as the hash is."""
    return ((h >> B.U(32)) * B.U(ranges) >> B.U(32)).astype(np.int64)


def packed(doc: np.ndarray, pos: np.ndarray) -> bytes:
    name, local = np.unique(doc, return_inverse=True)
    order = np.lexsort((pos, local))
    head = np.array([len(name), len(pos)], np.int64).tobytes()
    return head + planes(zigzag(name), 8) + planes(local[order], 4) + planes(pos[order], 5)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.int64, 2)
    name = unzigzag(unplanes(data[16 : 16 + 8 * n], 8))
    local = unplanes(data[16 + 8 * n : 16 + 8 * n + 4 * m], 4).astype(np.int64)
    return name[local], unplanes(data[16 + 8 * n + 4 * m :], 5).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of equal first column, which come together."""
    held: list[dict] = []
    for batch in batches:
        for x in batch.to_pylist():
            first = next(iter(x.values()))
            if held and first != next(iter(held[0].values())):
                yield held
                held = []
            held.append(x)
    if held:
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of documents in a range: places of hashes that occur elsewhere too."""
    for rows in _grouped(batches):
        if rows[0]["r"] < 0:
            yield pa.record_batch([pa.array([x["chunk"] for x in rows], pa.int64()), B.binaries([x["body"] for x in rows])], names=["chunk", "body"])
            continue
        bodies, heads = [], []
        for x in rows:
            n = len(x["body"]) // 15
            bodies.append((unplanes(x["body"][: 6 * n], 6), unplanes(x["body"][6 * n : 10 * n], 4).astype(np.int64), unplanes(x["body"][10 * n :], 5), unzigzag(unplanes(x["docs"], 8))))
            heads.append(unplanes(x["heads"], 6))
        h = np.concatenate([b[0] for b in bodies] + heads)
        doc = np.concatenate([b[3][b[1]] for b in bodies])
        n_own = len(doc)
        # A document's own repeats don't count, a hash of several documents counts as two.
        name, back = np.unique(h, return_inverse=True)
        low, high = np.full(len(name), np.iinfo(np.int64).max), np.full(len(name), np.iinfo(np.int64).min)
        np.minimum.at(low, back[:n_own], doc)
        np.maximum.at(high, back[:n_own], doc)
        many = low < high
        many[back[n_own:]] = True
        at, chunks, out = 0, [], []
        for x, (hh, _, pos, _) in zip(rows, bodies, strict=True):
            hit = many[back[at : at + len(hh)]]
            if hit.any():
                chunks.append(x["chunk"])
                out.append(packed(doc[at : at + len(hh)][hit], pos[hit].astype(np.int64)))
            at += len(hh)
        if out:
            yield pa.record_batch([pa.array(chunks, pa.int64()), B.binaries(out)], names=["chunk", "body"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches):
        both = [unpacked(x["body"]) for x in rows]
        yield per_document(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]))


def per_document(doc: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((values[0], doc))
    doc = doc[order]
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(doc))[: len(begin)]
    table = np.stack([v[order] for v in values], axis=1).astype("<u8")
    return pa.record_batch([pa.array(doc[begin]), B.binaries([table[a:z].tobytes() for a, z in zip(begin, end, strict=True)])], names=["doc_id", "places"])


def contexts(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, pos: np.ndarray, window: int) -> np.ndarray:
    """Keys: up to window bytes from pos, then up to window - GRAM bytes before it, backwards; their lengths last. begin, end: of pos's row."""
    back = window - GRAM
    right = np.minimum(window, end - pos)
    left = np.minimum(back, pos - begin)
    out = np.zeros((len(pos), window + back + 2), np.uint8)
    for lo in range(0, len(pos), PLACES):
        own = slice(lo, lo + PLACES)
        at = pos[own, None] + np.arange(window)
        out[own, :window] = np.where(np.arange(window) < right[own, None], buf[np.minimum(at, len(buf) - 1)], 0)
        at = pos[own, None] - 1 - np.arange(back)
        out[own, window : window + back] = np.where(np.arange(back) < left[own, None], buf[np.maximum(at, 0)], 0)
    out[:, -2], out[:, -1] = right, left
    return out


def offsets(right: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most bytes before the anchor at which a window around it may start; none where least > most."""
    return np.maximum(0, window - right), np.minimum(window - GRAM, left)


def key_words(keys: np.ndarray) -> list[np.ndarray]:
    n, width = keys.shape
    pad = np.zeros((n, -(-width // 8) * 8), np.uint8)
    pad[:, :width] = keys
    return list(pad.view(">u8").astype(np.uint64).T)


def front_coded(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Prefix shared with the key before, and the rest of each key."""
    same = np.zeros(keys.shape, bool)
    same[1:] = keys[1:] == keys[:-1]
    shared = np.where(same.all(axis=1), keys.shape[1], np.argmin(same, axis=1)).astype(np.uint8)
    rest = np.arange(keys.shape[1]) >= shared[:, None]
    return shared, keys[rest].tobytes()


def _runs(window: int, ranges: int):
    """Documents with their places -> runs (r >= 0) and settled intervals (r = -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tks = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
            buf, off = B.column(batch, "text")
            lists = [b"".join(x) for x in batch.column(3).to_pylist()]
            poff = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            places = np.frombuffer(b"".join(lists), "<u8").astype(np.int64)
            for i, j, b, o in B.pieces(buf, off, RUN):
                size = (poff[i + 1 : j + 1] - poff[i:j]) // 8
                row = np.repeat(np.arange(j - i), size)
                pos = places[poff[i] // 8 : poff[j] // 8] + o[row]
                ok = pos + GRAM <= o[row + 1]
                row, pos = row[ok], pos[ok]
                if not len(pos):
                    continue
                keys = contexts(b, o[row], o[row + 1], pos, window)
                words = key_words(keys)
                doc = ids[i:j][row]
                order = np.lexsort((doc, *words[::-1]))
                keys, doc, tk, place = keys[order], doc[order], tks[i:j][row][order], (pos - o[row])[order]
                new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
                begin = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                least = doc[begin][group]
                low, high = offsets(keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64), window)
                gone = (doc > least) & (low <= high)
                out = []
                if gone.any():
                    out.append((-1, b"", b"", intervals(doc[gone], tk[gone], place[gone] - high[gone], place[gone] - low[gone] + window)))
                keep = ~(doc > least)
                gram = B.windows_hash_of(keys[begin][:, :GRAM])
                to = part_of(gram, ranges)
                by_range = np.argsort(to, kind="stable")
                kept = np.flatnonzero(keep)[np.argsort(to[group[keep]], kind="stable")]
                for r, own in zip(*split(to[by_range], by_range), strict=True):
                    shared, rest = front_coded(keys[begin[own]])
                    a, z = np.searchsorted(to[group[kept]], [r, r + 1])
                    mine = kept[a:z]
                    which = np.searchsorted(own, group[mine])
                    load = planes(which, 4) + planes(zigzag(doc[mine]), 8) + planes(tk[mine], 4) + planes(place[mine], 5)
                    out.append((int(r), shared.tobytes(), rest, load))
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), *[B.binaries([x[k] for x in out]) for k in (1, 2, 3)]], names=["r", "shared", "rest", "load"])

    return B.released(run)


def split(name: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values by name, which is sorted."""
    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    return name[begin], np.split(values, begin[1:])


def intervals(doc: np.ndarray, tk: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    return np.array([len(doc)], np.int64).tobytes() + planes(zigzag(doc), 8) + planes(tk, 4) + planes(begin, 5) + planes(end, 5)


class Run:
    """A front-coded run, decoded key by key as the merge asks for the next one: only the current key is held."""

    def __init__(self, shared: bytes, rest: bytes, width: int):
        self.shared, self.rest, self.width = shared, rest, width
        self.i, self.at, self.key = -1, 0, b""

    def __len__(self) -> int:
        return len(self.shared)

    def __getitem__(self, i: int) -> bytes:
        while self.i < i:
            self.i += 1
            same = self.shared[self.i]
            end = self.at + self.width - same
            self.key, self.at = self.key[:same] + self.rest[self.at : end], end
        return self.key


def _read_load(load: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = len(load) // 21
    return unplanes(load[: 4 * m], 4).astype(np.int64), unzigzag(unplanes(load[4 * m : 12 * m], 8)), unplanes(load[12 * m : 16 * m], 4).astype(np.int64), unplanes(load[16 * m :], 5).astype(np.int64)


def _merge(window: int):
    width = 2 * window - GRAM + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            if rows[0]["r"] < 0:
                for x in rows:
                    yield _rows(*_read_intervals(x["load"]))
                continue
            runs = [Run(x["shared"], x["rest"], width) for x in rows]
            distinct, kin, place_of, prev_gram = bytearray(), array("i"), [np.zeros(len(r), np.int32) for r in runs], -1
            for which, i, shared in merge([(r, r.shared) for r in runs]):
                if shared < width or not kin:
                    prev_gram += shared < GRAM or not kin
                    distinct += runs[which][i]
                    kin.append(prev_gram)
                place_of[which][i] = len(kin) - 1
            loads = [_read_load(x["load"]) for x in rows]
            group = np.concatenate([p[r[0]] for p, r in zip(place_of, loads, strict=True)])
            doc, tk, place = (np.concatenate([r[k] for r in loads]) for k in (1, 2, 3))
            del runs, rows, loads, place_of
            keys = np.frombuffer(distinct, np.uint8).reshape(-1, width)
            least = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(least, group, doc)
            low, high = offsets(keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64), window)
            g = group
            gone = (doc > least[g]) & (low[g] <= high[g])
            yield _rows(doc[gone], tk[gone], place[gone] - high[g][gone], place[gone] - low[g][gone] + window)
            # Keys that share the anchor and differ around it: window by window, in blocks of whole anchors.
            kin = np.frombuffer(kin, np.int32)
            crowd = np.flatnonzero(np.bincount(kin)[kin] > 1)
            begin = np.append(np.flatnonzero(np.diff(kin[crowd], prepend=-1)), len(crowd))
            lo = 0
            while lo < len(begin) - 1:
                hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + PLACES, "right")) - 1)
                own, lo = crowd[begin[lo] : begin[hi]], hi
                found = [_spread(own[hit], o, group, doc, least, tk, place, window) for o, hit in _by_window(keys[own], kin[own], least[own], low[own], high[own], window)]
                if found:
                    yield _rows(*[np.concatenate([f[k] for f in found]) for k in range(4)])

    return B.released(run)


def _spread(own, o, group, doc, least, tk, place, window):
    """Intervals of the least documents of the keys own, for the window that starts o bytes before the anchor."""
    mark = np.zeros(len(least), bool)
    mark[own] = True
    at = np.flatnonzero(mark[group] & (doc == least[group]))
    return doc[at], tk[at], place[at] - o, place[at] - o + window


def _by_window(keys, kin, least, low, high, window):
    """For each start before the anchor: the keys whose window also belongs to a key of smaller least document."""
    back = window - GRAM
    line = np.concatenate([keys[:, window : window + back][:, ::-1], keys[:, :window]], axis=1)
    sums = np.zeros((len(line), line.shape[1] + 1), B.U)
    p, inv = B.powers(line.shape[1] + 1)
    np.cumsum(B.TABLE[line] * p[: line.shape[1]], axis=1, out=sums[:, 1:])
    for o in range(back + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        s = back - o
        h = B.mix((sums[own, s + window] - sums[own, s]) * inv[s]) ^ B.mix(kin[own].astype(B.U) + B.U(1))
        _, g = np.unique(h, return_inverse=True)
        first = np.full(g.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, g, least[own])
        yield o, own[least[own] > first[g]]


def _read_intervals(data: bytes):
    n = int(np.frombuffer(data, np.int64, 1)[0])
    d = data[8:]
    return unzigzag(unplanes(d[: 8 * n], 8)), unplanes(d[8 * n : 12 * n], 4).astype(np.int64), unplanes(d[12 * n : 17 * n], 5).astype(np.int64), unplanes(d[17 * n :], 5).astype(np.int64)


def _rows(doc, tk, begin, end) -> pa.RecordBatch:
    """One row for each document, its intervals joined where they touch."""
    order = np.lexsort((begin, tk, doc))
    doc, tk, begin, end = doc[order], tk[order], begin[order], end[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tk[1:] != tk[:-1])])
        group = np.cumsum(new) - 1
        lift = int(end.max()) + 1
        reach = np.maximum.accumulate(end + group * lift)
        cut = np.concatenate([[True], begin[1:] + group[1:] * lift > reach[:-1]])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(doc)) - 1
        doc, tk, begin, end = doc[first], tk[first], begin[first], reach[last] - group[first] * lift
    return per_document(doc, begin, end, tk)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, many = batch.column(1), batch.column(3)
            kept, size, removed, spans = [], [], [], []
            for i in range(batch.num_rows):
                text = (texts[i].as_py() or "").encode()
                n, tk = len(text), batch.column(2)[i].as_py()
                gone = np.zeros(n + 1, np.int32)
                if batch.column(4)[i].as_py():
                    if n >= window:
                        gone[0] += 1
                        gone[n] -= 1
                else:
                    for data in many[i].as_py() or []:
                        x = np.frombuffer(data, "<u8").reshape(-1, 3).astype(np.int64)
                        x = x[x[:, 2] == tk]
                        np.add.at(gone, x[:, 0], 1)
                        np.add.at(gone, x[:, 1], -1)
                out = np.cumsum(gone[:-1]) > 0
                b = np.frombuffer(text, np.uint8)
                kept.append(b[~out].tobytes())
                size.append(n)
                removed.append(int(out.sum()))
                spans.append(int((out[1:] & ~out[:-1]).sum() + (out[0] if n else 0)))
            found = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), B.binaries(kept), *batch.columns[5:]]
            yield pa.record_batch(found, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *batch.schema.names[5:]])

    return B.released(run)


def repeated_bytes(docs: DataFrame, window: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row: kept holds the remaining bytes. The columns `keep` of docs
    travel along with their row, as fields of a last column `rest`, if any are named."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    rest = ["rest"] if keep else []
    base = docs.select(*id_and_text(docs), *([F.struct(*keep).alias("rest")] if keep else []))
    texts = base.withColumn("tk", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    known = texts.where("doc_id is not null and octet_length(text) >= %d" % window)
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_RANGE))
    sampled = known.select("doc_id", "text").mapInArrow(_sample(window, ranges), "r int, chunk bigint, body binary, docs binary, heads binary")
    target = F.when(F.col("r") >= 0, F.col("r").cast("bigint")).otherwise(F.col("chunk"))
    places = sampled.repartition(ranges, target).sortWithinPartitions("r").select("r", "chunk", "body", "docs", "heads").mapInArrow(B.released(_shared), "chunk bigint, body binary")
    places = scratch.cut(places.repartition("chunk").sortWithinPartitions("chunk").select("chunk", "body").mapInArrow(_by_document, "doc_id bigint, places binary"))
    joined_places = places.groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    copies = known.select("doc_id", "tk", F.sha2("text", 256).alias("digest"))
    firsts = copies.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.cut(copies.join(firsts, "digest").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("tk").alias("copies")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_RANGE))
    dealt = texts.where("doc_id is not null").repartition(parts, "doc_id")  # read by both joins below, dealt once
    with_places = dealt.join(joined_places, "doc_id").join(copies, "doc_id", "left").where("copies is null or not array_contains(copies, tk)")
    runs = with_places.select("doc_id", "text", "tk", "places", *rest).mapInArrow(_runs(window, ranges), "r int, shared binary, rest binary, load binary")
    merged = runs.repartition(ranges, F.when(F.col("r") >= 0, F.col("r")).otherwise(F.crc32("load"))).sortWithinPartitions("r").select("r", "shared", "rest", "load").mapInArrow(_merge(window), "doc_id bigint, places binary")
    gone = merged.groupBy("doc_id").agg(F.collect_list("places").alias("gone"))
    ready = dealt.join(gone, "doc_id", "left").join(copies, "doc_id", "left").select("doc_id", "text", "tk", "gone", F.coalesce(F.array_contains("copies", F.col("tk")), F.lit(False)).alias("copy"), *rest)
    nameless = texts.where("doc_id is null").select("doc_id", "text", "tk", F.lit(None).cast("array<binary>").alias("gone"), F.lit(False).alias("copy"), *rest)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary" + (f", rest {base.schema['rest'].dataType.simpleString()}" if keep else "")
    return ready.unionByName(nameless).mapInArrow(_cut(window), schema)
