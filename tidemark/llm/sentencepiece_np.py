"""SentencePiece encoding by batched Viterbi over a fixed public vocabulary, and decoding back to the same bytes.

A text is cut before each space that follows another byte; no piece of the vocabulary crosses such a cut, so the best
segmentations of the parts make the best one of the whole. A batch's distinct parts are segmented together, those that
the task has met before not again. No prefix is added and nothing is normalised, so decoding gives back every text
exactly.

Nulls: a null text encodes as an empty one. Empty texts have no ids. Ties between segmentations go to the shorter
last piece. Repeated rows are encoded each; very long texts are encoded whole; empty tables give empty results;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesnp as B
from tidemark.llm.langid import VOCABULARY
from tidemark.llm.pieces import Pieces, by_length, viterbi

#: Bytes of text encoded together: work arrays hold several numbers for each.
CHUNK = 1 << 20
#: Ids of parts that a task remembers between batches.
REMEMBERED = 1 << 20


def parts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.zeros(len(buf), bool)
    space = buf == 32
    cut[1:] = space[1:] & ~space[:-1]
    cut[off[:-1][off[:-1] < len(buf)]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(buf)), np.searchsorted(start, off)


def ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin:begin+size] of each, concatenated."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(begin - ends + size, size) + np.arange(ends[-1])]


class Known:
    """Segmentations of parts met before in a task: hashes in order, and where each one's ids lie."""

    def __init__(self):
        self.hash, self.ids = np.zeros(0, B.U), np.zeros(0, np.int32)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return at, self.hash[at] == h if len(self.hash) else np.zeros(len(h), bool)

    def add(self, h: np.ndarray, ids: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        order = np.argsort(np.concatenate([self.hash, h]), kind="stable")
        self.hash = np.concatenate([self.hash, h])[order]
        self.begin = np.concatenate([self.begin, begin + len(self.ids)])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.ids = np.concatenate([self.ids, ids])


def learn(vocab: Pieces, known: Known, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
    """Segments the parts of all chunks (bytes, offsets) that are not known yet, together."""
    found = [(np.zeros(0, B.U), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
    for buf, off in chunks:
        start, end, _ = parts(buf, off)
        if len(start):
            h, at = np.unique(hashes(buf, start, end), return_index=True)
            new = ~known.find(h)[1]
            at = at[new]
            found.append((h[new], end[at] - start[at], ragged(buf, start[at], end[at] - start[at])))
    h, size, buf = (np.concatenate([f[k] for f in found]) for k in range(3))
    h, at = np.unique(h, return_index=True)
    end = np.cumsum(size)[at]
    begin, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    flat, n = [np.zeros(0, np.int32)], 0
    for which, matrix in by_length(buf, end - size[at], end):
        ids, c = viterbi(vocab, matrix)
        count[which] = c
        begin[which] = n + np.concatenate([[0], np.cumsum(c)[:-1]])
        flat.append(ids)
        n += len(ids)
    known.add(h, np.concatenate(flat), begin, count)


def encode_rows(known: Known, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of all rows, whose parts are known, concatenated; and each row's offset."""
    start, end, first = parts(buf, off)
    place, _ = known.find(hashes(buf, start, end))
    sizes = known.count[place]
    total = np.concatenate([[0], np.cumsum(sizes)])
    return ragged(known.ids, known.begin[place], sizes), total[first]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, B.U), *(B.spans_hash(B.prefix(b), s, e) for b, s, e in _by_chunk(buf, start, end))])


def _by_chunk(buf, start, end):
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + B.CHUNK, "right")))
        a, z = start[lo], end[hi - 1]
        yield buf[a:z], start[lo:hi] - a, end[lo:hi] - a
        lo = hi


class Decoder:
    def __init__(self, vocab: Pieces):
        table = vocab.bytes_of()
        rows = [table.get(i, b"") for i in range(max(table) + 1)]
        self.size = np.array([len(x) for x in rows])
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(rows), np.uint8)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return ragged(self.bytes, self.begin[ids], size), total[off]


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        decoder, known = Decoder(vocab), Known()
        for batch in batches:
            buf, off = B.column(batch, "text")
            if len(known.ids) > REMEMBERED:
                known = Known()
            learn(vocab, known, ((b, o) for _, _, b, o in B.pieces(buf, off, CHUNK)))
            for i, j, b, o in B.pieces(buf, off, CHUNK):
                ids, at = encode_rows(known, b, o)
                text, to = decoder.decode(ids, at)
                same, digest = [], []
                for k in range(j - i):
                    back = text[to[k] : to[k + 1]]
                    same.append(bool(np.array_equal(back, b[o[k] : o[k + 1]])))
                    digest.append(hashlib.sha256(back.tobytes()).hexdigest())
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), B.listed(ids, at, pa.int32()), pa.array(digest), pa.array(same)], names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return B.released(run)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, round_trip): the digest is of the text that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(vocabulary))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_run(shared), f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to an empty text, unknown ids to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = []
            for ids in lists:
                x = np.array([i for i in ids or [] if i is not None and 0 <= i < len(decoder.size)], np.int64)
                texts.append(decoder.decode(x, np.array([0, len(x)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
