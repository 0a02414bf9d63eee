"""Lattices of vocabulary pieces over byte strings: batched Viterbi and forward sums.

Strings of equal length advance together, one column of a byte matrix after the other; the hashes of the substrings
that end there probe the sorted piece keys of their length. A piece's word-start mark stands for the space byte, so
0x20 is an ordinary symbol; a byte that no piece covers falls back to the vocabulary's piece for that single byte.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm import bytesnp as B

MARK = "▁"
#: Bytes of strings of equal length that advance together; a lattice keeps some tens of bytes for each.
CELLS = 1 << 20


class Pieces:
    """A fixed public vocabulary, read from a SentencePiece model file on the driver."""

    def __init__(self, strings: list[bytes], ids: list[int], scores: list[float], byte_ids: list[int]):
        self.text = strings
        self.ids = np.array(ids, np.int32)
        #: A merge vocabulary's scores are minus merge ranks, which don't add up over a segmentation; by Zipf's law
        #: the logarithm of the rank stands for a log probability. Scores that are log probabilities already stay.
        x = np.array(scores)
        self.scores = -np.log(2.0 - np.maximum(x, -1e6)) if x.min() < -1000 else x
        self.byte_ids = np.array(byte_ids, np.int32)
        lengths = np.array([len(x) for x in strings])
        self.longest = int(lengths.max())
        buf = np.frombuffer(b"".join(strings), np.uint8)
        off = np.concatenate([[0], np.cumsum(lengths)])
        h = B.spans_hash(B.prefix(buf), off[:-1], off[1:])
        self.keys, self.slot = {}, {}
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            order = own[np.argsort(h[own])]
            self.keys[int(n)], self.slot[int(n)] = h[order], order

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        strings, ids, scores, single = [], [], [], [0] * 256
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                single[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                strings.append(model.id_to_piece(i).replace(MARK, " ").encode())
                ids.append(i)
                scores.append(model.get_score(i))
        return cls(strings, ids, scores, single)

    def probe(self, pre: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the batch whose bytes i..j are a piece, and the slot of that piece."""
        keys = self.keys.get(j - i)
        if keys is None:
            return (np.zeros(0, np.int64),) * 2
        _, inv = B.powers(j)
        h = B.mix((pre[j] - pre[i]) * inv[i] + B.U(j - i))
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        rows = np.flatnonzero(keys[at] == h)
        return rows, self.slot[j - i][at[rows]]

    def bytes_of(self) -> dict[int, bytes]:
        out = {int(x): bytes([b]) for b, x in enumerate(self.byte_ids)}
        return out | {int(i): s for i, s in zip(self.ids, self.text, strict=True)}


def column_sums(matrix: np.ndarray) -> np.ndarray:
    """Prefix sums of each row, laid out by column."""
    n, length = matrix.shape
    p, _ = B.powers(length + 1)
    out = np.zeros((length + 1, n), B.U)
    np.cumsum((B.TABLE[matrix] * p[:length]).T, axis=0, out=out[1:])
    return out


def by_length(buf: np.ndarray, start: np.ndarray, end: np.ndarray, cells: int = CELLS):
    """(which, byte matrix) for spans of equal length, in blocks of at most `cells` bytes (or one span)."""
    length = end - start
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for own in np.split(order, cuts):
        if len(own) and (n := int(length[own[0]])):
            step = max(1, cells // n)
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                yield part, buf[start[part][:, None] + np.arange(n)]


def viterbi(vocab: Pieces, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of each row: ids in order, concatenated, and how many each row has. Ties: the shorter last piece."""
    n, length = matrix.shape
    pre = column_sums(matrix)
    fallback = vocab.scores.min() - 10.0
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back = np.ones((length + 1, n), np.int32)
    piece = np.zeros((length + 1, n), np.int32)
    for j in range(1, length + 1):
        top, came, what = best[j - 1] + fallback, back[j], vocab.byte_ids[matrix[:, j - 1]]
        for size in range(1, min(j, vocab.longest) + 1):
            rows, slot = vocab.probe(pre, j - size, j)
            if len(rows):
                score = best[j - size][rows] + vocab.scores[slot]
                better = score > top[rows]
                rows, slot = rows[better], slot[better]
                top[rows], came[rows], what[rows] = score[better], size, vocab.ids[slot]
        best[j], piece[j] = top, what
    at, rows, count = np.full(n, length), np.arange(n), np.zeros(n, np.int64)
    steps = []
    while len(rows):
        steps.append((rows, piece[at[rows], rows]))
        count[rows] += 1
        at[rows] -= back[at[rows], rows]
        rows = rows[at[rows] > 0]
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if n else 0, np.int32)
    for k, (rows, ids) in enumerate(steps):
        out[ends[rows] - 1 - k] = ids
    return out, count


#: Forward and backward sums are scaled to one every so many bytes, so that strings of any length stay in a float's range.
RESCALE = 8


def edges_of(vocab: Pieces, matrix: np.ndarray) -> list[list[tuple]]:
    """(size, rows, slot) of the pieces that end at each position."""
    pre = column_sums(matrix)
    out: list[list[tuple]] = [[]]
    for j in range(1, matrix.shape[1] + 1):
        out.append([(size, *edge) for size in range(1, min(j, vocab.longest) + 1) if len((edge := vocab.probe(pre, j - size, j))[0])])
    return out


def begun(edges: list[list[tuple]]) -> list[list[tuple]]:
    """The same edges by the position where they begin."""
    out: list[list[tuple]] = [[] for _ in edges]
    for j, own in enumerate(edges):
        for size, rows, slot in own:
            out[j - size].append((size, rows, slot))
    return out


def sums(vocab: Pieces, probs: np.ndarray, single: np.ndarray, matrix: np.ndarray, edges: list[list[tuple]], ends: bool, keep: bool) -> np.ndarray:
    """Logarithms of the sums over all segmentations of each prefix (ends; edges by their end) or suffix (edges by their
    begin), by position, row and language; keep: of all positions, else of the whole string only. A string's values are
    stored relative to a scale of their own, which is drawn to the newest position every RESCALE bytes for the positions
    that later ones still read."""
    n, length = matrix.shape
    value = np.zeros((length + 1, n, probs.shape[1]))
    scale = np.zeros_like(value) if keep else None
    now = np.zeros((n, probs.shape[1]))
    step = -1 if ends else 1
    value[0 if ends else length] = 1
    for j in range(1, length + 1) if ends else range(length - 1, -1, -1):
        value[j] = value[j + step] * single[matrix[:, j - 1 if ends else j]]
        for size, rows, slot in edges[j]:
            value[j][rows] += value[j + step * size][rows] * probs[slot]
        done = j if ends else length - j
        if keep:
            scale[j] = now
        if done % RESCALE == 0:
            near = slice(max(0, j - vocab.longest), j + 1) if ends else slice(j, j + vocab.longest + 1)
            top = value[j].copy()
            value[near] /= top
            now = now + np.log(top)
            if keep:
                scale[near] = now
    if keep:
        return np.log(value) + scale
    return np.log(value[length if ends else 0]) + now


def forward(vocab: Pieces, probs: np.ndarray, single: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, by row and language. probs: slot x language; single: byte x language."""
    return sums(vocab, probs, single, matrix, edges_of(vocab, matrix), True, False)


def expected(vocab: Pieces, probs: np.ndarray, single: np.ndarray, matrix: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each slot by language, over all segmentations of rows that count weight (row x language) times."""
    edges = edges_of(vocab, matrix)
    alpha = sums(vocab, probs, single, matrix, edges, True, True)
    beta = sums(vocab, probs, single, matrix, begun(edges), False, True)
    total = alpha[-1]
    slots, uses = [], []
    for j, own in enumerate(edges):
        for size, rows, slot in own:
            slots.append(slot)
            uses.append(np.exp(alpha[j - size][rows] + beta[j][rows] - total[rows]) * probs[slot] * weight[rows])
    if not slots:
        return np.zeros_like(probs)
    slot, use = np.concatenate(slots), np.concatenate(uses)
    return np.stack([np.bincount(slot, use[:, k], len(probs)) for k in range(probs.shape[1])], axis=1)
