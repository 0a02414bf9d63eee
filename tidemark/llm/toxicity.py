"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of its word vector and the mean of its character-gram vectors (grams at the word's start
count apart from inner ones). Words and grams of fewer than SEEN training texts have no vector, so that none is learnt
by heart. Windows of WINDOW words, each overlapping half of the next, pass the network;
attention pools a window's states into one logit. A text's score is that of its most toxic window, so every window of
every text is read. Labels are those of whole texts: in training the windows of a toxic text start as positive that hold a
word or gram found significantly more often in toxic texts, or else the best such one; after two rounds, those of
them that the network finds positive, or else its best one, take over. A quarter of each round's windows are those of
clean texts that it scored highest.

Nulls: null and empty texts score 0; rows without a label are not learnt from. A null doc_id is not held out. A
doc_id with several labels counts as toxic if any is. Without labels of both kinds all scores are 0. Repeated rows are
scored each; very long texts are scored in all their windows; empty tables give empty results; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesnp as B

WINDOW, STRIDE = 24, 12
WIDTH, HIDDEN, ATTEND = 16, 8, 8
SEEN = 3
STARTS, INNER = (3, 4, 5, 6), 4
CHUNK = 4 << 20
f4 = np.float32


def place(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash in a table whose row 0 is for all others."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, at + 1, 0)


class Words:
    """Distinct words of some texts, and their grams, ragged: hashes, then rows of the tables of known ones."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None):
        starts, sizes, hashes, firsts, seen, byte = [], [], [], [np.zeros(1, np.int64)], 0, 0
        for _, _, b, o in B.pieces(buf, off):
            start, end, first = B.words(b, o, B.GAP)
            hashes.append(B.spans_hash(B.prefix(b, B.FOLDED), start, end))
            starts.append(start + byte)
            sizes.append(end - start)
            firsts.append(first[1:] + seen)
            seen, byte = seen + len(start), byte + len(b)
        self.first = np.concatenate(firsts)
        z = np.zeros(0, np.int64)
        self.hash, at, of = np.unique(np.concatenate([*hashes, z.astype(B.U)]), return_index=True, return_inverse=True)
        self.of = of.astype(np.int32)
        from_, n = np.concatenate([*starts, z])[at], np.concatenate([*sizes, z])[at]
        s = np.cumsum(n) - n
        pre = B.prefix(buf[np.repeat(from_ - s, n) + np.arange(int(n.sum()))], B.FOLDED)  # of the distinct words alone
        grams, owner = [], []
        for k in STARTS:
            own = np.flatnonzero(n >= k)
            grams.append(B.mix(B.spans_hash(pre, s[own], s[own] + k) + B.U(k)))
            owner.append(own)
        size = np.maximum(n - INNER + 1, 0)
        own = np.repeat(np.arange(len(n)), size)
        begin = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())
        grams.append(B.spans_hash(pre, begin, begin + INNER))
        owner.append(own)
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.gram_hash, self.owner = grams[order], owner[order]
        if known is not None:
            self.know(known)

    def know(self, known: tuple[np.ndarray, np.ndarray]) -> None:
        """Unknown grams go; unknown words keep row 0."""
        self.row = place(known[0], self.hash)
        gram = place(known[1], self.gram_hash)
        self.gram, self.owner = gram[gram > 0], self.owner[gram > 0]
        self.gram_hash = None
        self.n_grams = np.bincount(self.owner, minlength=len(self.row))

    def vectors(self, p: dict) -> np.ndarray:
        out = p["word"][self.row].copy()
        for lo in range(0, len(self.row), 1 << 15):
            hi = min(lo + (1 << 15), len(self.row))
            a, z = np.searchsorted(self.owner, [lo, hi])
            filled = np.flatnonzero(self.n_grams[lo:hi]) + lo
            if z > a:
                begin = np.concatenate([[0], np.cumsum(self.n_grams[filled])[:-1]])
                out[filled] += np.add.reduceat(p["gram"][self.gram[a:z]], begin, axis=0) / self.n_grams[filled, None].astype(f4)
        return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and length of each window; the last of a row ends with it."""
    n = np.diff(first)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(k * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return row, first[:-1][row] + begin, np.minimum(n[row], WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(n_words: int, n_grams: int, seed: int = 11) -> dict:
    rng = np.random.Generator(np.random.PCG64(seed))

    def u(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(f4)

    p = {"word": u(n_words + 1, WIDTH, scale=0.1), "gram": u(n_grams + 1, WIDTH, scale=0.1)}
    p["word"][0] = 0
    for d in "fb":
        p |= {f"W{d}": u(WIDTH, 3 * HIDDEN, scale=WIDTH**-0.5), f"U{d}": u(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, f4)}
    return p | {"A": u(2 * HIDDEN, ATTEND, scale=0.3), "a": np.zeros(ATTEND, f4), "v": u(ATTEND, scale=0.3), "w": u(2 * HIDDEN, scale=0.3), "o": np.full(1, -1, f4)}


def recur(gates: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (time, batch, HIDDEN) from input gates (time, batch, 3 * HIDDEN); padded steps keep the state."""
    steps, n, _ = gates.shape
    H = HIDDEN
    h = np.zeros((n, H), f4)
    out = np.empty((steps, n, H), f4)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        s = h @ U
        zr = sigmoid(gates[t, :, : 2 * H] + s[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        c = np.tanh(gates[t, :, 2 * H :] + r * s[:, 2 * H :])
        new = c + z * (h - c)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, c, s[:, 2 * H :], m))
        h = np.where(m, new, h)
        out[t] = h
    return out


def pool(states: np.ndarray, mask: np.ndarray, p: dict) -> tuple:
    u = np.tanh(states @ p["A"] + p["a"])
    s = np.where(mask, u @ p["v"], f4(-1e9))
    e = np.exp(s - s.max(axis=0)) * mask
    alpha = e / np.maximum(e.sum(axis=0), 1e-9)
    pooled = (alpha[:, :, None] * states).sum(axis=0)
    return u, alpha, pooled, pooled @ p["w"] + p["o"][0]


def infer(p: dict, x: np.ndarray, of: np.ndarray, begin: np.ndarray, size: np.ndarray, block: int = 4096) -> np.ndarray:
    """Logits of windows over distinct words' vectors x; of: each word's place in x."""
    gates = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
    out = np.empty(len(begin), f4)
    for lo in range(0, len(begin), block):
        b, n = begin[lo : lo + block], size[lo : lo + block]
        steps = np.arange(int(n.max()))[:, None]
        mask = steps < n
        at = of[np.minimum(b + steps, len(of) - 1)]
        states = np.concatenate([recur(gates["f"][at], mask, p["Uf"], False), recur(gates["b"][at], mask, p["Ub"], True)], axis=2)
        out[lo : lo + block] = pool(states, mask, p)[3]
    return out


def gradients(p: dict, x: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the weighted log loss; and that with respect to x."""
    H = HIDDEN
    xs = x[at]
    keeps, states = {}, []
    for d in "fb":
        keeps[d] = []
        states.append(recur(xs @ p[f"W{d}"] + p[f"c{d}"], mask, p[f"U{d}"], d == "b", keeps[d]))
    states = np.concatenate(states, axis=2)
    u, alpha, pooled, logit = pool(states, mask, p)
    dl = ((sigmoid(logit) - y) * weight / len(y)).astype(f4)
    g = {"w": pooled.T @ dl, "o": np.array([dl.sum()], f4)}
    dp = dl[:, None] * p["w"]
    ds = alpha[:, :, None] * dp
    da = (states * dp).sum(axis=2)
    dscore = alpha * (da - (alpha * da).sum(axis=0))
    g["v"] = np.tensordot(dscore, u, ([0, 1], [0, 1]))
    du = dscore[:, :, None] * p["v"] * (1 - u * u)
    g["A"], g["a"] = np.tensordot(states, du, ([0, 1], [0, 1])), du.sum(axis=(0, 1))
    ds = ds + du @ p["A"].T
    dx = np.zeros_like(xs)
    for k, d in enumerate("fb"):
        U = p[f"U{d}"]
        own = ds[:, :, k * H : (k + 1) * H]
        dh = np.zeros((xs.shape[1], H), f4)
        dgates = np.zeros((xs.shape[0], xs.shape[1], 3 * H), f4)
        dU = np.zeros_like(U)
        for t, h, z, r, c, sn, m in reversed(keeps[d]):
            dh = dh + own[t]
            live = np.where(m, dh, 0)
            dz, dc = live * (h - c), live * (1 - z)
            dn = dc * (1 - c * c)
            dr = dn * sn
            raw = np.concatenate([dz * z * (1 - z), dr * r * (1 - r)], axis=1)
            dgates[t] = np.concatenate([raw, dn], axis=1)
            ds_all = np.concatenate([raw, dn * r], axis=1)
            dU += h.T @ ds_all
            dh = np.where(m, live * z + ds_all @ U.T, dh)
        g[f"U{d}"], g[f"c{d}"] = dU, dgates.sum(axis=(0, 1))
        g[f"W{d}"] = np.tensordot(xs, dgates, ([0, 1], [0, 1]))
        dx += dgates @ p[f"W{d}"].T
    flat = np.zeros_like(x)
    np.add.at(flat, at[mask], dx[mask])
    return g, flat


class Adam:
    def __init__(self, p: dict, rate: float):
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.t, self.rate = 0, rate

    def step(self, p: dict, g: dict, rows: dict) -> None:
        """g: dense gradients, or those of rows[k] of a table."""
        self.t += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            at = rows.get(k, slice(None))
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            s = self.s[k][at] = 0.999 * self.s[k][at] + 0.001 * d * d
            p[k][at] -= (fix * m / (np.sqrt(s) + 1e-8)).astype(f4)


#: Standard deviations by which a word or gram is found in more toxic texts than clean ones.
SIGNIFICANT = 2.5


def vocabulary(w: Words, toxic: np.ndarray) -> tuple[tuple, tuple]:
    """Hashes of words and grams of at least SEEN texts, sorted; and how significantly each marks toxic texts, by row."""
    n = np.bincount(w.owner, minlength=len(w.hash))
    begin = np.concatenate([[0], np.cumsum(n)])
    names, code = np.unique(w.gram_hash, return_inverse=True)
    found = [np.zeros((2, len(w.hash))), np.zeros((2, len(names)))]
    for i, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        word = np.unique(w.of[lo:hi])
        size = n[word]
        grams = np.unique(code[np.repeat(begin[word] - np.cumsum(size) + size, size) + np.arange(size.sum())])
        found[0][toxic[i], word] += 1
        found[1][toxic[i], grams] += 1
    keys, odds = [], []
    ratio = toxic.sum() / max(1, (1 - toxic).sum())
    for own, (miss, hit) in zip((w.hash, names), found, strict=True):
        ok = hit + miss >= SEEN
        keys.append(own[ok])
        odds.append(np.concatenate([[-9], ((hit - 2 * ratio * (miss + 0.5)) / np.sqrt(hit + 1))[ok]]))
    return tuple(keys), tuple(odds)


def positives(toxic: np.ndarray, row: np.ndarray, value: np.ndarray, limit: float) -> np.ndarray:
    """Windows of toxic texts above the limit, or the best of each text that has none."""
    best = np.full(len(toxic), -np.inf)
    np.maximum.at(best, row, value)
    return (toxic[row] * ((value > limit) | (value == best[row]) & (best[row] <= limit)) > 0).astype(f4)


def train(texts: list[str], toxic: np.ndarray, rounds: int = 6, per_round: int = 8000, batch: int = 256, seed: int = 3) -> dict | None:
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    w = Words(np.frombuffer(b"".join(raw), np.uint8), off)
    known, odds = vocabulary(w, toxic)
    w.know(known)
    row, begin, size = windows(w.first)
    p = start(len(known[0]), len(known[1])) | {"known": known}
    strength = odds[0][w.row]
    np.maximum.at(strength, w.owner, odds[1][w.gram])
    at = w.of[np.minimum(begin[:, None] + np.arange(WINDOW), len(w.of) - 1)]
    evidence = np.where(np.arange(WINDOW) < size[:, None], strength[at], -9).max(axis=1)
    label = positives(toxic, row, evidence, SIGNIFICANT)
    adam = Adam({k: v for k, v in p.items() if k != "known"}, 0.01)
    gram_at = np.concatenate([[0], np.cumsum(w.n_grams)])
    negative = np.flatnonzero(toxic[row] == 0)
    for k in range(rounds):
        hard = negative
        if k:
            logit = infer(p, w.vectors(p), w.of, begin, size)
            hard = negative[np.argsort(-logit[negative], kind="stable")[: per_round // 4]]
            adam.rate = 0.01 / (1 + k)
        if k >= 2:
            label = positives(toxic, row, np.where(evidence > SIGNIFICANT, logit, np.minimum(logit, 0)), 0)
        positive, part = np.flatnonzero(label == 1), per_round // 4
        chosen = np.concatenate([rng.choice(positive, 2 * part), rng.choice(negative, part), rng.choice(hard, part)])
        rng.shuffle(chosen)
        for lo in range(0, len(chosen), batch):
            own = chosen[lo : lo + batch]
            steps = np.arange(WINDOW)[:, None]
            mask = steps < size[own]
            at = w.of[np.minimum(begin[own] + steps, len(w.of) - 1)]
            used, back = np.unique(at, return_inverse=True)
            n = w.n_grams[used]
            spread = np.repeat(gram_at[used] - np.cumsum(n) + n, n) + np.arange(n.sum())
            grams, owner = w.gram[spread], np.repeat(np.arange(len(used)), n)
            x = p["word"][w.row[used]].copy()
            share = (1 / np.maximum(n, 1)).astype(f4)
            np.add.at(x, owner, p["gram"][grams] * share[owner, None])
            g, dx = gradients(p, x, back.reshape(at.shape), mask, label[own], np.ones(len(own), f4))
            rows = {"word": np.unique(w.row[used]), "gram": np.unique(grams)}
            g["word"], g["gram"] = np.zeros((len(rows["word"]), WIDTH), f4), np.zeros((len(rows["gram"]), WIDTH), f4)
            np.add.at(g["word"], np.searchsorted(rows["word"], w.row[used]), dx)
            np.add.at(g["gram"], np.searchsorted(rows["gram"], grams), dx[owner] * share[owner, None])
            g["word"][rows["word"] == 0] = 0
            adam.step(p, g, rows)
    top = np.full(len(toxic), -np.inf)
    np.maximum.at(top, row, infer(p, w.vectors(p), w.of, begin, size))
    clean, bad = top[(toxic == 0) & np.isfinite(top)], top[(toxic == 1) & np.isfinite(top)]
    if len(clean) and len(bad):
        # A text's best of many windows lies above a single window's logit: 0.5 goes between the two kinds of texts.
        low, high = np.quantile(clean, 0.995), np.quantile(bad, 0.02)
        p["o"] = p["o"] - f4((low + high) / 2 if high > low else low)
    return p


def score_rows(p: dict | None, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    if p is None:
        return out
    for i, _, b, o in B.pieces(buf, off, CHUNK):
        w = Words(b, o, p["known"])
        row, begin, size = windows(w.first)
        if len(row):
            best = np.full(len(o) - 1, -np.inf)
            np.maximum.at(best, row, infer(p, w.vectors(p), w.of, begin, size))
            filled = np.isfinite(best)
            out[i : i + len(best)][filled] = sigmoid(best[filled])
    return out


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        model = pickle.loads(shared.value) if shared.value else None
        for batch in batches:
            score = score_rows(model, *B.column(batch, "text"))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 1200) -> DataFrame:
    """(doc_id, held_out, score, predicted). It learns from about `sample` labelled documents of each kind whose crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held)
    sizes = {int(r["toxic"] > 0): r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") > 0, min(1.0, sample / sizes.get(1, 1))).otherwise(min(1.0, sample / sizes.get(0, 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")

    def learn(pdf):
        import pickle

        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
        return pd.DataFrame({"model": [pickle.dumps(train(pdf["text"].tolist(), (pdf["toxic"].to_numpy() > 0).astype(int)))]})

    # One task holds the bounded sample; the driver gets the weights only.
    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: learn(pdf), "model binary").collect()
    shared = spark.sparkContext.broadcast(found[0]["model"] if found else None)
    return texts.select("doc_id", held.alias("held_out"), "text").mapInArrow(_run(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
