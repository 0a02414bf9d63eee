"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every vocabulary piece, learnt by EM on a bounded sample of labelled texts; a
word's probability sums over all its segmentations, a text's log-likelihood over all its words. Words are what white
space separates, of any length; sums are rescaled as they advance, so a word of 5,000 bytes is summed as one of 5 is.
Equal words of a batch are scored once.

Nulls: a null or letterless text is `und` with score 0; rows without a language are not learnt from; with nothing to
learn from, every text is `und`. Ties go to the language that sorts first. Repeated rows are scored each; a null
doc_id stays, not held out. Very long texts are read whole. Empty tables give empty results; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm import bytesnp as B
from tidemark.llm.pieces import CELLS, Pieces, by_length, expected, forward
from tidemark.llm.store import Scratch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTER = regex.compile(r"\p{L}")
NONE = "und"
#: Scores of words that a task remembers between batches.
REMEMBERED = 1 << 22
#: Expected uses are added up in whole units, so that their sums don't depend on how words are dealt.
UNIT = 1e6


def spaced(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans' bytes, each after one space."""
    size = end - start + 1
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) - np.repeat(off[:-1], size)
    src = np.repeat(start, size) + at - 1
    out = buf[np.maximum(src, 0)].copy()
    out[off[:-1]] = 32
    return out, off[:-1], off[1:]


def distinct_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each distinct word of all rows; each word's place among them; each row's first word."""
    starts, ends, hashes, firsts, base, byte = [], [], [], [0], 0, 0
    for _, _, b, o in B.pieces(buf, off):
        s, e, first = B.words(b, o)
        starts.append(s + byte)
        ends.append(e + byte)
        hashes.append(B.spans_hash(B.prefix(b), s, e))
        firsts.extend((first[1:] + base).tolist())
        base += len(s)
        byte += len(b)
    if not hashes:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, B.U), z, np.zeros(1, np.int64)
    h, at, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return np.concatenate(starts)[at], np.concatenate(ends)[at], h, back, np.array(firsts)


class Model:
    def __init__(self, langs: list[str], probs: np.ndarray, single: np.ndarray):
        self.langs, self.probs, self.single = langs, probs, single


def cells(langs: int) -> int:
    """Bytes of words that advance together: each takes some numbers for every language."""
    return max(1, CELLS // max(1, langs))


def score_words(vocab: Pieces, model: Model, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros((len(start), len(model.langs)))
    if not model.langs:
        return out
    for lo in range(0, len(start), 1 << 17):
        b, s, e = spaced(buf, start[lo : lo + (1 << 17)], end[lo : lo + (1 << 17)])
        for which, matrix in by_length(b, s, e, cells(len(model.langs))):
            out[lo + which] = forward(vocab, model.probs, model.single, matrix)
    return out


def first_model(vocab: Pieces, langs: list[str]) -> Model:
    """All languages alike: a piece's probability falls with its length."""
    lengths = np.array([len(x) for x in vocab.text])
    start = 0.5 * np.exp(-2.0 * lengths)[:, None] * np.ones(len(langs))
    return Model(langs, start / start.sum(axis=0) * 0.99, np.full((256, len(langs)), 0.01 / 256))


def word_uses(vocab: Pieces, model: Model, buf: np.ndarray, off: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, of words that count counts (word x language) times."""
    out = np.zeros_like(model.probs)
    b, s, e = spaced(buf, off[:-1], off[1:])
    for which, matrix in by_length(b, s, e, cells(len(model.langs))):
        out += expected(vocab, model.probs, model.single, matrix, counts[which])
    return out


def _uses(shared):
    """Of a task's words: slot, and the expected uses by language in units of 1 / UNIT, whole so that sums don't depend on their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        total = np.zeros_like(model.probs)
        held: list[pa.RecordBatch] = []

        def add() -> None:
            # Many words together, so that those of equal length fill their lattices.
            if held:
                both = pa.concat_batches(held)
                counts = np.array(both.column(1).flatten()).reshape(both.num_rows, -1)
                total[:] += word_uses(vocab, model, *B.column(both, "word"), counts)
                held.clear()

        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) > B.CHUNK:
                add()
        add()
        whole = np.rint(total * UNIT).astype(np.int64)
        slot, k = np.nonzero(whole)
        yield pa.record_batch([pa.array(slot), pa.array(k), pa.array(whole[slot, k])], names=["slot", "k", "n"])

    return B.released(run)


def maximised(model: Model, uses: np.ndarray) -> Model:
    uses = uses + 0.05
    return Model(model.langs, uses / uses.sum(axis=0) * (1 - 256e-6), np.full((256, len(model.langs)), 1e-6))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = B.column(batch, "text")
        names = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        start, end, _, back, first = distinct_words(buf, off)
        if not len(start):
            continue
        row = np.repeat(np.arange(len(names)), np.diff(first))
        langs = sorted(set(names))
        code = np.array([langs.index(x) for x in names])
        pair, n = np.unique(back * len(langs) + code[row], return_counts=True)
        raw = buf.tobytes()
        words = [raw[start[p // len(langs)] : end[p // len(langs)]] for p in pair]
        yield pa.record_batch([pa.array([langs[p % len(langs)] for p in pair]), B.binaries(words), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def learn(labelled: DataFrame, vocab: Pieces, sample: int, rounds: int = 3) -> Model:
    """labelled: (doc_id, text, lang). sample: about so many documents per language, chosen by a hash of doc_id and taken
    whole. EM runs over the table of their words, dealt out; the driver gets sums by piece and language only."""
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    model = first_model(vocab, langs)
    if not langs:
        return model
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counted = chosen.select("text", "lang").mapInArrow(_count_words, "lang string, word binary, n bigint").groupBy("word")
    each = [F.sum(F.when(F.col("lang") == k, F.col("n").cast("double")).otherwise(0.0)) for k in langs]
    scratch = Scratch(spark, "langid")
    words = scratch.cut(counted.agg(F.array(*each).alias("n")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word"))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, model))
        found = words.mapInArrow(_uses(shared), "slot bigint, k bigint, n bigint").groupBy("slot", "k").agg(F.sum("n").alias("n")).toPandas()
        uses = np.zeros_like(model.probs)
        uses[found["slot"].to_numpy(int), found["k"].to_numpy(int)] = found["n"].to_numpy(float) / UNIT
        model = maximised(model, uses)
    scratch.drop()
    return model


def _predict(shared, out: list[str]):
    """The columns out of each row, then its language and that language's posterior probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        known, known_scores = np.zeros(0, B.U), np.zeros((0, len(model.langs)))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            names: list[str] = []
            values: list[float] = []
            for i, j, buf, off in B.pieces(*B.column(batch, "text")):
                start, end, h, back, first = distinct_words(buf, off)
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                seen = known[at] == h if len(known) else np.zeros(len(h), bool)
                scores = np.zeros((len(h), len(model.langs)))
                scores[seen] = known_scores[at[seen]]
                scores[~seen] = score_words(vocab, model, buf, start[~seen], end[~seen])
                if (len(known) + (~seen).sum()) * len(model.langs) > REMEMBERED:
                    known, known_scores = h, scores
                else:
                    order = np.argsort(np.concatenate([known, h[~seen]]))
                    known, known_scores = np.concatenate([known, h[~seen]])[order], np.concatenate([known_scores, scores[~seen]])[order]
                total = np.zeros((j - i, len(model.langs)))
                filled = np.flatnonzero(np.diff(first))
                if len(filled):
                    for k in range(len(model.langs)):
                        total[filled, k] = np.add.reduceat(scores[back, k], first[filled])
                for own, text in zip(total, texts.slice(i, j - i), strict=True):
                    text = text.as_py() if model.langs else None
                    if not text or not LETTER.search(text):
                        names.append(NONE)
                        values.append(0.0)
                        continue
                    k = int(np.argmax(own))
                    names.append(model.langs[k])
                    values.append(float(1 / np.exp(own - own[k]).sum()))
            yield pa.record_batch([*batch.select(out).columns, pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*out, "lang_pred", "score"])

    return B.released(run)


def annotated(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, sample: int = 600) -> DataFrame:
    """The columns keep of each row of docs, held_out, lang_pred and score. It learns from rows with a lang whose crc32(doc_id) mod 4 is not 2."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    text = F.col("text").cast("string")
    vocab = Pieces.load(vocabulary)
    known = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out")).where("not held_out and lang is not null and text is not null")
    shared = docs.sparkSession.sparkContext.broadcast((vocab, learn(known.select("doc_id", "text", "lang"), vocab, sample)))
    rows = docs.select(*[c for c in keep if c != "text"], text.alias("text"), held.alias("held_out"))
    out = [*keep, "held_out"]
    fields = [rows.schema[c] for c in out] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return rows.mapInArrow(_predict(shared, out), StructType(fields))


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = 600) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs."""
    return annotated(docs, ["doc_id"], vocabulary, sample)
