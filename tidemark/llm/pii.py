"""Personal data: four base patterns, and identifiers that they miss, found by bootstrapped contexts.

Base matches are the seeds. The words around them make lexical patterns (two words to the left; one to each side; one
to the left that ends in a colon or the like). A pattern around MIN_SEEDS different seeds is looked up in all texts: what
stands in its place there are seeds, other identifier-like strings, or plain words. Patterns and strings form a graph,
whose edges count occurrences. Round by round a pattern's score is the mean confidence of all that stands in its place
(that of plain words is 0), and a string's confidence is one minus the product of what each of its patterns leaves open.
Strings of SURE confidence or more are added where a pattern that is at least as often right as wrong surrounds them.

Only a bitmap of fixed size over the patterns' hashes goes to the tasks; joins settle what it lets through. Two passes read
the texts: one for the seeds and one for what stands in the place of their patterns. Plain words are only counted, by task.

Defined results: a null text is empty; rows with null or equal ids are searched each by themselves; offsets are code points,
end exclusive; texts are searched whole, in time linear in their length; added spans overlap neither base spans of any
kind nor one another (failed base matches come first, longest first); the most confident kind names them, of equal ones the
first in KINDS; an empty table gives none; other columns don't count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytesnp import BASE, FOLDED, TABLE, U, column, mix, pieces, prefix, released, spans_hash, words
from tidemark.llm.store import Scratch, id_and_text

KINDS = ("email", "ip", "card", "phone")
#: Different seeds that a pattern needs.
MIN_SEEDS = 3
#: Score from which a pattern's strings gain confidence.
RIGHT = 0.5
#: Confidence from which a string is added.
SURE = 0.8
ROUNDS = 4
#: Bits of the map of patterns' hashes.
BITS = 1 << 22

LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Each of these reads a character a fixed number of times at most.
DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(rb"[0-9]++(?:[ -][0-9]++)*+")
PLUS = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
#: Identifier-like: a run of these with a digit or an at sign, perhaps a written one.
RUN = re.compile(rb"[0-9A-Za-z@._%+()\[\]/#-]++(?: [0-9()][0-9()./-]*+(?=[\x20\x09-\x0D,;]|$))*+")
TELLING = re.compile(rb"[0-9@]|[(\[]at[)\]]", re.I)
EDGE = b"._%+()[]/#-"
#: Words of contexts: case and digits don't count.
PLAIN = FOLDED.copy()
PLAIN[48:58] = TABLE[48]
LEADS = np.zeros(256, bool)
LEADS[list(b":=#<")] = True
#: In place of words beyond a text's ends.
NO_WORD = U(0)

Span = tuple[int, int, int]


def luhn(digits: bytes) -> bool:
    value = [d - 48 for d in digits[::-1]]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(value)) % 10 == 0


def base_spans(data: bytes) -> tuple[list[Span], list[tuple[int, int]]]:
    """start, kind, end of the base matches by start and kind; start and end of matches that failed."""
    found: list[Span] = []
    failed: list[tuple[int, int]] = []
    low = 0
    for m in DOMAIN.finditer(data):
        # a local part ends at its at sign and holds none, so it reaches back to the last match or at sign
        start = low + len(data[low : m.start()].rstrip(LOCAL))
        if start < m.start():
            found.append((start, 0, m.end()))
            low = m.end()
        else:
            low = m.start() + 1
    for m in DOTTED.finditer(data):
        fine = all(len(p := x.lstrip(b"0")) < 4 and int(p or b"0") <= 255 for x in m.group().split(b"."))
        found.append((m.start(), 1, m.end())) if fine else failed.append(m.span())
    for m in DIGITS.finditer(data):
        digits = m.group().replace(b" ", b"").replace(b"-", b"")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
        elif len(digits) > 1:
            failed.append(m.span())
    for m in PLUS.finditer(data):
        fine = 10 <= sum(48 <= b < 58 for b in m.group()) <= 15
        found.append((m.start(), 3, m.end())) if fine else failed.append(m.span())
    return sorted(found), failed


def identifiers(data: bytes, found: list[Span], failed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings that touch no base span: failed matches, then what looks alike. None overlaps another."""
    out: list[tuple[int, int]] = []
    taken = sorted((a, b) for a, _, b in found)
    rest = sorted(failed, key=lambda s: (s[0] - s[1], s[0]))
    for m in RUN.finditer(data):
        if TELLING.search(m.group()):
            a = m.start() + len(m.group()) - len(m.group().lstrip(b"._%]/#-)"))
            b = a + len(data[a : m.end()].rstrip(b"._%+([/#-"))
            if b > a and TELLING.search(data, a, b):
                rest.append((a, b))
    starts, ends = [a for a, _ in taken], [b for _, b in taken]
    if taken:
        x, y = np.array(starts), np.maximum.accumulate(np.array(ends))
        rest = [(a, b) for a, b in rest if (k := int(np.searchsorted(x, b, "left"))) == 0 or y[k - 1] <= a]
    used = np.zeros(len(data) + 1, bool) if rest else None
    for a, b in rest:
        if not used[a:b].any():
            used[a:b] = True
            out.append((a, b))
    return sorted(out)


class Piece:
    """Texts as one buffer, with its words, their hashes and those of any string."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.data = buf, off, buf.tobytes()
        self.s, self.e, self.first = words(buf, off)
        self.plain, self.exact = prefix(buf, PLAIN), prefix(buf, FOLDED)
        self.h = spans_hash(self.plain, self.s, self.e)
        self.row = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start, end and kind of base matches; kind -1: other identifier-like strings."""
        rows, begin, stop, kind = [], [], [], []
        for r, (a, b) in enumerate(zip(self.off[:-1].tolist(), self.off[1:].tolist())):
            data = self.data[a:b]
            base, failed = base_spans(data)
            spans = base + [(x, -1, y) for x, y in identifiers(data, base, failed)]
            rows += [r] * len(spans)
            for x, k, y in spans:
                begin.append(a + x)
                stop.append(a + y)
                kind.append(k)
        return tuple(np.array(x, np.int64) for x in (rows, begin, stop, kind))

    def _word(self, i: np.ndarray, row: np.ndarray) -> np.ndarray:
        inside = (i >= self.first[row]) & (i < self.first[row + 1])
        return np.where(inside, np.append(self.h, NO_WORD)[np.where(inside, i, 0)], NO_WORD)

    def patterns(self, left: np.ndarray, before: np.ndarray, right: np.ndarray, leads: np.ndarray) -> np.ndarray:
        """Hashes of the three patterns around a place, a row each; 0 where there is none."""
        pair = (before * U(BASE) + left) * U(BASE) + U(1)
        sides = (left * U(BASE) + right) * U(BASE) + U(2)
        alone = left * U(BASE) + U(3)
        return np.stack([mix(pair), mix(sides), np.where(leads, mix(alone), U(0))])

    def around(self, row: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Patterns around strings. Where one starts or ends inside a word, the rest of that word is its neighbour."""
        i = np.searchsorted(self.s, begin, "right") - 1
        j = np.searchsorted(self.s, stop - 1, "right") - 1
        cut = self.s[i] < begin
        left = np.where(cut, spans_hash(self.plain, self.s[i], begin), self._word(i - 1, row))
        before = self._word(np.where(cut, i - 1, i - 2), row)
        right = np.where(self.e[j] > stop, spans_hash(self.plain, np.minimum(stop, self.e[j]), self.e[j]), self._word(j + 1, row))
        last = np.where(cut, begin - 1, self.e[i - 1] - 1)
        leads = LEADS[self.buf[last]] & (cut | (i > self.first[row]))
        return self.patterns(left, before, right, leads)

    def plain_words(self, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that no string from begin to stop touches, and the patterns around them."""
        depth = np.zeros(len(self.s) + 1, np.int64)
        np.add.at(depth, np.searchsorted(self.e, begin, "right"), 1)
        np.add.at(depth, np.searchsorted(self.s, stop, "left"), -1)
        i = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
        row = self.row[i]
        leads = LEADS[self.buf[self.e[i - 1] - 1]] & (i > self.first[row])
        return i, self.patterns(self._word(i - 1, row), self._word(i - 2, row), self._word(i + 1, row), leads)

    def values(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return spans_hash(self.exact, begin, stop).view(np.int64)


def _signed(p: np.ndarray) -> np.ndarray:
    return p.view(np.int64)


@released
def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """p, k, v: the patterns around base matches. Only texts that have some are split into words."""
    for batch in batches:
        whole, ends = column(batch, "text")
        for _, _, buf, off in pieces(whole, ends):
            data = buf.tobytes()
            bounds = zip(off[:-1].tolist(), off[1:].tolist())
            own = [(buf[a:b], found) for a, b in bounds if (found := base_spans(data[a:b])[0])]
            if not own:
                continue
            start = np.concatenate([[0], np.cumsum([len(t) for t, _ in own])])
            piece = Piece(np.concatenate([t for t, _ in own]), start)
            row, begin, kind, stop = np.array([(r, start[r] + a, k, start[r] + b) for r, (_, found) in enumerate(own) for a, k, b in found], np.int64).T
            p = piece.around(row, begin, stop).ravel()
            table = np.unique(np.stack([_signed(p), np.tile(kind, 3), np.tile(piece.values(begin, stop), 3)], 1)[p != 0], axis=0)
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in table.T], names=["p", "k", "v"])


SEARCHED = "doc_id bigint, base array<struct<start:bigint,k:bigint,stop:bigint>>, seeds array<struct<p:bigint,k:bigint,v:bigint>>, others array<struct<p:bigint,v:bigint,start:bigint,stop:bigint>>, tally array<struct<p:bigint,n:bigint>>"


def _lists(row: np.ndarray, n: int, fields: dict[str, np.ndarray]) -> pa.Array:
    """Structs of the fields, a list for each of n rows; row is ascending."""
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in fields.values()], list(fields)))


def searched(bits: np.ndarray):
    """Each text's base matches and the strings in the place of a pattern of the bitmap. A last row, without base matches
    even as an empty list, has the task's counts of plain words there."""

    def kept(p: np.ndarray) -> np.ndarray:
        at = (p & U(BITS - 1)).astype(np.int64)
        return (p != 0) & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[int] = Counter()
        nothing = np.zeros(0, np.int64)
        names = ["doc_id", "base", "seeds", "others", "tally"]
        for batch in batches:
            whole, ends = column(batch, "text")
            for i, j, buf, off in pieces(whole, ends):
                piece, n = Piece(buf, off), j - i
                row, begin, stop, kind = piece.found()
                points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                start, end = (points[x] - points[off[row]] for x in (begin, stop))
                base = kind >= 0
                p = piece.around(row, begin, stop) if len(row) else np.zeros((3, 0), U)
                v = piece.values(begin, stop)
                which, at = np.nonzero(kept(p).T)[::-1]
                q = _signed(p[which, at])
                seed = base[at]
                a, b = at[seed], at[~seed]
                seeds = _lists(row[a], n, {"p": q[seed], "k": kind[a], "v": v[a]})
                # found() lists a row's other strings behind its base matches, so rows stay in order
                others = _lists(row[b], n, {"p": q[~seed], "v": v[b], "start": start[b], "stop": end[b]})
                if len(piece.s):
                    _, around = piece.plain_words(begin, stop)
                    seen, times = np.unique(_signed(around[kept(around)]), return_counts=True)
                    tally.update(dict(zip(seen.tolist(), times.tolist())))
                bases = _lists(row[base], n, {"start": start[base], "k": kind[base], "stop": end[base]})
                empty = _lists(nothing, n, {"p": nothing, "n": nothing})
                yield pa.record_batch([batch.column(0).slice(i, n), bases, seeds, others, empty], names=names)
        if tally:
            none = [pa.nulls(1, k) for k in (pa.int64(), *(pa.list_(pa.struct([(f, pa.int64()) for f in fields])) for fields in (("start", "k", "stop"), ("p", "k", "v"), ("p", "v", "start", "stop"))))]
            p, count = (np.array(x, np.int64) for x in zip(*tally.items()))
            yield pa.record_batch([*none, _lists(np.zeros(len(p), np.int64), 1, {"p": p, "n": count})], names=names)

    return run


def bitmap(patterns: DataFrame) -> np.ndarray:
    """BITS bits, whatever the number of patterns."""
    at = patterns.select(F.col("p").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("at")).distinct().toArrow().column("at").to_numpy()
    out = np.zeros(BITS >> 3, np.uint8)
    np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return out


def graph(tmp: Scratch, found: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (p, k, score) and confidences of strings (v, k, conf)."""
    seeds = found.select(F.explode("seeds").alias("x")).select("x.*").join(patterns, "p", "left_semi")
    others = found.select(F.explode("others").alias("x")).select("x.p", "x.v").join(patterns, "p", "left_semi")
    edges = tmp.cut(seeds.select("p", "v").unionByName(others).groupBy("p", "v").agg(F.count(F.lit(1)).alias("n")))
    plain = found.where("base is null").select(F.explode("tally").alias("x")).select("x.*").groupBy("p").agg(F.sum("n").alias("n"))
    counted = edges.groupBy("p").agg(F.sum("n").alias("n")).unionByName(plain.join(patterns, "p", "left_semi"))
    places = tmp.cut(counted.groupBy("p").agg(F.sum("n").alias("n")))
    first = tmp.cut(seeds.select("v", "k").distinct().withColumn("conf", F.lit(1.0)))
    conf = first
    for _ in range(ROUNDS):
        held = edges.join(conf, "v").groupBy("p", "k").agg(F.sum(F.col("conf") * F.col("n")).alias("held"))
        # summed in whatever order, so rounded before it is compared
        scores = tmp.cut(held.join(places, "p").select("p", "k", F.round(F.col("held") / F.col("n"), 9).alias("score")))
        open_ = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("score"))))
        gained = edges.join(scores.where(F.col("score") >= RIGHT), "p").groupBy("v", "k").agg((1 - F.exp(open_)).alias("conf"))
        gained = gained.withColumn("conf", F.round("conf", 9)).join(first.select("v"), "v", "left_anti")
        conf = tmp.cut(first.unionByName(gained))
    return scores, conf


def text_of(spans: str | Column) -> Column:
    """kind:start:end of a sorted list of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, (x["k"] + 1).cast("int")), x["start"], x["stop"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: lists of start, k (number of the kind in KINDS) and stop, sorted; added ones also have conf."""
    tmp = Scratch(docs.sparkSession, "pii")
    texts = docs.select(*id_and_text(docs))
    seeds = texts.select("text").mapInArrow(_seeds, "p bigint, k bigint, v bigint").distinct()
    patterns = tmp.cut(seeds.groupBy("p", "k").agg(F.count("v").alias("n")).where(F.col("n") >= MIN_SEEDS).select("p").distinct())
    found = tmp.cut(texts.mapInArrow(searched(bitmap(patterns)), SEARCHED).withColumn("rid", F.monotonically_increasing_id()))
    scores, conf = graph(tmp, found, patterns)
    places = found.select("rid", F.explode("others").alias("x")).select("rid", "x.*")
    sure = places.join(scores.where(F.col("score") >= RIGHT), "p").join(conf.where(F.col("conf") >= SURE), ["v", "k"])
    best = sure.groupBy("rid", "start", "stop").agg(F.max(F.struct("conf", (-F.col("k")).alias("k"))).alias("b"))
    best = best.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("b.k")).alias("k"), "stop", F.col("b.conf").alias("conf")))).alias("added"))
    none = F.array().cast("array<struct<start:bigint,k:bigint,stop:bigint,conf:double>>")
    return found.where("base is not null").select("rid", "doc_id", "base").join(best, "rid", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base, spans: base and all spans as kind:start:end."""
    found = personal_data(docs)
    kinds = F.transform("base", lambda x: x["k"])
    counts = [F.size(F.filter(kinds, lambda k: k == F.lit(i))).cast("bigint").alias(f"n_{name}") for i, name in enumerate(KINDS)]
    added = F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["stop"].alias("stop")))
    return found.select("doc_id", *counts, text_of("base").alias("base"), text_of(F.array_sort(F.concat("base", added))).alias("spans"))
