"""Fill-in-the-middle: texts become prefix, suffix and middle, marked by sentinels, at cuts drawn from the document's id.

One table-driven automaton reads a text's bytes once. Its state holds the bytes that a UTF-8 sequence still lacks, what
the last byte says about unit boundaries and the prefix of a sentinel just read; its transitions emit "a unit starts
here" and "a sentinel ends here". Texts are dealt into blocks that advance together, a byte of every block at a time.
Since the state depends on a few bytes only, a block other than a text's first starts that many bytes early, silently.
The first pass counts the unit transitions of each block; the second runs only the two blocks that hold the cuts.

Defined results: a null text is empty; a null doc_id draws as an empty one; a byte that is no valid UTF-8 is a unit of its
own; rows that share an id are drawn alike, each on its own text; columns other than doc_id and text don't count. Texts
of any length are read whole, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytesnp import SPACE, binaries, column, pieces, released
from tidemark.llm.store import id_and_text

#: Prefix, suffix and middle follow these.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a block.
BLOCK = 512
UNIT = 1
OUT = "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output string"


class Machine(NamedTuple):
    #: By state * 256 + byte: the next state; UNIT and twice the number of the sentinel (from 1) that ends here.
    to: np.ndarray
    emits: np.ndarray
    first: int
    later: int
    #: Bytes that determine the state.
    back: int


@lru_cache
def machine(sentinels: tuple[str, ...] = SENTINELS, unit: str = "char") -> Machine:
    """unit: char (a code point), word (with the white space after it) or line (with its end)."""
    marks = [s.encode() for s in sentinels]
    heads = {m[:i] for m in marks for i in range(len(m) + 1)}

    def read(seen: bytes, b: int) -> tuple[bytes, int]:
        seen += bytes([b])
        ends = [k for k, m in enumerate(marks, 1) if seen.endswith(m)]
        while seen not in heads:
            seen = seen[1:]
        return seen, max(ends, key=lambda k: len(marks[k - 1]), default=0)

    def step(state: tuple[bytes, int, bool], b: int) -> tuple[tuple[bytes, int, bool], int]:
        seen, lacks, edge = state
        seen, mark = read(seen, b)
        inside = lacks > 0 and 0x80 <= b < 0xC0
        lacks = lacks - 1 if inside else 0 if b < 0xC0 or b >= 0xF8 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
        if unit == "char":
            starts, edge = not inside, False
        elif unit == "word":
            starts, edge = edge and not inside and not SPACE[b], SPACE[b] or (edge and inside)
        else:
            starts, edge = edge and not inside, b == 0x0A
        return (seen, lacks, bool(edge)), UNIT * bool(starts) + 2 * mark

    opening, later = (b"", 0, None), (b"", 0, False)
    ids = {opening: 0, later: 1}
    to, emits, todo = [], [], [opening, later]
    for state in todo:
        for b in range(256):
            after, emitted = step(later if state is opening else state, b)
            if after not in ids:
                ids[after] = len(ids)
                todo.append(after)
            to.append(ids[after])
            emits.append(emitted | UNIT if state is opening else emitted)
    kind = np.uint8 if len(ids) < 256 else np.int32
    return Machine(np.array(to, kind), np.array(emits, np.uint8), 0, 1, max([3, *map(len, marks)]))


class Blocks(NamedTuple):
    """Pieces of texts, longest first."""

    row: np.ndarray
    start: np.ndarray
    size: np.ndarray
    opens: np.ndarray


def blocks(off: np.ndarray) -> Blocks:
    sizes = np.diff(off)
    count = -(-sizes // BLOCK)
    row = np.repeat(np.arange(len(sizes)), count)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * BLOCK
    size = np.minimum(BLOCK, sizes[row] - at)
    order = np.argsort(-size, kind="stable")
    return Blocks(row[order], (off[:-1][row] + at)[order], size[order], (at == 0)[order])


def run(m: Machine, buf: np.ndarray, b: Blocks) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in a block, what the blocks that reach it emit; these are the first ones."""
    state = np.where(b.opens, m.first, m.later).astype(np.int32)
    inner = np.flatnonzero(~b.opens)
    for j in range(-m.back, 0):
        state[inner] = m.to[state[inner] * 256 + buf[b.start[inner] + j]]
    reach = np.searchsorted(-b.size, -np.arange(BLOCK), "left")
    for j in range(BLOCK):
        n = reach[j]
        if not n:
            return
        k = state[:n] * 256 + buf[b.start[:n] + j]
        state[:n] = m.to[k]
        yield j, m.emits[k]


def scan(m: Machine, buf: np.ndarray, off: np.ndarray) -> tuple[Blocks, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first pass: blocks, units that start in each, and row, end and number of every sentinel in order of place."""
    b = blocks(off)
    units, hits = np.zeros(len(b.row), np.int64), []
    for j, e in run(m, buf, b):
        units[: len(e)] += e & UNIT
        k = np.flatnonzero(e > UNIT)
        if len(k):
            hits.append((b.row[k], b.start[k] + j + 1, e[k] >> 1))
    row, end, mark = (np.concatenate(x) if hits else np.zeros(0, np.int64) for x in (zip(*hits) if hits else ((), (), ())))
    order = np.argsort(end, kind="stable")
    return b, units, row[order], end[order], mark[order]


def place(m: Machine, buf: np.ndarray, off: np.ndarray, b: Blocks, units: np.ndarray, row: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The second pass: the byte at which unit number `unit` of each `row` starts; the row's end for the number after the last."""
    order = np.argsort(b.start)
    ahead = np.concatenate([[0], np.cumsum(units[order])])
    begin = np.searchsorted(b.start[order], off[row])
    wanted = ahead[begin] + unit
    at = np.searchsorted(ahead, wanted, "right") - 1
    out = off[row + 1].copy()
    inside = np.flatnonzero((at < len(order)) & (wanted < ahead[np.searchsorted(b.start[order], off[row + 1])]))
    chosen = order[at[inside]]
    longest = np.argsort(-b.size[chosen], kind="stable")
    inside, chosen = inside[longest], chosen[longest]
    left = wanted[inside] - ahead[at[inside]]
    for j, e in run(m, buf, Blocks(*(x[chosen] for x in b))):
        n = len(e)
        found = (left[:n] == 0) & ((e & UNIT) > 0)
        out[inside[:n][found]] = b.start[chosen[:n]][found] + j
        left[:n] -= e & UNIT
    return out


def drawn(seed: int) -> list[Column]:
    """Four 32-bit draws from the digest of seed:doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def _texts(rows: list[bytes]) -> pa.Array:
    return binaries(rows).view(pa.string())


def transform(docs: DataFrame, seed: int = 1, sentinels: tuple[str, ...] = SENTINELS, unit: str = "char", rate: int = 90, spm: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null if plain), output of each row. Of 100 draws, rate are
    transformed and of these spm have the suffix first; empty texts and texts that hold a sentinel stay plain."""
    m = machine(sentinels, unit)
    marks = [s.encode() for s in sentinels]

    @released
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, ends = column(batch, "text")
            h = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)]
            for i, j, buf, off in pieces(whole, ends):
                b, units, hit, _, _ = scan(m, buf, off)
                n = np.bincount(b.row, units, j - i).astype(np.int64)
                one, two, three, four = (x[i:j] for x in h)
                plain = (n == 0) | (three % 100 >= rate)
                plain[hit] = True
                cuts = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
                rows = np.flatnonzero(~plain)
                low, high = (place(m, buf, off, b, units, rows, c[rows]) for c in cuts)
                data, out = buf.tobytes(), []
                low, high = dict(zip(rows.tolist(), low.tolist())), dict(zip(rows.tolist(), high.tolist()))
                swapped = four % 100 < spm
                for r, (start, end) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    if plain[r]:
                        out.append(data[start:end])
                        continue
                    x, y = low[r], high[r]
                    prefix, suffix = marks[0] + data[start:x], marks[1] + data[y:end]
                    out.append((suffix + prefix if swapped[r] else prefix + suffix) + marks[2] + data[x:y])
                form = np.where(plain, "plain", np.where(swapped, "spm", "psm"))
                size = [pa.array(v, pa.int64(), mask=plain) for v in (cuts[0], cuts[1] - cuts[0])]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n), pa.array(form, pa.string()), *size, _texts(out)], names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return docs.select(*id_and_text(docs), *drawn(seed)).mapInArrow(apply, OUT)


def restore(made: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """made with the column `restored`: the text that each output came from, found from output and form alone. A
    transformed output has the sentinels once each, as its text has none and no sentinel ends in the start of another."""
    m = machine(sentinels)
    kinds = {f: i for i, f in enumerate(("plain", "psm", "spm"))}
    names = [*made.columns, "restored"]

    @released
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, ends = column(batch, "output")
            form = np.array([kinds[f] for f in batch.column(batch.schema.get_field_index("form")).to_pylist()], np.int64)
            for i, j, buf, off in pieces(whole, ends):
                _, _, hit, end, mark = scan(m, buf, off)
                data, out = buf.tobytes(), []
                first = np.searchsorted(hit, np.arange(j - i + 1))
                for r, (start, stop) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    if form[i + r] == 0:
                        out.append(data[start:stop])
                        continue
                    found = range(first[r], first[r + 1])
                    begins = [int(end[k]) for k in found]
                    closes = [int(end[k]) - len(sentinels[mark[k] - 1].encode()) for k in found][1:] + [stop]
                    part = {int(mark[k]): data[x:y] for k, x, y in zip(found, begins, closes)}
                    out.append(part[1] + part[3] + part[2])
                part = batch.slice(i, j - i)
                yield pa.record_batch([*part.columns, _texts(out)], names=names)

    schema = ", ".join([*(f"`{c}` {k}" for c, k in made.dtypes), "restored string"])
    return made.mapInArrow(apply, schema)
