"""Fill-in-the-middle against a plain version."""

import hashlib
import re

import numpy as np
import pytest

from tidemark.llm import fim

ALPHABET = ["a", "é", "€", "😀", " ", "\n", "<", "P", ">", "<S", "S>", "b"]
UNITS = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}


def plain(doc_id, text, unit="char"):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(UNITS[unit], text)
    n = len(units)
    if not n or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = np.random.default_rng(5)
    out = ["".join(rng.choice(ALPHABET, n)) for n in rng.choice([1, 2, 5, 80, 511, 512, 513, 3000], 150)]
    return [*out, None, "", "é" * 700_000, "x<P>y", "<P", "€", *out[:3]]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_against_plain(spark, unit):
    rows = [(None if i == 7 else i % 140, t, "other") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    made = fim.restore(fim.transform(docs, unit=unit)).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.restored) for r in made), key=str)
    want = sorted(((i, *plain(i, t, unit), t or "") for i, t, _ in rows), key=str)
    assert got == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_other_sentinels(spark):
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    docs = spark.createDataFrame([(i, f"a<|prefix|b{i}" if i % 5 else "x<|middle|>y") for i in range(60)], "doc_id long, text string")
    made = fim.restore(fim.transform(docs, sentinels=marks, rate=100, spm=50), sentinels=marks).collect()
    assert all(r.restored == (f"a<|prefix|b{r.doc_id}" if r.doc_id % 5 else "x<|middle|>y") for r in made)
    assert all((r.form == "plain") == (r.doc_id % 5 == 0) for r in made)


def test_bytes_that_are_not_utf8():
    m = fim.machine()
    buf = np.frombuffer(b"\x80a\xe2\x82\xac\xe2\x82b\xf8\x80", np.uint8)
    b, units, *_ = fim.scan(m, buf, np.array([0, len(buf)]))
    assert units.sum() == 7  # stray, a, euro, broken sequence, b, no lead byte, stray
    starts = fim.place(m, buf, np.array([0, len(buf)]), b, units, np.zeros(8, np.int64), np.arange(8))
    assert starts.tolist() == [0, 1, 2, 5, 7, 8, 9, 10]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(docs)).count() == 0
