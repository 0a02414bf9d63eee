"""The operators on documents against brute force, over awkward rows: nulls, empties, repeats, ties, other columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import decontaminate, fingerprint, langid, licenses, minhash, sentencepiece_np, suffixes, toxicity
from tidemark.llm.losertree import merge

rng = random.Random(5)
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ra", "ten", "ol") for c in ("", "s", "ing", "ed", "or")]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


BASE = [prose(rng.randint(30, 120)) for _ in range(14)]
PASSAGE = prose(20)
TEXTS = [*BASE, BASE[0], BASE[0], BASE[1].upper(), None, "", "   \n\t ", "one two", "one two", "one two three four", prose(2500), *[near(BASE[2], k) for k in (1, 1, 2, 3, 4)], *[near(BASE[3], k) for k in (1, 2, 8)], *[f"{prose(15)} {PASSAGE}\n{prose(9)}" for _ in range(5)], "é" * 40 + "ö" * 40, "x" + "é" * 40 + "ö" * 41, "ñandú ▁ ▁ \U0001f600 tab\tand\x00nul", "aaaaaaaa" * 30, "aaaaaaaa" * 20]
ROWS = [(i * 3 + 1, t, "en" if i % 2 else "fr", f"s{i % 3}", i) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    # columns whose names the operators use inside
    return df.withColumn("u", F.lit(1)).withColumn("key", F.lit("k")).withColumn("rep", F.lit(2)).withColumn("tk", F.lit(3)).withColumn("block", F.lit(9))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    sets = {r[0]: shingle_set(r[1], k) for r in ROWS}
    want = components(sets)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, shingle=k).collect()}
    assert set(got) == set(want)
    for i, c in want.items():
        assert (got[i]["component_id"], got[i]["n_shingles"], got[i]["kept"]) == (c, len(sets[i]), i == c)


def test_near_duplicates_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, BASE[0], "en", "s", 1), (5, BASE[0], None, None, None), (5, BASE[0], "en", "s", 1), (2, BASE[0], "en", "s", 1)], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False)]
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_search_joins_across_components_only():
    import numpy as np

    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(14, 114, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    sig = np.zeros((4, minhash.BANDS * minhash.ROWS), np.uint8)
    links = minhash.search(np.array([10, 20, 30, 40]), np.array([10, 10, 30, 40]), sig, sets, 80, 0.6)
    assert links == [(20, 30)]


def repeats(rows, window=50):
    first, out = {}, {}
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, text, *_ in ordered:
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            first.setdefault(b[p : p + window], i)
    for i, text, *_ in ordered:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < i:
                gone[p : p + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.repeated_bytes(docs).collect()}
    assert got == repeats(ROWS)


def test_repeated_bytes_null_ids_repeats_and_empty(spark):
    text = PASSAGE + " tail of its own"
    df = spark.createDataFrame([(None, text, "en", "s", 1), (3, text, "en", "s", 1), (3, "other head " + text, "en", "s", 1), (9, "third " + PASSAGE, "en", "s", 1)], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in suffixes.repeated_bytes(df).collect())
    # the two bytes before the passage are common too
    assert got == [(-1, 0), (3, 0), (3, 0), (9, len(PASSAGE) + 2)]
    assert suffixes.repeated_bytes(empty(spark)).count() == 0


def test_loser_tree_orders_and_keeps_prefix_lengths():
    runs = []
    for _ in range(5):
        keys = sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 30)))
        shared = [next((i for i in range(6) if a[i] != b[i]), 6) if k else 0 for k, (a, b) in enumerate(zip([b"------", *keys], keys))]
        runs.append((keys, shared))
    out = [(runs[r][0][i], n) for r, i, n in merge(runs)]
    assert [k for k, _ in out] == sorted(k for keys, _ in runs for k in keys)
    for (a, _), (b, n) in zip(out, out[1:]):
        assert n == next((i for i in range(6) if a[i] != b[i]), 6)


ITEMS = [(1, PASSAGE), (2, prose(30)), (3, None), (4, "alpha beta gamma"), (5, "solo")]


def brute_coverage(item, doc, least=3):
    """Greedy tiling by trying every match, longest first."""
    split = lambda t: re.findall(r"[A-Za-z0-9\x80-￿]+", (t or "").translate(FOLD))
    a, b = split(item), split(doc)
    if not a:
        return 0.0
    if len(a) < least:
        return float(any(b[j : j + len(a)] == a for j in range(len(b))) and len(b) >= least) if len(b) >= least else float(a == b)
    marked_a, marked_b = set(), set()
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return len(marked_a) / len(a)
        marked_a |= set(range(best[1], best[1] + best[0]))
        marked_b |= set(range(best[2], best[2] + best[0]))


def test_contamination(spark):
    half = PASSAGE.split(" ")
    moved = " ".join(half[10:] + half[:10])
    rows = [(1, f"{prose(8)} {PASSAGE.upper()}, {prose(5)}", "en", "s", 1), (2, f"{prose(30)} {moved} x", "en", "s", 1), (3, " ".join(half[:6]), "en", "s", 1), (4, None, "en", "s", 1), (None, PASSAGE, "en", "s", 1), (6, "so Alpha-beta gamma; so", None, None, None), (7, prose(400), "en", "s", 1)]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), items).collect()}
    want = {(d[0], i): c for d in rows for i, t in ITEMS if (c := brute_coverage(t, d[1])) >= 0.5 and i != 5}
    assert {k: round(v, 6) for k, v in found.items()} == {k: round(v, 6) for k, v in want.items()}
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), items.limit(0)).count() == 0


def test_contamination_by_short_items(spark):
    items = [(1, PASSAGE), (3, "  "), (4, "alpha beta gamma"), (5, "solo"), (6, "Delta echo"), (7, "solo")]
    rows = [(1, f"{prose(9)} Solo, {prose(5)} solo", "en", "s", 1), (2, "solo", "en", "s", 1), (3, "say delta-Echo now", "en", "s", 1), (4, "delta echo", "en", "s", 1), (5, "echo delta", "en", "s", 1), (6, "delta and echo, alpha beta gamma", "en", "s", 1), (7, f"{PASSAGE} solo", "en", "s", 1), (8, "one solo", "en", "s", 1)]
    out = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in out}
    assert len(got) == len(out)
    assert got == {k: (1.0, 1) for k in [(1, 5), (1, 7), (2, 5), (2, 7), (3, 6), (4, 6), (6, 4), (7, 1), (7, 5), (7, 7), (8, 5), (8, 7)]}
    assert {(r["doc_id"], r["item_id"]): r["tiles"] for r in out}[3, 6] == [[1, 2]]
    assert {(d[0], i) for d in rows for i, t in items if brute_coverage(t, d[1], min(3, len((t or "").split()))) >= 0.5} == set(got)


def test_contamination_of_repetitive_and_long_texts(spark):
    """Few different words, so that seeds pair up in many ways; one very long text; columns of the operator's own names."""
    from pyspark.sql import functions as F

    few = lambda n: " ".join(rng.choice(("a", "b")) for _ in range(n))
    items = [(1, few(14)), (2, "x " * 40), (3, few(9)), (4, PASSAGE)]
    rows = [(i, few(rng.randint(5, 60)), "en", "s", 1) for i in range(25)] + [(100, "x " * 130, None, None, None), (101, prose(20_000) + " " + PASSAGE, "en", "s", 1), (102, "x " * 19, "en", "s", 1), (102, "x " * 20, "en", "s", 1)]
    table = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("c").alias(c) for c in ("item_id", "tiles", "coverage")])
    out = decontaminate.contaminated(table, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = sorted((r["doc_id"], r["item_id"], round(r["coverage"], 6)) for r in out)
    want = [(d[0], i, round(c, 6)) for d in rows if d[0] != 101 for i, t in items if (c := brute_coverage(t, d[1])) >= 0.5]
    assert got == sorted([*want, (101, 4, 1.0)])


def test_one_word_repeated_takes_few_runs():
    import numpy as np

    seeds = decontaminate.Seeds([1], ["go " * 300], 3)
    words = np.full(20_000, decontaminate.tokens(np.frombuffer(b"go", np.uint8), np.array([0, 2]))[0][0])
    h, at = decontaminate.B.shingles(words, np.array([0, len(words)]), 3)
    assert [(r, k, t) for r, k, t in decontaminate.matches(seeds, h, at, 0.5)] == [(0, 0, [(0, 0, 300)])]
    slot = np.zeros(len(h), np.int64)
    assert len(decontaminate.runs(slot, np.arange(len(h)), seeds.own_slot, seeds.own_place)) == len(h) + len(seeds.own_slot) - 1


def test_rows_are_judged_one_by_one(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    rows = [(None, PASSAGE, "en", "s", 1), (None, "fine", "en", "s", 2), (7, PASSAGE, "en", "s", 3), (7, "fine too", None, "s", 4), (8, None, "en", "s", 5)]
    left = decontaminate.without_contaminated(spark.createDataFrame(rows, SCHEMA), items)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r["n_chars"] for r in left.collect()) == [2, 4, 5]


def test_slices_of_the_benchmark_one_by_one(spark, monkeypatch):
    texts = [prose(30) for _ in range(12)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    rows = [(i, f"{prose(20)} {texts[i]} {prose(10)}" if i < 9 else prose(40), "en", "s", i) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).select("doc_id", "item_id", "covered").collect()))
    assert [(i, i) for i in range(9)] == [w[:2] for w in whole]
    monkeypatch.setattr(decontaminate, "SLICE", 500)
    assert len(decontaminate.slices(items)) > 3
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).select("doc_id", "item_id", "covered").collect())) == whole
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(docs, items).collect()) == list(range(9, 20))


def plain_sums(strings, probs, single, text, k):
    """log of the sum over all segmentations of each prefix, byte by byte in logarithms."""
    import math

    import numpy as np

    out = [0.0]
    for j in range(1, len(text) + 1):
        terms = [out[j - 1] + math.log(single[text[j - 1], k])]
        terms += [out[j - len(s)] + math.log(probs[i, k]) for i, s in enumerate(strings) if text[:j].endswith(s)]
        out.append(float(np.logaddexp.reduce(terms)))
    return out


@pytest.mark.parametrize("length", [1, 8, 63, 64, 70, 100, 101, 5000])
def test_sums_of_long_words(length):
    import numpy as np

    from tidemark.llm import pieces

    strings = [b"a", b"b", b"ab", b"aba", b"ba"]
    vocab = pieces.Pieces(strings, list(range(10, 15)), [-1.0] * 5, list(range(100, 356)))
    probs, single = np.array([[0.2, 0.1], [0.1, 0.3], [0.3, 0.2], [0.2, 0.2], [0.1, 0.1]]), np.full((256, 2), 1e-6)
    # covered by pieces, by none (as a language of another script), and a mixture
    rows = [bytes(rng.choice(b"ab") for _ in range(length)), bytes(rng.choice(b"xyz") for _ in range(length)), bytes(rng.choice(b"abxyz") for _ in range(length))]
    got = pieces.forward(vocab, probs, single, np.array([list(r) for r in rows], np.uint8))
    for row, g in zip(rows, got):
        for k in range(2):
            assert g[k] == pytest.approx(plain_sums(strings, probs, single, row, k)[-1], rel=1e-9)
    weight = np.array([[1.0, 2.0], [3.0, 1.0], [1.0, 0.0]])
    uses = pieces.expected(vocab, probs, single, np.array([list(r) for r in rows], np.uint8), weight)
    want = np.zeros_like(uses)
    for row, w in zip(rows, weight):
        for k in range(2):
            before = plain_sums(strings, probs, single, row, k)
            after = plain_sums([s[::-1] for s in strings], probs, single, row[::-1], k)[::-1]
            for i, s in enumerate(strings):
                for j in range(len(s), length + 1):
                    if row[:j].endswith(s):
                        want[i, k] += w[k] * np.exp(before[j - len(s)] + np.log(probs[i, k]) + after[j] - before[-1])
    assert np.allclose(uses, want, rtol=1e-7)


def test_language_without_spaces(spark):
    """Each text is one word of 60 to 400 bytes, in two languages of one script."""
    signs = {"p": "山川草木日月火水", "q": "金土人口目耳手足"}
    rows = [(i, "".join(rng.choice(signs["pq"[i % 2]]) for _ in range(rng.randint(20, 130))), "pq"[i % 2], "s", 1) for i in range(90)]
    rows += [(500 + i, "".join(rng.choice(signs["pq"[i % 2]]) for _ in range(2000)), None, "s", 1) for i in range(2)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "pq"[i % 2] for i, *_ in rows}


def test_language_of_a_long_text_beside_clashing_columns(spark):
    from pyspark.sql import functions as F

    en, fr = "the cat with other things that were".split(), "les chats avec une chose qui était là".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(20)), "en" if i % 2 else "fr", "s", 1) for i in range(60)] + [(99, " ".join(rng.choice(fr) for _ in range(40_000)), None, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("word", "n", "k", "slot", "score", "lang_pred", "held_out")])
    got = langid.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()}[99] == "fr"


def test_encoding_round_trip(docs, spark):
    out = sentencepiece_np.encode(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] and r["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in rows.items())
    assert {r["doc_id"]: r["text"] for r in sentencepiece_np.decode(out).collect()} == texts
    assert sentencepiece_np.encode(empty(spark)).count() == 0


def test_viterbi_is_best():
    import numpy as np

    from tidemark.llm.pieces import Pieces, viterbi

    strings = [b"a", b"b", b"ab", b"aba", b"ba", b"bb", b"abab"]
    scores = [-2.0, -2.5, -3.0, -4.1, -3.2, -4.9, -6.5]
    vocab = Pieces(strings, list(range(10, 17)), scores, list(range(100, 356)))
    value = dict(zip(strings, scores))

    def best(t):
        return 0 if not t else max(value[s] + best(t[len(s) :]) for s in strings if t.startswith(s))

    rows = np.array([[rng.choice(b"ab") for _ in range(9)] for _ in range(40)], np.uint8)
    ids, count = viterbi(vocab, rows)
    at = 0
    for row, n in zip(rows, count):
        own = [strings[i - 10] for i in ids[at : at + n]]
        at += n
        assert b"".join(own) == row.tobytes()
        assert sum(value[s] for s in own) == pytest.approx(best(row.tobytes()))


def test_forward_sums_all_segmentations():
    import numpy as np

    from tidemark.llm.pieces import Pieces, expected, forward

    strings = [b"a", b"b", b"ab", b"ba", b"aab"]
    vocab = Pieces(strings, list(range(5)), [-1.0] * 5, list(range(100, 356)))
    probs = np.array([[0.3, 0.1], [0.2, 0.2], [0.25, 0.3], [0.15, 0.2], [0.05, 0.1]])
    single = np.full((256, 2), 1e-12)
    rows = np.array([[rng.choice(b"ab") for _ in range(7)] for _ in range(20)], np.uint8)

    def total(t, k):
        return 1.0 if not t else sum(probs[i, k] * total(t[len(s) :], k) for i, s in enumerate(strings) if t.startswith(s))

    got = np.exp(forward(vocab, probs, single, rows))
    for row, p in zip(rows, got):
        assert p == pytest.approx([total(row.tobytes(), 0), total(row.tobytes(), 1)])
    uses = expected(vocab, probs, single, rows, np.ones((20, 2)))
    lengths = np.array([len(s) for s in strings])
    assert (uses * lengths[:, None]).sum(axis=0) == pytest.approx([140, 140])


def test_language(spark):
    en, fr = "the cat with other things that were", "les chats avec une chose qui était là"
    rows = [(i, " ".join(rng.choice((en if i % 2 else fr).split()) for _ in range(25)), "en" if i % 2 else "fr", "s", 1) for i in range(80)]
    rows += [(200, None, "en", "s", 1), (201, "12 34 !?", "en", "s", 1), (None, en, "en", "s", 1), (203, fr, None, "s", 1)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x, *_ in rows[:80])
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows if i is not None)
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und" and got[203]["lang_pred"] == "fr" and got[None]["held_out"] is False
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows[-1:], SCHEMA)).collect()} == {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(160):
        w = prose(rng.randint(10, 60)).split(" ")
        if i % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(("zorgish", "zorgen", "blarg"))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, None if i == 5 else 1, int(i % 3 == 0)))
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, prose(5000) + " zorgling " + prose(3000), "en", "s", 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), table).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    right = sum(got[i]["predicted"] == int(i % 3 == 0) for i in held)
    assert right >= 0.85 * len(held)
    assert got[900]["score"] == got[901]["score"] == 0 and got[902]["score"] > got[901]["score"]
    assert toxicity.toxicity(empty(spark), table).count() == 0
    assert {r["score"] for r in toxicity.toxicity(spark.createDataFrame(rows[:3], SCHEMA), table.limit(0)).collect()} == {0.0}


def raw(texts):
    import numpy as np

    b = [t.encode() for t in texts]
    return np.frombuffer(b"".join(b), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in b])]).astype(np.int64)


def test_toxicity_scores_against_a_plain_network(spark):
    """Window by window and word by word, in plain loops, on an empty and a very long text too; columns of clashing names."""
    import numpy as np
    from pyspark.sql import functions as F

    T = toxicity
    texts = [prose(rng.randint(1, 70)) for _ in range(12)] + ["", prose(3000)]
    seen = T.Words(*raw(texts[:12]))
    known = (np.unique(seen.hash), np.unique(seen.gram_hash))
    p = T.start(len(known[0]), len(known[1])) | {"known": known}
    p = {k: v if k == "known" else (v * 3).astype(np.float32) for k, v in p.items()}
    got = T.score_rows(p, *raw(texts))

    def gru(xs, d):
        h, out = np.zeros(T.HIDDEN), []
        for x in xs:
            g, s = x @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
            z, r = (1 / (1 + np.exp(-(g[a : a + T.HIDDEN] + s[a : a + T.HIDDEN]))) for a in (0, T.HIDDEN))
            c = np.tanh(g[2 * T.HIDDEN :] + r * s[2 * T.HIDDEN :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    for text, score in zip(texts, got):
        words = re.findall(r"[A-Za-z0-9\x80-\uffff]+", text)
        if not words:
            assert score == 0
            continue
        vectors = [T.Words(*raw([x]), known).vectors(p)[0].astype(float) for x in words]
        starts = list(range(0, max(1, len(words) - T.WINDOW + 1), T.STRIDE))
        if len(words) > T.WINDOW and starts[-1] != len(words) - T.WINDOW:
            starts.append(len(words) - T.WINDOW)
        best = -np.inf
        for a in starts:
            xs = vectors[a : a + T.WINDOW]
            states = np.array([np.concatenate([f, b]) for f, b in zip(gru(xs, "f"), gru(xs[::-1], "b")[::-1])])
            e = np.tanh(states @ p["A"] + p["a"]) @ p["v"]
            alpha = np.exp(e - e.max())
            best = max(best, float((alpha / alpha.sum()) @ states @ p["w"] + p["o"][0]))
        assert score == pytest.approx(1 / (1 + np.exp(-best)), abs=2e-4)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("toxic", "held_out", "score", "predicted", "all")])
    labels = spark.createDataFrame([(i, 1, i % 2, 7) for i in range(12)], "doc_id bigint, quality int, toxic int, text int")
    out = T.toxicity(df, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows)


def test_gradients_match_differences():
    import numpy as np

    g = np.random.Generator(np.random.PCG64(1))
    p = {k: v.astype(np.float64) for k, v in toxicity.start(3, 3).items()}
    x = g.standard_normal((7, toxicity.WIDTH))
    at, mask = g.integers(0, 7, (5, 6)), np.arange(5)[:, None] < np.array([5, 4, 3, 2, 5, 1])
    y = np.array([1, 0, 1, 0, 1, 0])

    def loss(q, x):
        xs = x[at]
        states = np.concatenate([toxicity.recur((xs @ q[f"W{d}"] + q[f"c{d}"]), mask, q[f"U{d}"], d == "b") for d in "fb"], axis=2)
        z = toxicity.pool(states.astype(np.float64), mask, q)[3]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grads, dx = toxicity.gradients(p, x, at, mask, y, np.ones(6))
    eps = 1e-2
    for name in ("Wf", "Ub", "A", "v", "w", "cf"):
        i = (0,) * p[name].ndim
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][i] += eps
        down[name][i] -= eps
        assert grads[name][i] == pytest.approx((loss(up, x) - loss(down, x)) / (2 * eps), abs=2e-4)
    up, down = x.copy(), x.copy()
    up[at[0, 0], 2] += eps
    down[at[0, 0], 2] -= eps
    assert dx[at[0, 0], 2] == pytest.approx((loss(p, up) - loss(p, down)) / (2 * eps), abs=2e-4)


def test_fingerprints(docs, spark):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    rows = sorted((r[0], r[1] or "") for r in ROWS)
    by_text = defaultdict(set)

    def bag(t):
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    gaps = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        by_text[t].add(got[i]["fingerprint"])
        for other, name in ((e, "near_edited"), (n, "near_next")):
            a, b = bag(t), bag(other)
            gaps.append(got[i][name] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(abs(g) for g in gaps) / len(gaps) < 0.03 and max(map(abs, gaps)) < 0.2
    one = fingerprint.fingerprints(spark.createDataFrame([(4, "a b c d e f g h", "en", "s", 1)], SCHEMA)).first()
    assert one["near_next"] == 1.0
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "x y", "en", "s", 1), (7, None, "en", "s", 1), (7, "p q r s t u", "en", "s", 1), (2**62, "z", "en", "s", 1), (-(2**40), "y", "en", "s", 1)], SCHEMA)
    assert sorted(r["n_chars"] for r in fingerprint.fingerprints(odd).collect()) == [0, 1, 1, 3, 11]


def test_licenses(spark):
    mit = "Released under the MIT License."
    files = [(1, "a/LICENSE", mit), (2, "a/b/c.py", prose(30)), (3, "a/b/d.py", prose(5) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(9)), (4, "x/y.py", prose(20)), (5, None, mit), (6, "a/b/deep/LICENSE.txt", "Licensed under CC BY-NC 4.0."), (7, "a/b/deep/er/z", None), (8, "top", "all rights reserved"), (9, "other", "")]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    got = {r["doc_id"]: (r["license"], r["found"], r["licensed_by"]) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "header", None), 4: ("Proprietary", "inherited", ""), 5: ("MIT", "file", None), 6: ("CC-BY-NC-4.0", "file", None), 7: ("CC-BY-NC-4.0", "inherited", "a/b/deep"), 8: ("Proprietary", "file", None), 9: ("Proprietary", "inherited", "")}
    assert licenses.scan(df.limit(0)).count() == 0


def commented(text, mark="# "):
    return "\n".join((mark + line).rstrip() for line in text.split("\n"))


GPL_END = "\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.\n\nYou should have received a copy of the license along with this program.\n"
HEADERS = {
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n" + GPL_END,
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n" + GPL_END,
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n" + GPL_END,
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU Affero General Public License as published by the Free\nSoftware Foundation, either version 3 of the License, or any later version.\n",
    "Apache-2.0": "Copyright 2020 Some Author\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
}


def test_whole_licences_and_headers_of_several_lines(spark):
    """Whole public texts with a copyright line, and commented headers over code, each by its own name."""
    from pyspark.sql import functions as F

    texts = licenses.licence_templates()
    whole = [(f"{name}/LICENSE", "Copyright (c) 2021 Jane Q. Example\n\n" + texts[name][-1], name) for name in texts if len(texts[name][-1]) > 600]
    assert {n for _, _, n in whole} == {"Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense"}
    heads = [(f"src/{name}.py", commented(text) + "\n\n" + "\n".join(f"x{k} = {prose(6)}" for k in range(40)), name) for name, text in HEADERS.items()]
    plain = [(f"{name}/sub/{k}.py", prose(80), name) for name in ("MIT", "LGPL-2.1") for k in range(2)] + [("src/none.py", prose(20_000), None)]
    rows = [(k, p, t) for k, (p, t, _) in enumerate(whole + heads + plain)]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string").select("*", *[F.lit("x").alias(c) for c in ("own", "whole", "from", "dir", "n", "cosine")])
    got = {r["path"]: r for r in licenses.scan(df).collect()}
    assert {p: got[p]["license"] for p, _, _ in whole + heads + plain} == {p: n for p, _, n in whole + heads + plain}
    assert all(got[p]["found"] == "file" and got[p]["cosine"] > 0.9 for p, *_ in whole) and all(got[p]["found"] == "header" for p, *_ in heads)


def test_cosines_against_plain_vectors():
    import math
    from collections import Counter

    import numpy as np

    templates = {"A": ["some words of a licence", "other words here"], "B": ["words of another licence some words"]}
    split = lambda t: re.findall(r"[A-Za-z0-9\x80-￿]+", t.translate(FOLD))
    bag = lambda t: Counter([*split(t), *zip(split(t), split(t)[1:])])
    flat = [(n, bag(t)) for n, ts in sorted(templates.items()) for t in sorted(ts)]
    index = licenses.Index(templates)
    terms = sorted({t for _, c in flat for t in c}, key=str)
    weight = {t: 1.0 + k / 7 for k, t in enumerate(terms)}
    probe = licenses.Words
    idf = np.zeros(len(index.keys))
    for t in terms:
        text = (t if isinstance(t, str) else " ".join(t)).encode()
        idf[index.slots(probe(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hash[-1:])[0]] = weight[t]
    index.weigh(idf, 2.5)
    texts = ["Some words of the licence, of another licence", "nothing known", "words words words of", "other words here"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    w = probe(np.frombuffer(b"".join(raw), np.uint8), off)
    unit, top, value = index.best(index.slots(w.hash), w.units(w.rows), len(texts), 0.0)
    got = {int(u): (index.names[t], c) for u, t, c in zip(unit, top, value)}

    def cosine(text, template):
        x = {t: (1 + math.log(n)) * weight[t] for t, n in bag(text).items() if t in weight}
        apart = sum(n for t, n in bag(text).items() if t not in weight)
        y = {t: (1 + math.log(n)) * weight[t] for t, n in template.items()}
        return sum(x[t] * y.get(t, 0) for t in x) / math.sqrt(sum(v * v for v in x.values()) + apart * 2.5**2) / math.sqrt(sum(v * v for v in y.values()))

    for k, text in enumerate(texts):
        if sum(n for t, n in bag(text).items() if t in weight) < 2:
            assert k not in got
            continue
        best = max(cosine(text, c) for _, c in flat)
        assert got[k][1] == pytest.approx(best) and got[k][0] == next(n for n, c in flat if cosine(text, c) >= best - 1e-12)


def test_quality(spark):
    from tidemark.llm import kneser_ney

    good = [(i, prose(rng.randint(20, 60)), ("en", "fr")[i % 2], "s", 1) for i in range(160)]
    bad = [(200 + i, "".join(rng.choice("#%&!zqxw") for _ in range(150)), "en", "s", 1) for i in range(8)]
    odd = [(300, None, None, None, None), (301, "", "en", "s", 1), (302, prose(30), None, "s", 1), (None, prose(30), "xx", "s", 1), (5, good[5][1], "fr", "s", 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(200, 0, 0), (201, None, None)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(good + bad + odd, SCHEMA)
    rows = kneser_ney.quality(docs, labels).collect()
    kept = {r["doc_id"] for r in rows if r["keep"]}
    assert len(rows) == len(good + bad + odd)
    assert not kept & {200 + i for i in range(8)} and not kept & {300, 301} and {302, None} <= kept and len(kept & set(range(160))) >= 155
    held = {r["doc_id"] for r in rows if r["held_out"]}
    assert held < set(range(160)) and 16 <= len(held) <= 50 and len(held & kept) >= len(held) - 1
    # the counts never see a held-out text: without its label it has the same perplexity
    out = min(held)
    again = {r["doc_id"]: r["perplexity"] for r in kneser_ney.quality(docs, labels.where(f"doc_id <> {out}")).collect()}
    assert again[out] == pytest.approx(next(r["perplexity"] for r in rows if r["doc_id"] == out), rel=1e-6)
    few = labels.where(f"doc_id in ({min(set(range(160)) - held)})")
    assert {r["held_out"] for r in kneser_ney.quality(docs, few).collect()} == {False}
    assert kneser_ney.quality(empty(spark), labels).count() == 0
    assert all(r["keep"] for r in kneser_ney.quality(docs, labels.limit(0)).collect() if r["n_bytes"])


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney of order 5 over bytes in dictionaries; gives the log probability of a text."""
    import math
    from collections import Counter

    padded = [bytes([2] * 4) + t.encode() for t in texts]
    tables = {5: Counter(t[i - 4 : i + 1] for t in padded for i in range(4, len(t)))}
    for n in (4, 3, 2):
        tables[n] = Counter(k[1:] for k in tables[n + 1])
    last = Counter(k[1:] for k in tables[2])
    total = sum(last.values())
    cuts = {}
    for n, table in tables.items():
        c = [sum(v == k for v in table.values()) for k in (1, 2, 3, 4)]
        if min(c) == 0:
            cuts[n] = (0, 0.5, 0.75, 0.9)
        else:
            y = c[0] / (c[0] + 2 * c[1])
            cuts[n] = (0, *[min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)])
    contexts = {n: defaultdict(list) for n in tables}
    for n, table in tables.items():
        for k, v in table.items():
            contexts[n][k[:-1]].append(v)

    def p(n, gram):
        if n == 1:
            return (last.get(gram[-1:], 0) + 0.5) / (total + 128)
        own = gram[-n:]
        seen = contexts[n].get(own[:-1])
        if not seen:
            return p(n - 1, gram)
        d = cuts[n]
        c = tables[n].get(own, 0)
        return (c - d[min(c, 3)]) / sum(seen) + sum(d[min(v, 3)] for v in seen) / sum(seen) * p(n - 1, gram)

    def logp(text):
        t = bytes([2] * 4) + text.encode()
        return sum(math.log(p(5, t[i - 4 : i + 1])) for i in range(4, len(t)))

    return logp, p


def test_kneser_ney_against_dictionaries(spark, monkeypatch):
    """Perplexities of whole texts, from several parts and salted shards; null ids, repeats, clashing columns, a long text."""
    from pyspark.sql import functions as F

    from tidemark.llm import kneser_ney as K

    monkeypatch.setattr(K, "ASKERS", 30_000)
    texts = [prose(rng.randint(1, 40)) for _ in range(30)] + ["é ñ 😀\x02\x00", prose(6000), "", None, "zzzz qqqq", "aaaa" * 50]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[1], "en", "s", 1), (4, texts[5], "en", "s", 1)]
    trusted = [1, 2, 4, 5, 6, 7, 8, 9, 30, 31, 35, 77]
    learnt = [r[1] for r in rows if r[0] in trusted]
    logp, p = plain_kneser_ney(learnt)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(3).alias(c) for c in ("part", "g", "keys", "n", "total")])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n"], round(r["total"], 2)) for r in K.scored(df, spark.createDataFrame([(i,) for i in trusted], "doc_id bigint")).collect())
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), round(logp(r[1] or ""), 2)) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-5, abs=0.02)
    assert sum(p(5, b"kara" + bytes([x])) for x in range(256)) == pytest.approx(1.0, abs=1e-3)
