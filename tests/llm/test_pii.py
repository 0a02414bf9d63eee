"""Personal data against plain versions: the base patterns as regular expressions, the bootstrapping with dictionaries."""

import random
import re
from collections import defaultdict

from tidemark.llm import pii

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = (True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)
            if fine[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    for _ in range(4000):
        chars = rng.choice(["a@.-_1é", "0123456789 -.", "+1 ()-.5", "a@.1+ "])
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        points = [len(text.encode()[:i].decode("utf-8", "ignore")) for i in range(len(text.encode()) + 1)]
        found, _ = pii.base_spans(text.encode())
        assert [(points[a], k, points[b]) for a, k, b in found] == base_spans(text), text


def test_long_runs_take_linear_time():
    for text in (b"a" * 10**6, b"1" * 10**6, b"1." * 500_000, b"a@" * 300_000, b"+1" + b" " * 10**6, b"1 " * 400_000):
        found, failed = pii.base_spans(text)
        pii.identifiers(text, found, failed)


def plain(texts):
    """The same bootstrapping over words as strings: added spans by text."""
    fold = lambda w: re.sub("[0-9]", "0", w.lower())
    ends = "=:#<"
    seeds, all_rows = defaultdict(lambda: defaultdict(set)), []
    for t in texts:
        found, failed = pii.base_spans(t.encode())
        strings = found + [(a, -1, b) for a, b in pii.identifiers(t.encode(), found, failed)]
        strings = [(len(t.encode()[:a].decode()), k, len(t.encode()[:b].decode())) for a, k, b in strings]
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        rows = []

        def around(a, b):
            left = [t[max(x, 0) : min(y, a)] for x, y in words if x < a]
            right = [t[max(x, b) : y] for x, y in words if y > b]
            one, two, then = (fold(left[-1]) if left else ""), (fold(left[-2]) if len(left) > 1 else ""), (fold(right[0]) if right else "")
            return [("pair", two, one), ("sides", one, then), *([("alone", one)] if one and one[-1] in ends else [])]

        for a, k, b in strings:
            for p in around(a, b):
                rows.append((p, k, t[a:b].lower(), a, b))
                if k >= 0:
                    seeds[p][k].add(t[a:b].lower())
        for x, y in words:
            if not any(a < y and x < b for a, _, b in strings):
                rows += [(p, -2, fold(t[x:y]), x, y) for p in around(x, y)]
        all_rows.append(rows)
    patterns = {p for p, by in seeds.items() if any(len(v) >= pii.MIN_SEEDS for v in by.values())}
    edges, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    first = defaultdict(float)
    for rows in all_rows:
        for p, k, v, _, _ in rows:
            if p in patterns:
                total[p] += 1
                if k != -2:
                    edges[p][v] += 1
                if k >= 0:
                    first[v, k] = 1.0
    conf = dict(first)
    for _ in range(pii.ROUNDS):
        score = {(p, k): sum(conf.get((v, k), 0) * n for v, n in edges[p].items()) / total[p] for p in patterns for k in range(4)}
        left_open = defaultdict(lambda: 1.0)
        for (p, k), s in score.items():
            if s >= pii.RIGHT:
                for v in edges[p]:
                    left_open[v, k] *= max(1e-12, 1 - s)
        known = {v for v, _ in first}
        conf = dict(first) | {x: 1 - o for x, o in left_open.items() if x[0] not in known}
    out = []
    for rows in all_rows:
        best = {}
        for p, k, v, a, b in rows:
            if k == -1 and p in patterns:
                for kind in range(4):
                    c = conf.get((v, kind), 0)
                    if score[p, kind] >= pii.RIGHT and c >= pii.SURE:
                        best[a, b] = max(best.get((a, b), (0, 0)), (round(c, 9), -kind))
        out.append(sorted((a, -k, b) for (a, b), (_, k) in best.items()))
    return out


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def number(rng, n):
    return "".join(str(rng.randint(0, 9)) for _ in range(n))


def corpus():
    rng = random.Random(8)
    fill = lambda n: " ".join(rng.choice(["la", "ríe", "mon", "tag", "ño", "über"]) for _ in range(n))
    texts = [f"{fill(5)} write to me at u{i}@mail{i}.example.org please {fill(4)}" for i in range(9)]
    texts += [f"{fill(2)} write to me at jane{i}[at]mail.org please {fill(2)}" for i in range(4)]
    texts += [f"{fill(3)} host={rng.randint(1, 250)}.{i}.7.9 {fill(3)}" for i in range(6)] + ["é host=10.20.300.4 la", "host=la mon host=ño9 x"]
    texts += [f"{fill(2)}, telephone: +1 (555) 555-{number(rng, 4)}. {fill(3)}" for _ in range(5)] + ["la telephone: 555 123 4567. mon"]
    texts += [f"{fill(3)} version {i}.2 of v{i}x and item 17{i}, ño {fill(2)}" for i in range(8)]
    texts += ["", " \n", "4539 1488 0343 6467 la 1.2.3.4", "x" * 4000 + "@a.b", texts[0], texts[-1], texts[10]]
    return texts


def test_bootstrapping(spark):
    texts = corpus()
    rows = [(None if i == 4 else i // 2, t, "z") for i, t in enumerate([*texts, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string").repartition(4)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base, r.spans) for r in pii.spans(docs).collect()), key=str)
    want = []
    for (i, t, _), added in zip(rows, plain([t or "" for _, t, _ in rows])):
        base = base_spans(t or "")
        want.append((i, *(sum(k == n for _, k, _ in base) for n in range(4)), shown(base), shown(base + added)))
    assert got == sorted(want, key=str)
    spans = {t: s for (*_, s), t in zip(want, texts)}
    for t in texts:
        if "[at]" in t:
            a = t.index("jane")
            assert spans[t] == f"email:{a}:{t.index(' please')}"
    assert spans["é host=10.20.300.4 la"] == "ip:7:18"
    assert spans["la telephone: 555 123 4567. mon"] == "phone:14:26"
    assert all(not s for t, s in spans.items() if "version" in t)


def test_without_patterns_and_empty(spark):
    docs = spark.createDataFrame([(1, "a@b.c only"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.spans) for r in pii.spans(docs).collect()) == [(1, "email:0:5"), (2, "")]
    assert pii.spans(docs.limit(0)).count() == 0
