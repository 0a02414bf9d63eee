"""The conversation trie against a plain one."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import tries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, base int, n int"


def sorted_turns(rows):
    def key(r):
        said = f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}"
        return (r[1] is not None, r[1] or 0, hashlib.sha256(said.encode()).hexdigest())

    return [(r[2] or "", r[3] or "") for r in sorted(rows, key=key)]


def plain(rows, family=20, most=4):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: sorted_turns(v) for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, family))
        path = own.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def result(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    out = tries.prefix_trie(df, **how).select(*COLUMNS).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in out)


def talk(rng, ids):
    """Few distinct turns, so that prefixes are shared; nulls, equal turns, repeated rows."""
    rows = []
    for c in ids:
        n = int(rng.choice([1, 1, 2, 3, 4, 6, 30]))
        for t in range(n):
            rows.append((c, None if rng.random() < 0.05 else t // (1 + (c == 7)), [None, "user", "assistant"][t % 3], [None, "", "hi", "hi there", "a b\tc"][int(rng.integers(5)) if rng.random() < 0.25 else 2 + t % 3]))
    return rows + rows[3:6] + [(None, 1, "user", "nobody")]


@pytest.mark.parametrize("size, piece", [(4096, 65536), (3, 2)])
def test_against_plain(spark, size, piece):
    rng = np.random.default_rng(size)
    ids = [*range(-25, 60), *range(400, 410), 1000, 1019, 1021, 10**15]
    rows = talk(rng, [i for i in ids if i not in (20, 400)])
    assert result(spark, rows, size=size, piece=piece) == plain(rows)


def test_one_conversation_in_many_tasks(spark):
    """Its turns and those of a copy are cut by tasks and blocks alike."""
    rng = np.random.default_rng(1)
    said = [(None if t < 3 else t, "user", f"w{rng.integers(9)} x") for t in range(900)]
    rows = [(c, *s) for c in (5, 25, 26) for s in said] + [(c, t, "user", "w1 x") for c in (4, 27) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one task sorts so few rows
    try:
        assert result(spark, rows, size=64, piece=1) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_other_families(spark):
    rows = talk(np.random.default_rng(3), range(40))
    assert result(spark, rows, family=7, heads_most=6) == plain(rows, 7, 6)


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, 1, "user", "x")]) == []


def test_numbers_modulo_the_prime():
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, tries.PRIME, 500, dtype=np.uint64) for _ in range(2))
    assert tries.times(x, y).tolist() == [int(a) * int(b) % tries.PRIME for a, b in zip(x, y)]
    assert tries.sums(x).tolist() == [sum(map(int, x[: i + 1])) % tries.PRIME for i in range(500)]
    at = rng.integers(0, 10**7, 50)
    assert tries.power(3, at).tolist() == [pow(3, int(k), tries.PRIME) for k in at]
