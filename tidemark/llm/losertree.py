"""Merging sorted runs of byte strings by a loser tree that keeps common prefix lengths.

Every loser carries the length of its prefix shared with the winner that beat it. A new element of the winner's run
carries its prefix shared with the element just put out, so two contenders are first compared by those lengths: the
longer shared prefix wins unread, and only at equal lengths are bytes compared, from that length on.
"""

from __future__ import annotations

from collections.abc import Iterator


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, which share the first start bytes."""
    n = min(len(a), len(b))
    step = 8
    while start < n:
        if a[start : start + step] == b[start : start + step]:
            start += step
            continue
        x = int.from_bytes(a[start : start + step].ljust(step, b"\0"), "big") ^ int.from_bytes(b[start : start + step].ljust(step, b"\0"), "big")
        return min(n, start + step - (x.bit_length() + 7) // 8) if x else n
    return n


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """runs: (strings in order, each one's prefix shared with the one before); a run's strings are asked for one after the
    other, so they may be decoded on the way. Yields (run, index, prefix shared with the one put out before)."""
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    size = [len(r[0]) for r in runs] + [0] * (k - len(runs))
    key: list[bytes | None] = [runs[i][0][0] if i < len(runs) and size[i] else None for i in range(k)]
    lcp = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp becomes the one with the winner. Ties: the earlier run."""
        x, y = key[a], key[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        start = lcp[a]
        n = common(x, y, start)
        if (x[n:] <= y[n:] and a < b) or x[n:] < y[n:]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    tree = [0] * k
    winners = list(range(k))
    base = k
    while base > 1:
        up = []
        for i in range(0, base, 2):
            w, loser = play(winners[i], winners[i + 1])
            tree[(base + i) // 2] = loser
            up.append(w)
        winners, base = up, base // 2
    best = winners[0]
    while key[best] is not None:
        yield best, at[best], lcp[best]
        i = at[best] = at[best] + 1
        if i < size[best]:
            key[best], lcp[best] = runs[best][0][i], runs[best][1][i]
        else:
            key[best] = None
        node = (k + best) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2
