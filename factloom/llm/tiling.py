"""Greedy string tiling with running Karp-Rabin hashes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Sequence

_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _runs(tokens: Sequence[Hashable], free: list[bool], k: int) -> list[tuple[int, int]]:
    """(hash, start) of every run of k free tokens, rolled along."""
    out: list[tuple[int, int]] = []
    codes = [hash(x) % _MOD for x in tokens]
    top, h, n = pow(_BASE, k - 1, _MOD), 0, 0
    for i, c in enumerate(codes):
        if not free[i]:
            h, n = 0, 0
            continue
        if n == k:
            h = (h - codes[i - k] * top) % _MOD
            n -= 1
        h, n = (h * _BASE + c) % _MOD, n + 1
        if n == k:
            out.append((h, i - k + 1))
    return out


def greedy_tiles(a: Sequence[Hashable], b: Sequence[Hashable], least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of non-overlapping common runs of at least `least` tokens, longest first.

    Every token of either side is used once, so reordered passages are found piece by piece. Empty sides give [].
    """
    least = max(1, least)
    free_a, free_b = [True] * len(a), [True] * len(b)
    tiles: list[tuple[int, int, int]] = []
    while True:
        seeds: dict[int, list[int]] = defaultdict(list)
        for h, i in _runs(a, free_a, least):
            seeds[h].append(i)
        best, found = least, []
        for h, j in _runs(b, free_b, least):
            for i in seeds.get(h, ()):
                if i + best > len(a) or j + best > len(b) or a[i + best - 1] != b[j + best - 1]:
                    continue
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                tiles.append((i, j, best))
