"""A minimal acyclic transducer: sorted byte words to id lists, suffixes shared, stored in one file for mapping."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from contextlib import nullcontext
from typing import BinaryIO

import numpy as np

_MAGIC = 0x46_4C_54_31


class _State:
    __slots__ = ("edges", "final", "id")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final = False
        self.id = -1

    def key(self) -> tuple:
        return (self.final, *((label, to.id) for label, to in self.edges.items()))


def build(entries: Iterable[tuple[bytes, Sequence[int]]], path: str | BinaryIO) -> None:
    """Write the transducer of distinct (word, ids) entries, sorted by word, to a path or an open file.

    States are made word by word and merged with equal ones as soon as no later word can reach them (Daciuk's
    incremental construction). A word's number among all words is the sum of the skips on its way; its ids stand at
    that number.
    """
    root = _State()
    known: dict[tuple, _State] = {}
    open_path: list[tuple[_State, int, _State]] = []
    before = b""
    offsets, ids = [0], []

    def settle(down_to: int) -> None:
        while len(open_path) > down_to:
            parent, label, child = open_path.pop()
            same = known.get(k := child.key())
            if same is None:
                child.id = len(known)
                known[k] = child
            else:
                parent.edges[label] = same

    for word, out in entries:
        if offsets[1:] and word <= before:
            raise ValueError("entries must be sorted and distinct")
        common = next((i for i, (x, y) in enumerate(zip(word, before)) if x != y), min(len(word), len(before)))
        settle(common)
        state = open_path[-1][2] if open_path else root
        for b in word[common:]:
            state.edges[b] = to = _State()
            open_path.append((state, b, to))
            state = to
        state.final = True
        before = word
        ids.extend(out)
        offsets.append(len(ids))
    settle(0)
    root.id = len(known)
    states = [*known.values(), root]  # children come before parents
    below = np.zeros(len(states), np.int64)
    keys, targets, skips = [], [], []
    for s in states:
        n = int(s.final)
        for label in sorted(s.edges):
            to = s.edges[label]
            keys.append(s.id << 8 | label)
            targets.append(to.id)
            skips.append(n)
            n += below[to.id]
        below[s.id] = n
    final = np.array([s.final for s in states], np.uint8)
    parts = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), np.array(offsets, np.int64), np.array(ids, np.int64), final.astype(np.int64)]
    head = np.array([_MAGIC, root.id, *map(len, parts)], np.int64)
    with open(path, "wb") if isinstance(path, str) else nullcontext(path) as f:
        for part in (head, *parts):
            f.write(part.tobytes())


class Transducer:
    """Look-ups in a file made by build(); the file is mapped, not read."""

    def __init__(self, path: str) -> None:
        data = np.asarray(np.memmap(path, np.int64, "r"))  # a view on the mapped file
        if data[0] != _MAGIC:
            raise ValueError(f"{path} holds no transducer")
        self.root, at, parts = int(data[1]), 8, []
        for n in data[2:8]:
            parts.append(data[at : at + int(n)])
            at += int(n)
        self.keys, self.targets, self.skips, self.offsets, self.ids, self.final = parts

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, -1 for unknown ones; all words walk on together, one byte a step."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.r_[0, np.cumsum(lengths)[:-1]] if n else lengths
        state, number = np.full(n, self.root), np.zeros(n, np.int64)
        alive = np.arange(n) if len(self.keys) else np.arange(0)
        number[lengths == 0] = -1
        if not len(self.keys):
            return np.full(n, -1)
        step = 0
        alive = alive[lengths > 0]
        while len(alive):
            key = state[alive] << 8 | flat[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            number[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            state[alive] = self.targets[at]
            number[alive] += self.skips[at]
            step += 1
            done = lengths[alive] == step
            ended = alive[done]
            number[ended[self.final[state[ended]] == 0]] = -1
            alive = alive[~done]
        return number

    def outputs(self, number: int) -> list[int]:
        return self.ids[int(self.offsets[number]) : int(self.offsets[number + 1])].tolist()
