"""Words, hashed words and hashed runs of words over Arrow batches."""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

from factloom.llm.consistent_text import code_points

#: A word is a run of letters and digits of the lower-cased text.
WORD = re.compile(r"[^\W_]+")

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound so that a task's memory does not follow its vocabulary."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hashed(lists: list[list[str]], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after the other, and where each list starts (one more entry than lists)."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.uint64, int(starts[-1]))
    return flat, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: Characters that word_hashes takes at a time.
_CHARS = 2_000_000
#: Letters whose small form is two characters or depends on its place.
_ODD_CASE = (0x130, 0x3A3)


@cache
def _letters() -> np.ndarray:
    """A number for each code point that is part of a word, equal for a letter and its small form; 0 for all others."""
    table = np.zeros(0x110000, np.uint64)
    some = [(c, ord(low)) for c in range(0x40000) if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1 and low.isalnum()]
    at, low = np.array(some, np.int64).T
    table[at] = mix(low.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    return table


def word_hashes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (as words() parts them), and where each text starts; no string is touched.

    A word's hash is a polynomial of the numbers of its small letters; null texts have no words.
    """
    values = values.cast(pa.large_string()).fill_null("")
    sizes = np.diff(np.frombuffer(pa.concat_arrays([values]).buffers()[1], np.int64)[: len(values) + 1]) if len(values) else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _CHARS, prepend=0))
    parts = [_word_hashes(values.slice(int(a), int(b - a))) for a, b in zip([0, *cuts], [*cuts, len(values)]) if b > a]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    flat, counts = map(np.concatenate, zip(*parts))
    return flat, np.r_[0, np.cumsum(counts)]


def _word_hashes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    points, lengths = code_points(values)
    if np.isin(points, _ODD_CASE).any():
        points, lengths = code_points(pa.array([t.lower() for t in values.to_pylist()], pa.large_string()))
    number = _letters()[points]
    inside = number != 0
    ends = np.cumsum(lengths)
    first = np.r_[True, ~inside[:-1]][: len(inside)]
    first[(ends - lengths)[lengths > 0]] = True
    at = np.flatnonzero(inside)
    begins = np.flatnonzero(first[at])
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(values), np.int64)
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, _ODD, np.uint64))
        flat = np.add.reduceat(number[at] * powers[place], begins)
    owner = np.searchsorted(ends, at[begins], "right")
    return mix(flat), np.bincount(owner, minlength=len(values))


def run_hashes(flat: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling polynomial hashes of every run of k words, and the list each run lies in; runs do not cross lists."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * _ODD + flat[i : i + n]
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = owner[:n] == owner[k - 1 :]
    return mix(h[inside]), owner[:n][inside]
