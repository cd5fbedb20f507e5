"""Token ids of a whole corpus by a public byte-level vocabulary."""

from __future__ import annotations

import base64
import heapq
import io
import os
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.transducer import Transducer, build
from factloom.session import posix_path, scratch_name

#: Where the vocabulary lies unless a path is given.
VOCABULARY = os.environ.get("FACTLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of the vocabulary, its white space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words in the lexicon: the most frequent ones of the corpus. Rarer ones are merged, with the same result.
LEXICON_WORDS = 32_768
_MEMO = 200_000
_SHORT = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merges: always the pair of the lowest rank, the leftmost of equals. n log n for long pieces."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) <= _SHORT:
        get, never = ranks.get, 1 << 60
        starts = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]  # rank of part i with the next one
        while pairs and (best := min(pairs)) != never:
            i = pairs.index(best)
            del starts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(piece[starts[i - 1] : starts[i + 1]], never)
            if i < len(pairs):
                pairs[i] = get(piece[starts[i] : starts[i + 2]], never)
        return [ranks[piece[a:b]] for a, b in zip(starts, starts[1:])]
    end = list(range(1, len(piece) + 1))  # of the part that starts here; 0 where none does any more
    left = list(range(-1, len(piece) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < len(piece) and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(len(piece) - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= len(piece) or not end[j] or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j] = stop, 0
        if stop < len(piece):
            left[stop] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


_NONE = np.int64(1 << 40)


class BatchMerges:
    """The merges of many short pieces at once, one step a piece in each round; as merge() has them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        get = ranks.get
        pairs = [(a << 20 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        key, rank = np.array(pairs, np.int64).reshape(-1, 2).T
        self.low = np.uint64((1 << max(10, (4 * len(key)).bit_length())) - 1)
        self.keys, self.values = np.full(int(self.low) + 1, -1, np.int64), np.full(int(self.low) + 1, _NONE)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):  # open addressing: of those that meet in an empty place one stays, the others go on
            free = np.flatnonzero(self.keys[slot[left]] < 0)
            _, first = np.unique(slot[left[free]], return_index=True)
            stays = left[free[first]]
            self.keys[slot[stays]], self.values[slot[stays]] = key[stays], rank[stays]
            left = left[~np.isin(left, stays)]
            slot[left] = (slot[left] + 1) & int(self.low)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(31)) & self.low).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what each pair of parts merges to, _NONE if to nothing."""
        key = a << 20 | b
        slot, out, open_ = self._slot(key), np.full(len(key), _NONE), np.arange(len(key))
        while len(open_):
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            slot[open_] = (slot[open_] + 1) & int(self.low)
        return out

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None if (whole := self.ranks.get(p)) is None else [whole] for p in pieces]
        short = [i for i, p in enumerate(pieces) if out[i] is None and 0 < len(p) <= _SHORT]
        for i, p in enumerate(pieces):
            if out[i] is None and not 0 < len(p) <= _SHORT:
                out[i] = merge(p, self.ranks)
        if not short:
            return out
        word = np.array(short)
        length = np.array([len(pieces[i]) for i in short])
        ids = self.byte[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
        ends = np.cumsum(length)
        rank = np.full(len(ids), _NONE)
        inner = np.ones(len(ids), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(ids[at], ids[at + 1])
        while len(word):
            starts = ends - length
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                for i, a, b in zip(word[done].tolist(), starts[done].tolist(), ends[done].tolist()):
                    out[i] = ids[a:b].tolist()
                keep = np.repeat(~done, length)
                ids, rank, word, length, least = ids[keep], rank[keep], word[~done], length[~done], least[~done]
                if not len(word):
                    break
                ends = np.cumsum(length)
                starts = ends - length
            found = np.flatnonzero(rank == np.repeat(least, length))
            owner = np.searchsorted(ends, found, "right")
            p = found[np.r_[True, owner[1:] != owner[:-1]]]  # the leftmost of equals, one for each piece
            ids[p] = least
            rank[p] = np.where(p + 2 < ends, self.rank(ids[p], ids[np.minimum(p + 2, len(ids) - 1)]), _NONE)
            before = p > starts
            rank[p[before] - 1] = self.rank(ids[p[before] - 1], ids[p[before]])
            keep = np.ones(len(ids), bool)
            keep[p + 1] = False
            ids, rank = ids[keep], rank[keep]
            length = length - 1
            ends = np.cumsum(length)
        return out


_MERGES: list[BatchMerges] = []


def _batch_merges(ranks: dict[bytes, int]) -> BatchMerges:
    """One table a worker process, made again only for another vocabulary."""
    if not _MERGES or _MERGES[0].ranks is not ranks:
        _MERGES[:] = [BatchMerges(ranks)]
    return _MERGES[0]


def _count(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(pattern).findall, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*seen.keys()], pa.string()), pa.array([*seen.values()], pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            seen.update(chain.from_iterable(split(t) for t in batch.column(0).to_pylist() if t))
            if len(seen) > _MEMO:
                yield flush()
        yield flush()

    return count


def lexicon_words(texts: DataFrame, pattern: str = PATTERN, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, counted per task before the shuffle; ties by the word itself."""
    counted = texts.mapInArrow(_count(pattern), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(words).select("word").collect()]


def compile_lexicon(spark: SparkSession, words: list[str], ranks: dict[bytes, int]) -> str:
    """Build the transducer of words, hand it to every executor, and return its file name.

    The file is made in the shared folder, whatever its file system, and shipped with the session's files, so an executor
    that joins late gets it too. Its size is bounded by the number of words.
    """
    entries = sorted({w.encode(): None for w in words})
    target = scratch_name(spark, "lexicon")
    name = os.path.basename(target) + ".fst"
    made = io.BytesIO()
    build(((w, merge(w, ranks)) for w in entries), made)
    folder = posix_path(target)
    if folder is not None:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name), "wb") as f:
            f.write(made.getbuffer())
        spark.sparkContext.addFile(os.path.join(folder, name))
        return name
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(made.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addFile(f"{target}/{name}")
    return name


def _encode(lexicon: str, pattern: str, shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = regex.compile(pattern).findall, Transducer(SparkFiles.get(lexicon))
        merges = _batch_merges(shared.value)
        number: dict[str, int] = {}  # of each word met so far; its ids stand in held, from starts[number] on
        held, starts = array("i"), array("q", [0])
        for batch in batches:
            lists = [split(t) if t else [] for t in batch.column(1).to_pylist()]
            if len(number) > _MEMO:
                number.clear()
                held, starts = array("i"), array("q", [0])
            new = [*set(chain.from_iterable(lists)).difference(number)]
            spelled = [w.encode("utf-8", "surrogatepass") for w in new]
            numbers = known.numbers(spelled).tolist()
            unseen = iter(merges([b for b, n in zip(spelled, numbers) if n < 0]))
            for w, n in zip(new, numbers):
                number[w] = len(number)
                held.extend(known.outputs(n) if n >= 0 else next(unseen))
                starts.append(len(held))
            pieces = np.array([len(x) for x in lists], np.int64)
            word = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64, int(pieces.sum()))
            begin = np.frombuffer(starts, np.int64)
            length = (begin[1:] - begin[:-1])[word]
            ends = np.cumsum(length)
            flat = np.frombuffer(held, np.int32)[np.repeat(begin[word] - (ends - length), length) + np.arange(length.sum())] if len(word) else np.zeros(0, np.int32)
            offsets = np.r_[0, ends][np.r_[0, np.cumsum(pieces)]].astype(np.int32)
            del begin  # a view keeps the array from growing
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    return encode


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids): each text's token ids, without special tokens; null and empty texts have the empty list.

    The strings of special tokens are ordinary text. Every row gives one row, whatever its key; other columns are not
    read. vocabulary is a rank file on the driver; it is broadcast (its size is that of the vocabulary, not of the
    data). The corpus is read twice: for the counts of its words and for the encoding, which needs no shuffle.
    """
    spark = df.sparkSession
    ranks = read_ranks(vocabulary)
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    lexicon = compile_lexicon(spark, lexicon_words(narrow.select("text"), pattern, words), ranks)
    kind = dict(narrow.dtypes)["key"]
    return narrow.mapInArrow(_encode(lexicon, pattern, spark.sparkContext.broadcast(ranks)), f"key {kind}, ids array<int>")
