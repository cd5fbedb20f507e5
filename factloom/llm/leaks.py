"""Evaluation passages inside corpus documents, by greedy string tiling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.tiling import greedy_tiles
from factloom.llm.words import WordHashes, hashed, run_hashes, words
from factloom.session import cut

#: Passages of at most this many characters in all go to every executor; more of them meet the documents by a shuffle join.
BLOCK_CHARS = 16_000_000
_SCHEMA = "doc_id long, item_id long, longest int, tiled int, tiles int, coverage double"


@dataclass(frozen=True)
class _Rule:
    """A leak: a tile of `run` words, or, with a coverage, tiles of `piece` words or more over that share of the passage."""

    run: int
    piece: int
    coverage: float | None

    @property
    def seed(self) -> int:
        return self.run if self.coverage is None else min(self.piece, self.run)

    def possible(self, pair: np.ndarray, position: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Which pairs may be leaks, from the positions in the passage of the seeds they share, sorted by pair and position.

        Tiles cover no more words than these seeds do, and a tile of `run` words has its seeds in a row. words: the
        passage's length, for each entry.
        """
        if not len(pair):
            return pair
        new = np.r_[True, pair[1:] != pair[:-1]]
        gap = np.where(new, self.seed, np.minimum(np.r_[0, np.diff(position)], self.seed))
        begins = np.flatnonzero(new)
        enough = np.zeros(len(begins), bool)
        if self.coverage is not None:
            enough = np.add.reduceat(gap, begins) >= self.coverage * words[begins] - 1e-9
        row = np.flatnonzero(new | np.r_[True, np.diff(position) != 1])
        length = np.diff(np.r_[row, len(pair)])
        enough |= np.maximum.reduceat(np.repeat(length, length), begins) >= self.run - self.seed + 1
        return pair[begins][enough]

    def judge(self, passage: list[str], document: list[str]) -> tuple[int, int, int, float] | None:
        tiles = greedy_tiles(passage, document, min(self.piece, self.run))
        longest, tiled = max((t[2] for t in tiles), default=0), sum(t[2] for t in tiles)
        if longest < self.run and (self.coverage is None or tiled < self.coverage * len(passage) - 1e-9):
            return None
        return longest, tiled, len(tiles), tiled / len(passage)


class _Items:
    """Passages on an executor: words, and sorted hashes of their runs."""

    def __init__(self, rows: list[tuple[int, str]], run: int) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]
        flat, starts = hashed(self.words, WordHashes())
        seeds, owner = run_hashes(flat, starts, run)
        self.length = np.diff(starts)
        runs = np.maximum(self.length - run + 1, 0)
        position = np.arange(len(seeds)) - np.repeat(np.cumsum(runs) - runs, runs)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.position = seeds[order], owner[order], position[order]


def _leaks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "longest", "tiled", "tiles", "coverage"])


def _scan(shared: object, rule: _Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = shared.value
        known = WordHashes()
        for batch in batches:
            lists = [words(t) for t in batch.column(1).to_pylist()]
            flat, starts = hashed(lists, known)
            seeds, doc = run_hashes(flat, starts, rule.seed)
            first, last = np.searchsorted(items.seeds, seeds, "left"), np.searchsorted(items.seeds, seeds, "right")
            met = last - first
            at = np.repeat(first, met) + np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met)
            shared_by = np.unique(np.stack([np.repeat(doc, met) * len(items.ids) + items.owner[at], items.position[at]]), axis=1)
            pairs = rule.possible(*shared_by, items.length[shared_by[0] % max(1, len(items.ids))])
            keys = batch.column(0).to_pylist()
            pairs = [divmod(x, len(items.ids)) for x in pairs.tolist()]
            rows = [(keys[d], items.ids[o], *leak) for d, o in pairs if (leak := rule.judge(items.words[o], lists[d]))]
            if rows:
                yield _leaks(rows)

    return scan


def _seeds(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key, text -> key, seed, words: the distinct runs of k words of each row, and how many words it has."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            flat, starts = hashed([words(t) for t in batch.column(1).to_pylist()], known)
            seeds, owner = run_hashes(flat, starts, k)
            order = np.lexsort((seeds, owner))
            seeds, owner = seeds[order], owner[order]
            new = np.r_[True, (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])][: len(seeds)]
            seeds, owner = seeds[new], owner[new]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[owner]), pa.array(seeds.view(np.int64)), pa.array(np.diff(starts)[owner])], names=["key", "seed", "words"])

    return make


def _tile(rule: _Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, item_id, t, p -> the leaks among the pairs."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, i, t, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
                document, asked = words(t), words(p)
                there = set(zip(*(document[i:] for i in range(rule.seed))))
                shared = np.array([n for n, x in enumerate(zip(*(asked[i:] for i in range(rule.seed)))) if x in there], np.int64)
                if len(rule.possible(np.zeros_like(shared), shared, np.full_like(shared, len(asked)))) and (leak := rule.judge(asked, document)):
                    rows.append((d, i, *leak))
            if rows:
                yield _leaks(rows)

    return tile


def _joined(docs: DataFrame, asked: DataFrame, rule: _Rule) -> DataFrame:
    """Leaks by a shuffle join on seeds, for passages of any number. Both sides carry a number of their own, as ids may repeat."""
    docs, asked = (cut(x.withColumn("n", F.monotonically_increasing_id())) for x in (docs, asked))
    mine = asked.select("n", "p").mapInArrow(_seeds(rule.seed), "key long, seed long, words long")
    if rule.coverage is not None:
        # A tile of m words holds m - seed + 1 seeds, at least m / seed. Tiles over the share c of n words hold c n / seed,
        # and one of `run` words run - seed + 1: a leak shares more seeds than are spared here, the commonest ones by
        # the number of items that hold them. Passages that repeat a seed look up all.
        least = F.least(F.ceil(rule.coverage * F.col("words") / rule.seed), F.lit(rule.run - rule.seed + 1))
        whole = F.count("*").over(W.partitionBy("key")) == F.col("words") - rule.seed + 1
        common = mine.withColumns({"held": F.count("*").over(W.partitionBy("seed")), "spared": F.when(whole, least - 1).otherwise(0)})
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("held"), "seed"))
        mine = common.withColumn("rank", rank).where(F.col("rank") > F.col("spared"))
    seeds = docs.select("n", "t").mapInArrow(_seeds(rule.seed), "key long, seed long, words long")
    pairs = seeds.select("seed", F.col("key").alias("d")).join(mine.select("seed", F.col("key").alias("i_n")), "seed").select("d", "i_n").distinct()
    texts = docs.select(F.col("n").alias("d"), F.col("k").alias("doc_id"), "t")
    passages = asked.select(F.col("n").alias("i_n"), F.col("i").alias("item_id"), "p")
    return pairs.join(texts, "d").join(passages, "i_n").select("doc_id", "item_id", "t", "p").mapInArrow(_tile(rule), _SCHEMA)


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, run: int = 12, piece: int = 5, block_chars: int = BLOCK_CHARS, coverage: float | None = None) -> DataFrame:
    """(doc_id, item_id, longest, tiled, tiles, coverage) for each document that holds `run` words of a passage in a row.

    With a `coverage`, documents whose tiles cover this share of a passage are leaks as well, however short its pieces:
    this finds passages reordered in parts of fewer than `run` words, but none shorter than `piece`.

    Seeds are the running Karp-Rabin hashes of `run` words (of `piece` words with a `coverage`); documents that share one
    with a passage are tiled with it: the longest non-overlapping common runs of at least `piece` words, longest first.
    longest is the longest tile; coverage the share of the passage that tiles cover, in any order. Null or blank texts
    and passages shorter than a seed take no part. Ids are cast to bigint; repeated rows are reported each.

    The passages' size is measured. Up to block_chars characters, they are broadcast and the documents scanned once,
    without a shuffle. More of them are joined: seeds of documents and passages meet by a shuffle, and only the texts of
    pairs that share one are fetched; nothing comes to the driver. Of a passage's seeds the commonest ones are not looked
    up as far as a leak must share others as well. Both ways give the same rows.
    """
    rule = _Rule(run, piece, coverage)
    asked = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null")
    narrow = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t")).where("t is not null and k is not null")
    chars = asked.agg(F.sum(F.length("p") + 1)).first()[0] or 0
    if chars > block_chars:
        return _joined(narrow, asked, rule)
    shared = docs.sparkSession.sparkContext.broadcast(_Items([(r.i, r.p) for r in asked.collect()], rule.seed))
    return narrow.mapInArrow(_scan(shared, rule), _SCHEMA)


def leak_report(leaks: DataFrame) -> DataFrame:
    """(item_id, documents, longest, coverage): which test items leaked, into how many documents, how completely."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))
