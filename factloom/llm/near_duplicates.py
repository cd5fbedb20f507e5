"""Near-duplicate rows: prefix filtering of word-run sets, exact verification, groups.

A row's set of word runs is a sparse bit vector over all runs. The method named for this problem, covering masks, is
not built: see the README for the figures. What is built gives the same guarantee. Two rows within the radius that the
similarity t allows, |A \\ B| <= |A| - t|A|, agree on at least one of the first |A| - ceil(t|A|) + 1 set bits of either,
in any fixed order of the bits (pigeonhole). Each row is filed under each of these bits: every pair within the radius
meets in some table, none is lost by chance. The order puts runs that are rare over all rows first, so that tables stay
small. Where two rows first meet also bounds what they can share, and all their meetings together bound it again, which
discards nearly every accidental pair before a text is fetched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.words import mix, run_hashes, word_hashes
from factloom.operators.components import connected_components
from factloom.session import cut

#: A table is paired off if at most so many of its rows can be the smaller one of a pair; else it is resolved by pivots.
HOT_TABLE = 96
#: A word in this share of the rows is frequent; there are at most 2 (words per row) / FREQUENT such words.
FREQUENT = 0.0005
#: A run in this share of the rows is common and comes last in the order; at most 2 (runs per row) / COMMON are.
COMMON = 0.001
#: A common run of at least so many rows is heavy: its rows are never brought to one task, with the same result.
HEAVY_ROWS = 5_000
#: Entries that one bucket of the shuffle should hold.
BUCKET = 1_500_000

_WORD, _RUN, _WORDS, _ROWS = range(4)


@dataclass(frozen=True)
class Common:
    """What is common over all rows: sorted hashes of frequent words and common runs with their levels, the level from which runs are heavy, and totals."""

    words: np.ndarray
    word_levels: np.ndarray
    runs: np.ndarray
    run_levels: np.ndarray
    heavy_level: int = 1
    n_words: int = 0
    n_rows: int = 0


NOTHING = Common(*[np.zeros(0, np.uint64), np.zeros(0, np.int64)] * 2)


def _count_common(k: int, frequent: float, common: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """text -> kind, key, n: words and runs that are common in a batch of rows, and totals.

    What is in a share s of all rows is in that share of some batches; where it is in less than s / 2, it is left out,
    which takes away less than half of its count. So everything in a share s of all rows comes out with s / 2 of them at
    least, and few words leave a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            flat, starts = word_hashes(batch.column(0))
            rows = len(starts) - 1
            for kind, keys, share in ((_WORD, flat, frequent), (_RUN, run_hashes(flat, starts, k)[0], common)):
                keys, n = np.unique(keys, return_counts=True)
                often = n >= max(2, share * rows / 2)
                yield out(kind, keys[often], n[often])
            yield out(_WORDS, np.zeros(1, np.int64), np.array([len(flat)]))
            yield out(_ROWS, np.zeros(1, np.int64), np.array([rows]))

    return count


def common_parts(texts: DataFrame, k: int, frequent: float = FREQUENT, common: float = COMMON, heavy_rows: int = HEAVY_ROWS) -> Common:
    """Frequent words and common runs of one text column, counted over all rows and combined per task before the shuffle.

    What comes to the driver is bounded by 2 (words per row) / share, whatever the number of rows. Levels are log2 of the
    share's multiple. They decide an order and a route, never a result.
    """
    counted = cut(texts.mapInArrow(_count_common(k, frequent, common), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = {r.kind: r.n for r in counted.where(f"kind in ({_WORDS}, {_ROWS})").collect()}
    rows = total.get(_ROWS, 0)

    def top(kind: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        least = max(2, math.ceil(share * rows / 2))
        found = counted.where((F.col("kind") == kind) & (F.col("n") >= least)).toPandas()
        keys = found["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], (1 + np.floor(np.log2(found["n"].to_numpy() / least)).astype(np.int64))[order]

    heavy_level = 1 + max(0, math.ceil(math.log2(heavy_rows / max(2, math.ceil(common * rows / 2)))))
    return Common(*top(_WORD, frequent), *top(_RUN, common), heavy_level, total.get(_WORDS, 0), rows)


class _Levels:
    """Levels by hash: a table with one place for each of some low bits; of two hashes with one place the more frequent stays."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray) -> None:
        self.low = np.uint64((1 << max(12, (4 * len(keys)).bit_length())) - 1)
        self.key, self.level = np.zeros(int(self.low) + 1, np.uint64), np.zeros(int(self.low) + 1, np.int64)
        order = np.lexsort((keys, levels))
        self.key[keys[order] & self.low], self.level[keys[order] & self.low] = keys[order], levels[order]

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = asked & self.low
        return np.where(self.key[at] == asked, self.level[at], 0)


class _Sets:
    """The sets of batches: distinct run hashes of each row in the common order: rare ones first, common ones last."""

    def __init__(self, k: int, common: Common) -> None:
        self.k, self.common = k, common
        self.word_level, self.run_level = _Levels(common.words, common.word_levels), _Levels(common.runs, common.run_levels)

    def of(self, texts: pa.Array) -> _Sets:
        """Take a batch; the attributes are those of its rows."""
        flat, starts = word_hashes(texts)
        n_rows, k = len(starts) - 1, self.k
        runs, owner = run_hashes(flat, starts, k)
        rank = np.zeros(0, np.int64)
        if (n := len(flat) - k + 1) > 0:
            levels = self.word_level(flat)
            parts = [levels[i : i + n] for i in range(k)]
            row_of = np.repeat(np.arange(n_rows), np.diff(starts))
            rank = (np.minimum.reduce(parts) * 1024 + sum(parts))[row_of[:n] == row_of[k - 1 :]]
        weight = self.run_level(runs)
        order = _order(owner, rank, weight, runs)
        runs, owner, weight = runs[order], owner[order], weight[order]
        if len(runs):
            first = np.r_[True, (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])]
            runs, owner, weight = runs[first], owner[first], weight[first]
        self.runs, self.owner, self.heavy = runs, owner, weight >= self.common.heavy_level
        self.size = np.bincount(owner, minlength=n_rows)
        begin = np.r_[0, np.cumsum(self.size)]
        self.position = np.arange(len(runs)) - begin[owner]
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(runs, dtype=np.uint64)]
            others = np.r_[np.uint64(0), np.cumsum(mix(runs ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
            self.hi, self.lo = sums[begin[1:]] - sums[begin[:-1]], others[begin[1:]] - others[begin[:-1]]
            for i in np.flatnonzero(self.size == 0):  # too short for a run: its words stand for the set
                h = np.uint64(0)
                for w in flat[starts[i] : starts[i + 1]]:
                    h = mix(h * np.uint64(3) + w)
                self.hi[i], self.lo[i] = h, ~h
        return self


def _order(owner: np.ndarray, rank: np.ndarray, weight: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Rows' runs by weight, rank and hash; one sort of 64 bits where these suffice to tell them apart."""
    if len(runs) and owner[-1] < 1 << 16 and rank.max() < 1 << 15 and weight.max() < 1 << 5:
        key = owner.astype(np.uint64) << np.uint64(48) | (weight << 43 | rank << 28).astype(np.uint64) | runs >> np.uint64(36)
        order = np.argsort(key)
        key, sorted_runs = key[order], runs[order]
        if not ((key[1:] == key[:-1]) & (sorted_runs[1:] != sorted_runs[:-1])).any():
            return order
    return np.lexsort((runs, rank + (weight << 40), owner))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers, all lowest ones first, so that the empty high ones compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _pack(masks: np.ndarray, rows: np.ndarray, sizes: np.ndarray, positions: np.ndarray) -> tuple[bytes, int]:
    """Entries as one compressed block: masks sorted and by their differences, each row and its size once."""
    order = np.argsort(masks)
    masks, rows, sizes, positions = masks[order], rows[order], sizes[order], positions[order]
    table, first, at = np.unique(rows, return_index=True, return_inverse=True)
    parts = [np.diff(masks, prepend=masks[:1] * 0), at.astype(np.uint32), positions.astype(np.uint32), np.diff(table, prepend=0), sizes[first].astype(np.uint32)]
    raw = np.array([len(masks), len(table)], np.int64).tobytes() + b"".join(map(_planes, parts))
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(block: bytes, length: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(pa.decompress(block, length, codec="zstd", asbytes=True), np.uint8)
    (n, m), at, out = raw[:16].view(np.int64), 16, []
    for count, kind in ((n, np.uint64), (n, np.uint32), (n, np.uint32), (m, np.int64), (m, np.uint32)):
        size = int(count) * np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(-1, count).T).view(kind).ravel())
        at += size
    masks, row, position, table, sizes = out
    with np.errstate(over="ignore"):
        return np.cumsum(masks, dtype=np.uint64), np.cumsum(table)[row], sizes[row].astype(np.int64), position.astype(np.int64)


def _small(size: np.ndarray, left: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a row can be the smaller one of a pair that first meets where `left` of its runs follow."""
    return left + 1 >= np.ceil(2 * similarity / (1 + similarity) * size - 1e-9)


_ENTRY = "bucket int, block binary, length int, a long, b long, mask long, small boolean"


def _entries(parts: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    kinds = (("bucket", pa.int32()), ("block", pa.binary()), ("length", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64()), ("small", pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(parts[k]).cast(t) if k in parts else pa.nulls(n, t) for k, t in kinds], names=[k for k, _ in kinds])


def _masks(k: int, similarity: float, common: Common, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, text -> _ENTRY: the masks of each row, packed by bucket of the mask.

    (bucket, block, length): entries (mask, row, size, position in the common order). (bucket, a, b): equal sets; a set
    seen before in the same task is not filed again but linked to its first row. (bucket, a, mask, small): a row under a
    heavy run, spread over the buckets by row. (bucket, a, mask, -): the row's whole set as a mask, small null.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seen = _Sets(k, common), {}
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            masks, rows, sizes, positions = map(np.concatenate, zip(*held))
            held.clear()
            place = ((masks >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                if len(part):
                    block, length = _pack(masks[part], rows[part], sizes[part], positions[part])
                    yield _entries({"bucket": pa.array(place[part[:1]]), "block": pa.array([block], pa.binary()), "length": pa.array([length], pa.int32())}, 1)

        for batch in batches:
            row = batch.column(0).to_numpy()
            sets = maker.of(batch.column(1))
            if len(seen) > 500_000:
                seen.clear()
            first = np.array([seen.setdefault(key, r) for key, r in zip(zip(sets.hi.tolist(), sets.lo.tolist()), row.tolist())], np.int64)
            new = first == row
            keep = np.where(new & (sets.size > 0), sets.size - np.ceil(similarity * sets.size - 1e-9).astype(np.int64) + 1, 0)
            mine = sets.position < keep[sets.owner]
            held.append([x[mine & ~sets.heavy] for x in (sets.runs, row[sets.owner], sets.size[sets.owner], sets.position)])
            if heavy := int((mine & sets.heavy).sum()):
                at = mine & sets.heavy
                owner = sets.owner[at]
                spread = (mix(row[owner].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                yield _entries({"bucket": spread, "a": row[owner], "mask": sets.runs[at].view(np.int64), "small": _small(sets.size[owner], sets.size[owner] - 1 - sets.position[at], similarity)}, heavy)
            with np.errstate(over="ignore"):
                whole = mix(sets.hi ^ mix(sets.lo))[new]
            check = (sets.lo >> np.uint64(2)).astype(np.int64)[new]
            yield _entries({"bucket": (whole % np.uint64(buckets)).astype(np.int32), "a": row[new], "b": check, "mask": whole.view(np.int64)}, int(new.sum()))
            if n := int((~new).sum()):
                yield _entries({"bucket": (mix(row[~new].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32), "a": row[~new], "b": first[~new]}, n)
            if sum(len(x[0]) for x in held) > 4_000_000:
                yield from flush()
        if held:
            yield from flush()

    return make


_COLLISION = "a long, b long, mask long, shared int, room int"


def _collide(similarity: float, hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries sorted by bucket -> what meets in a table.

    (a, b, null, shared, room): a pair that sizes and positions allow; shared is its meetings in this bucket, room the
    elements that may still be common after the last one. (a, b, null, null, null): equal sets. (row, null, mask, small,
    null): a row of a table that is not paired off; small is 1 if the row can be the smaller one of a pair. One bucket is
    held at a time.

    A pair is left out of a table where too few runs follow: so they do in all later tables, and if this is the first
    one that the rows share they are no pair. A table none of whose rows can be the smaller one has no pair at all.
    """

    def paired(row: np.ndarray, size: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        need = np.ceil((size[x] + size[y]) * similarity / (1 + similarity) - 1e-9).astype(np.int64)
        fits = (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9) & (row[x] != row[y]) & (np.minimum(left[x], left[y]) + 1 >= need)
        x, y, need = x[fits], y[fits], need[fits]
        return np.stack([np.minimum(row[x], row[y]), np.maximum(row[x], row[y]), np.minimum(left[x], left[y]) - need])

    def gathered(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b, room = np.concatenate(found, 1)
        order = np.lexsort((b, a))
        a, b, room = a[order], b[order], room[order]
        at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        return out(a[at], b[at], None, np.diff(np.r_[at, len(a)]), np.minimum.reduceat(room, at) if len(at) else room)

    def out(a: np.ndarray, b: np.ndarray | None, mask: np.ndarray | None = None, shared: np.ndarray | None = None, room: np.ndarray | None = None) -> pa.RecordBatch:
        parts = [(a, pa.int64()), (b, pa.int64()), (mask, pa.int64()), (shared, pa.int32()), (room, pa.int32())]
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), t) if x is None else pa.array(x).cast(t) for x, t in parts], names=["a", "b", "mask", "shared", "room"])

    def tables(blocks: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        mask, row, size, position = map(np.concatenate, zip(*(_unpack(*b) for b in blocks)))
        order = np.argsort(mask, kind="stable")
        mask, row, size = mask[order], row[order], size[order]
        left = size - 1 - position[order]
        begin = np.flatnonzero(np.r_[True, mask[1:] != mask[:-1]])
        length = np.diff(np.r_[begin, len(mask)])
        small = _small(size, left, similarity)
        most = np.add.reduceat(small.astype(np.int64), begin)
        found: list[np.ndarray] = []
        some = (length > 1) & (most > 0)
        for m in np.unique(length[some & (length <= hot)]):
            i, j = np.triu_indices(m, 1)
            at = begin[some & (length == m)]
            for part in np.array_split(at, max(1, len(at) * len(i) // 2_000_000)):
                cells = part[:, None] + np.arange(m)[None, :]
                found.append(paired(row, size, left, cells[:, i].ravel(), cells[:, j].ravel()))
        for t in np.flatnonzero(some & (length > hot)):
            cells = np.arange(begin[t], begin[t] + length[t])
            if most[t] > hot:
                yield out(row[cells], None, mask[cells].view(np.int64), small[cells].astype(np.int64))
                continue
            for x in cells[small[cells]]:  # few of its rows can be the smaller one
                y = cells[~small[cells] | (cells > x)]
                found.append(paired(row, size, left, np.full(len(y), x), y))
        if found:
            yield gathered(found)

    def bucket(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        block, a, b, mask, small = (batch.column(c) for c in ("block", "a", "b", "mask", "small"))
        there = pc.is_valid(block)
        blocks = batch.filter(there)
        if len(blocks):
            yield from tables(list(zip(blocks.column("block").to_pylist(), blocks.column("length").to_pylist())))
        whole = pc.and_(pc.is_valid(mask), pc.is_valid(b))
        if pc.any(whole).as_py():
            row, check, key = (x.filter(whole).to_numpy() for x in (a, b, mask))
            order = np.lexsort((row, check, key))
            row, check, key = row[order], check[order], key[order]
            first = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]
            head = row[np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))]
            yield out(head[~first], row[~first])
        same = pc.and_(pc.is_valid(b), pc.is_null(mask))
        yield out(b.filter(same).to_numpy(), a.filter(same).to_numpy())
        heavy = pc.is_valid(small)
        yield out(a.filter(heavy).to_numpy(), None, mask.filter(heavy).to_numpy(), pc.cast(small.filter(heavy), pa.int32()).to_numpy())

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                if len(part):
                    if held and held[0].column(0)[0].as_py() != numbers[part[0]]:
                        yield from bucket(pa.Table.from_batches(held))
                        held.clear()
                    held.append(batch.slice(int(part[0]), len(part)))
        if held:
            yield from bucket(pa.Table.from_batches(held))

    return collide


def _verify(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b, text_a, text_b -> a, b, Jaccard similarity of their sets of word runs, by their hashes of 64 bits."""

    def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (pair, run) as one hash each, and the pair."""
        runs, pair = run_hashes(*word_hashes(texts), k)
        with np.errstate(over="ignore"):
            keys, first = np.unique(mix(runs ^ mix(pair.astype(np.uint64) + np.uint64(1))), return_index=True)
        return keys, pair[first]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            (x, of_x), (y, of_y) = keys_of(batch.column(2)), keys_of(batch.column(3))
            shared = np.intersect1d(x, y, assume_unique=True, return_indices=True)[1]
            both = np.bincount(of_x[shared], minlength=n)
            either = np.bincount(of_x, minlength=n) + np.bincount(of_y, minlength=n) - both
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both / np.maximum(either, 1))], names=["a", "b", "j"])

    return verify


def _similarities(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) with the texts of both sides fetched only for the rows named in a pair."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    some = texts.join(named, "row", "left_semi")
    left, right = some.select(F.col("row").alias("b"), F.col("text").alias("text_b")), some.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_verify(k), "a long, b long, j double")


def _runs(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, text -> row, run, size: one row for each distinct run of a text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _Sets(k, NOTHING)
        for batch in batches:
            sets = maker.of(batch.column(1))
            row = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(row[sets.owner]), pa.array(sets.runs.view(np.int64)), pa.array(sets.size[sets.owner], pa.int64())], names=["row", "run", "size"])

    return make


def _refiled(members: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(mask, row, run, left, size): the rows of each table filed again under the runs that are rare in this table.

    The same pigeonhole as for the masks, in an order of the table's own: what all its rows share comes last. left is
    how many runs of the row follow. Runs of one row only are counted in the order but not filed.
    """
    some = texts.join(members.select("row").distinct(), "row", "left_semi").select("row", "text")
    runs = cut(members.join(some.mapInArrow(_runs(k), "row long, run long, size long"), "row"))
    ranked = runs.join(runs.groupBy("mask", "run").agg(F.count("*").alias("n")), ["mask", "run"])
    ranked = ranked.withColumn("left", F.col("size") - F.row_number().over(W.partitionBy("mask", "row").orderBy("n", "run")))
    return cut(ranked.where((F.col("n") > 1) & (F.col("left") + 1 >= F.ceil(similarity * F.col("size") - 1e-9))).select("mask", "row", "run", "left", "size"))


def _met(filed: DataFrame, rows: DataFrame, similarity: float, also: F.Column | None = None) -> DataFrame:
    """(x, y) of the rows (mask, row, d) that share a filed run with enough runs behind it in both for the similarity."""
    share = similarity / (1 + similarity)
    mine = filed.join(rows, ["mask", "row"])
    small = mine.where(F.col("left") + 1 >= F.ceil(2 * share * F.col("size") - 1e-9))  # its partner is as large or larger
    small = small.select("mask", "run", F.col("row").alias("x"), F.col("size").alias("sx"), F.col("left").alias("lx"), F.col("d").alias("dx"))
    large = mine.select("mask", "run", F.col("row").alias("y"), F.col("size").alias("sy"), F.col("left").alias("ly"), F.col("d").alias("dy"))
    fits = (F.col("x") != F.col("y")) & (F.col("sx") <= F.col("sy")) & (F.least("lx", "ly") + 1 >= F.ceil(share * (F.col("sx") + F.col("sy")) - 1e-9))
    return small.join(large, ["mask", "run"]).where(fits if also is None else fits & also).select("x", "y")


def _hot_links(members: DataFrame, texts: DataFrame, k: int, similarity: float, rounds: int = 6) -> DataFrame:
    """Links inside hot tables (mask, row), complete up to connectivity, without pairing a table off.

    Each round takes a table's smallest open row as its pivot and compares all open rows with it. Rows within the
    radius belong to the pivot's group; the others stay open. An open row y can only be linked to a row x of the
    pivot's group if d(x, pivot) >= d(y, pivot) - (1 - t), as Jaccard distance is a metric; only those pairs are
    compared as well. After the last round, the rows still open are compared with each other. Both comparisons take
    only pairs that meet again when the table is filed under its own rare runs (_refiled), not all of a table.
    """
    radius = 1 - similarity + 1e-9
    links: DataFrame | None = None
    filed: DataFrame | None = None

    def add(found: DataFrame) -> None:
        nonlocal links
        found = found.where(F.col("j") >= similarity - 1e-12).select("a", "b")
        links = found if links is None else links.union(found)

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        return cut(_similarities(pairs, texts, k))

    open_rows = members
    for _ in range(rounds):
        pivots = open_rows.groupBy("mask").agg(F.min("row").alias("x"))
        star = open_rows.withColumnRenamed("row", "y").join(pivots, "mask")
        known = compare(star)
        add(known)
        with_d = star.where("x <> y").join(known.withColumnsRenamed({"a": "x", "b": "y"}), ["x", "y"]).withColumn("d", 1 - F.col("j"))
        with_d = cut(with_d.select("mask", F.col("y").alias("row"), "d"))
        open_rows = with_d.where(F.col("d") > radius).select("mask", "row")
        if open_rows.isEmpty():
            return links
        if filed is None:
            filed = _refiled(with_d.select("mask", "row"), texts, k, similarity)
        near = lambda c: F.col(c) <= radius
        cross = _met(filed, with_d, similarity, (near("dx") != near("dy")) & (F.abs(F.col("dx") - F.col("dy")) <= radius))
        add(compare(cross))
    add(compare(_met(filed, open_rows.withColumn("d", F.lit(1.0)), similarity)))
    return links


def near_duplicate_members(df: DataFrame, row_id: str, text: F.Column, k: int = 5, similarity: float = 0.8, hot_table: int = HOT_TABLE, frequent: float = FREQUENT, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(row, component) for the rows that have a near duplicate; component is the smallest id of the group.

    row_id names a unique bigint column; text is a string expression. Rows with a null text take no part. Rows of
    equal sets are linked without being compared. A text of fewer than k words has no runs: it is only linked with
    texts of the same words. Empty input gives an empty result; other columns, whatever their names, are not read.
    """
    base = df.select(F.col(row_id).cast("long").alias("row"), text.alias("text")).where("text is not null and row is not null")
    common = common_parts(base.select("text"), k, frequent, heavy_rows=heavy_rows)
    filed_by_row = 1 - similarity + (common.n_rows + 1) / (common.n_words + 1)
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(common.n_words * filed_by_row / BUCKET))
    filed = base.mapInArrow(_masks(k, similarity, common, buckets), _ENTRY)
    filed = filed.repartition("bucket").sortWithinPartitions("bucket")
    found = filed.mapInArrow(_collide(similarity, hot_table), _COLLISION)
    found = cut(found.groupBy("a", "b", "mask").agg(F.sum("shared").alias("shared"), F.min("room").alias("room")))
    sure = found.where("b is not null and shared is null").select("a", "b")
    likely = found.where("b is not null and shared + room >= 0").select("a", "b")
    links = sure.union(_similarities(likely, base, k).where(F.col("j") >= similarity - 1e-12).select("a", "b"))
    # Pairs that meet in a table not paired off are found there, so what is not counted for them here does no harm.
    hot = found.where("mask is not null").select("mask", F.col("a").alias("row"), "shared")
    crowded = hot.where("shared > 0").select("mask").distinct()
    if not crowded.isEmpty():
        links = links.union(_hot_links(hot.join(crowded, "mask", "left_semi").select("mask", "row"), base, k, similarity))
    return connected_components(links, "a", "b").select(F.col("node").alias("row"), "component")


def near_duplicate_groups(df: DataFrame, row_id: str, text: F.Column, **settings: float) -> DataFrame:
    """(row, component) for every row with a text; a row without near duplicates is its own component."""
    members = near_duplicate_members(df, row_id, text, **settings)
    rows = df.where(text.isNotNull()).select(F.col(row_id).cast("long").alias("row")).where("row is not null")
    return rows.join(members, "row", "left").select("row", F.coalesce("component", "row").alias("component"))
