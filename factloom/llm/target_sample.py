"""Samples that match target proportions, by divisor-method priorities."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.session import cut

#: Plans of at most this many cells are sent to all executors; larger ones are joined by shuffle.
BROADCAST_CELLS = 10_000
#: A cell is ranked in this many slices of its random order, so that no task sorts a whole cell.
SLICES_BITS = 8


def _label(c: Column, kind: str) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s\p{Z}]+", "") if kind == "string" else c.cast("string")


def seats(cells: pd.DataFrame) -> pd.DataFrame:
    """Seats of each cell of one plan: floors first, then the smallest (rank - 0.5) / share, ties to the smaller cell.

    With a threshold x, a cell holds every rank up to x * share + 0.5; x is found by bisection and the last few seats
    are dealt one by one, so the cost does not follow the size of the sample.
    """
    cells = cells.sort_values("cell_id").reset_index(drop=True)
    have, share = cells["available"].to_numpy(np.int64), cells["target_share"].fillna(0).to_numpy(float)
    floor = np.minimum(cells["min_rows"].fillna(0).to_numpy(np.int64), have)
    room = int(cells["sample_rows"].iloc[0]) if len(cells) and pd.notna(cells["sample_rows"].iloc[0]) else 0
    safe = np.where(share > 0, share, 1.0)

    def held(x: float, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.minimum(most, np.maximum(least, np.where(share > 0, np.floor(x * safe + 0.5), 0))).astype(np.int64)

    crowded = floor.sum() > room  # not even the floors fit: they are dealt by priority, zero shares last
    least, most = (np.zeros_like(floor), np.where(share > 0, floor, 0)) if crowded else (floor, np.where(share > 0, have, floor))
    low, high = 0.0, 1.0
    while held(high, least, most).sum() < min(room, most.sum()):
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if held(middle, least, most).sum() <= room else (low, middle)
    got = held(low, least, most)
    queue = [((got[i] + 0.5) / safe[i], i) for i in range(len(got)) if got[i] < most[i] and share[i] > 0]
    heapq.heapify(queue)
    while queue and got.sum() < room:
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, ((got[i] + 0.5) / safe[i], i))
    if crowded:
        for i in np.flatnonzero(share <= 0):
            got[i] = min(floor[i], room - got.sum())
    return cells[["plan_id", "cell_id"]].assign(seats=got)


class TargetSample:
    """Members of all cells in random order, the seats of each cell, and the report.

    df: rows with a unique bigint row_id and the label columns; targets: plan_id, cell_id (unique), the label columns,
    target_share, sample_rows and min_rows. A row belongs to a cell if it equals all the cell's non-null labels,
    strings without regard to case and white space; a null label of a row equals nothing; all rows count, repeated
    ones too. A cell without labels holds every row. Cells without rows, empty tables and zero shares are allowed.
    Other columns are not read.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, row_id: str, labels: Sequence[str], seed: int = 42) -> None:
        kinds = dict(df.dtypes)
        self.labels = list(labels)
        shown = [_label(F.col(x), kinds[x]).alias(f"l{i}") for i, x in enumerate(labels)]
        known = [F.col(f"l{i}").isNotNull() for i in range(len(labels))]
        pattern = sum((F.when(k, 1 << i).otherwise(0) for i, k in enumerate(known)), F.lit(0)).alias("pattern")
        cells = targets.select("plan_id", "cell_id", "target_share", "sample_rows", "min_rows", *shown).withColumn("pattern", pattern)
        patterns = sorted(r.pattern for r in cells.select("pattern").distinct().collect())  # at most 2 ** labels
        small = targets.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
        self._hint = F.broadcast if small else (lambda x: x)
        self.cells = cells

        def key(pattern: Column) -> Column:
            parts = [F.when(pattern.bitwiseAND(1 << i) != 0, F.col(f"l{i}")).otherwise(F.lit("")) for i in range(len(labels))]
            return F.xxhash64(pattern, *parts), F.concat_ws("\u0001", *parts)

        rows = df.select(F.col(row_id).cast("long").alias("row"), *shown).where("row is not null")
        hashed, text = key(F.col("pattern"))
        keyed = self._hint(cells.withColumn("h", hashed).withColumn("t", text).select("plan_id", "cell_id", "h", "t", "pattern"))

        def placed(some: DataFrame) -> DataFrame:
            """some, once for each cell that its labels belong to."""
            fits = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: self._mask_of_row(len(labels)).bitwiseAND(p) == p) if patterns else F.array().cast("array<int>")
            return some.withColumn("pattern", F.explode(fits)).withColumn("h", hashed).withColumn("t", text).join(keyed, ["h", "t", "pattern"])

        draw = random_order(F.col("row"), seed)
        self.members = placed(rows).select("plan_id", "cell_id", "row", draw.alias("draw"), F.shiftright(draw, 32 - SLICES_BITS).alias("slice"))
        combined = rows.groupBy(*[f"l{i}" for i in range(len(labels))]).agg(F.count("*").alias("n"))
        self._available = lambda: placed(combined).groupBy("plan_id", "cell_id").agg(F.sum("n").alias("available"))

    @staticmethod
    def _mask_of_row(n: int) -> Column:
        return sum((F.when(F.col(f"l{i}").isNotNull(), 1 << i).otherwise(0) for i in range(n)), F.lit(0))

    def _slices(self) -> DataFrame:
        """(plan_id, cell_id, slice, n, before): sizes of the slices of each cell's random order, combined per task."""
        sizes = self.members.groupBy("plan_id", "cell_id", "slice").agg(F.count("*").alias("n"))
        before = F.sum("n").over(W.partitionBy("plan_id", "cell_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
        return sizes.withColumn("before", F.coalesce(before, F.lit(0)))

    def _ranked(self, members: DataFrame, slices: DataFrame) -> DataFrame:
        inside = F.row_number().over(W.partitionBy("cell_id", "slice").orderBy("draw", "row"))
        return members.withColumn("inside", inside).join(slices.select("cell_id", "slice", "before"), ["cell_id", "slice"]).select("plan_id", "cell_id", "row", (F.col("before") + F.col("inside")).alias("rank"))

    def _with_priorities(self, ranked: DataFrame) -> DataFrame:
        cells = self._hint(self.cells.select("cell_id", "target_share", "min_rows"))
        return ranked.join(cells, "cell_id").select("plan_id", "cell_id", "row", "rank", (F.col("rank") <= F.coalesce("min_rows", F.lit(0))).alias("is_floor"), F.when(F.col("target_share") > 0, (F.col("rank") - 0.5) / F.col("target_share")).alias("priority"))

    def priorities(self) -> DataFrame:
        """All members with their random rank in the cell, is_floor and the divisor priority (rank - 0.5) / target_share."""
        return self._with_priorities(self._ranked(self.members, self._slices()))

    def allocation(self, available: DataFrame) -> DataFrame:
        """Seats of each cell from the number of rows it has; one group holds the cells of one plan."""
        cells = self.cells.select("plan_id", "cell_id", "target_share", "sample_rows", "min_rows").join(available, ["plan_id", "cell_id"], "left").na.fill(0, ["available"])
        dealt = cells.groupBy("plan_id").applyInPandas(seats, "plan_id long, cell_id long, seats long")
        return cells.join(dealt, ["plan_id", "cell_id"])

    def sample(self) -> DataFrame:
        """(plan_id, cell_id, row, rank, is_floor, priority): the rows drawn for each plan.

        The sizes of the slices say which slice holds a cell's last seat; later slices leave before anything is sorted.
        """
        slices = self._slices()
        seats_of = self._hint(self.allocation(slices.groupBy("plan_id", "cell_id").agg(F.sum("n").alias("available"))).select("cell_id", "seats"))
        kept = cut(slices.join(seats_of, "cell_id").where("before < seats"))  # cells x 256 rows at most
        last = self._hint(kept.groupBy("cell_id").agg(F.max("slice").alias("last"), F.first("seats").alias("seats")))
        few = self.members.join(last, "cell_id").where("slice <= last").drop("last", "seats")
        ranked = self._ranked(few, kept).join(last, "cell_id").where("rank <= seats").drop("last", "seats")
        return self._with_priorities(ranked)

    def report(self) -> DataFrame:
        """(plan_id, cell_id, available, wanted, min_rows, seats, unmet, short, reason) of every cell.

        wanted is target_share x sample_rows to the nearest whole number: the ranks whose divisor priority
        (rank - 0.5) / target_share is at most sample_rows. unmet: the first rank that the cell has no row for would
        still have got a seat, by that priority or as one of its min_rows floors. short is what the dealt seats lack of
        wanted, and reason says why: 'rows' (too few rows), 'floor' (too few rows for the floor only), 'other cells'
        (there are rows, but the sample's seats went to the floors of other cells). Rows are counted by their labels
        first, so the report shuffles combinations of labels, not rows.
        """
        dealt = self.allocation(self._available())
        wanted = F.coalesce(F.round(F.col("target_share") * F.col("sample_rows")).cast("long"), F.lit(0))
        by_share = F.coalesce(F.col("available") + 0.5 <= F.col("target_share") * F.col("sample_rows"), F.lit(False))
        by_floor = F.coalesce(F.col("available") + 1 <= F.col("min_rows"), F.lit(False))
        short = F.greatest(wanted - F.col("seats"), F.lit(0))
        reason = F.when(by_share, "rows").when(by_floor, "floor").when(short > 0, "other cells")
        return dealt.select("plan_id", "cell_id", "available", wanted.alias("wanted"), "min_rows", "seats", (by_share | by_floor).alias("unmet"), short.alias("short"), reason.alias("reason"))


def random_order(key: Column, seed: int = 42) -> Column:
    """A pseudo-random 32-bit order of bigint keys by integer steps that any engine can repeat; ties by the key itself."""
    low = F.lit(1 << 32)
    x = F.pmod(key, low).bitwiseXOR(F.pmod(F.shiftright(key, 32), low)).bitwiseXOR(F.lit(seed).cast("long"))
    for _ in range(2):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(0x45D9F3B), low)
    return x.bitwiseXOR(F.shiftright(x, 16))
