import heapq
import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm.copies import collapse_copies, copy_groups, hash_report
from factloom.llm.target_sample import TargetSample, seats


def letters(x):
    return "".join(c for c in x.lower() if c.isalnum())


def brute_copies(rows):
    keys = {}
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    ids = []
    for i, a, b in rows:
        if not a or not b or not letters(a) or not letters(b):
            continue
        ids.append(i)
        order = lambda x: "".join(sorted(filter(None, map(letters, x.split(";")))))
        for x, y in itertools.product({letters(a), order(a)}, {letters(b), order(b)}):
            k = tuple(sorted((x, y)))
            p, q = top(i), top(keys.setdefault(k, i))
            parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


ROWS = [
    (1, "Who is it?", "Name: A; Place: B"), (2, "who  IS it", "PLACE: B;\nNAME: A"), (3, "name a place b", "Who is it"), (4, "Who is it?", "Name: A, Place: C"), (5, None, "x"), (6, "x", None), (7, "?!", "x"), (8, "", "x"),
    (9, "Who; is it?", "Place: B; Name: A"), (10, "Straße", "x"), (11, "STRASSE", "X."), (12, "Ｗｈｏ is it", "name a place b"), (13, "a;b", "c"), (14, "b;a", "c"), (15, "ab", "c"), (16, "x" * 200_000, "y"), (17, "X" * 200_000, "Y"),
]


def test_copies(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "id long, q string, f string, key string").withColumn("first", F.lit(1)).repartition(4)
    got = {r.row: r.first for r in copy_groups(df, "id", "q", "f").collect()}
    want = brute_copies([(i, (a or "").replace("ß", "ss").replace("Ｗｈｏ", "Who") or None, b) for i, a, b in ROWS])
    assert got == want and got[2] == got[3] == got[9] == got[12] == 1 and got[4] == 4 and got[17] == 16
    counts = {r["first"]: r.copies for r in collapse_copies(df, "id", "q", "f").collect()}
    assert counts[1] == 5 and sum(counts.values()) == len(want)
    assert copy_groups(df.where("false"), "id", "q", "f").count() == 0


def test_a_third_of_all_rows_is_one_record(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("Same one")).otherwise(F.concat(F.lit("q"), "id")).alias("q"), F.lit("f").alias("f"))
    assert collapse_copies(df, "id", "q", "f").agg(F.max("copies")).first()[0] == 1000


def test_characters_of_copies(spark):
    """One record whatever form an accent, a joined letter or a separator has; vowel signs tell records apart."""
    rows = [(1, "caf\u00e9", "f"), (2, "cafe\u0301", "f"), (3, "\ufb01le", "f"), (4, "file", "f"), (5, "q", "\uff41; b"), (6, "q", "b\uff1b a"), (7, "\u0915\u093f", "f"), (8, "\u0915\u0940", "f"), (9, "x\u200by", "f"), (10, "XY", "f")]
    df = spark.createDataFrame(rows, "id long, q string, f string")
    assert {(r.row, r.first) for r in copy_groups(df, "id", "q", "f").collect() if r.row != r.first} == {(2, 1), (4, 3), (6, 5), (10, 9)}


def test_colliding_hashes_are_counted_and_merge_nothing(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "A", "b"), (3, "c", "d"), (4, None, "d")], "id long, q string, f string")
    bad = lambda pair: F.lit("00")
    assert tuple(hash_report(df, "id", "q", "f").first()) == (3, 2, 0) and tuple(hash_report(df, "id", "q", "f", digest=bad).first()) == (3, 1, 1)
    assert {(r.row, r.first) for r in copy_groups(df, "id", "q", "f", digest=bad).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert tuple(hash_report(df.where("false"), "id", "q", "f").first()) == (0, 0, 0)


def dealt(have, share, floor, room):
    """Seats by sorting every record: floors first, then priorities."""
    records = [(rank > floor[c], (rank - 0.5) / share[c] if share[c] > 0 else float("inf"), c, rank) for c in range(len(have)) for rank in range(1, have[c] + 1) if rank <= floor[c] or share[c] > 0]
    kept = heapq.nsmallest(room, records)
    return [sum(r[2] == c for r in kept) for c in range(len(have))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from([0.0, 0.05, 0.1, 0.3, 0.5]), st.integers(0, 4)), min_size=1, max_size=6), st.integers(0, 60))
def test_seats_against_sorting(cells, room):
    have, share, floor = (list(x) for x in zip(*cells))
    frame = pd.DataFrame({"plan_id": 1, "cell_id": np.arange(len(cells)), "available": have, "target_share": share, "min_rows": floor, "sample_rows": room})
    got = seats(frame)["seats"].tolist()
    want = dealt(have, share, floor, room)
    assert sum(got) == sum(want) and all(g <= h for g, h in zip(got, have))
    if sum(min(f, h) for f, h in zip(floor, have)) <= room:
        # equal but for ties: no priority left out is smaller than one that was kept
        least = [min(f, h) for f, h in zip(floor, have)]
        kept = [(g - 0.5) / s for g, s, m in zip(got, share, least) if s and g > m]
        left = [(g + 0.5) / s for g, s, h in zip(got, share, have) if s and g < h]
        assert not kept or not left or max(kept) <= min(left) + 1e-9


@pytest.fixture(scope="module")
def plan(spark):
    targets = spark.createDataFrame(
        [(1, 1, "A b", None, 0.5, 20, 2), (1, 2, "c", None, 0.5, 20, 2), (2, 3, None, True, 0.9, 10, 1), (2, 4, "none", False, 0.1, 10, 1), (3, 5, None, None, 1.0, 5, 0), (4, 6, "A b", None, 0.0, 5, 3)],
        "plan_id long, cell_id long, kind string, ok boolean, target_share double, sample_rows long, min_rows long",
    )
    rows = [(i, " a  B" if i % 3 else "C", i % 2 == 0) for i in range(60)] + [(100, None, None), (101, "other", None)]
    return spark.createDataFrame(rows, "id long, kind string, ok boolean").withColumn("slice", F.lit("clash")).withColumn("row", F.lit("clash")), targets


def test_sample(spark, plan):
    df, targets = plan
    t = TargetSample(df, targets, "id", ["kind", "ok"])
    report = {r.cell_id: r for r in t.report().collect()}
    assert {c: (r.available, r.seats, r.unmet) for c, r in report.items()} == {1: (40, 10, False), 2: (20, 10, False), 3: (30, 10, False), 4: (0, 0, True), 5: (62, 5, False), 6: (40, 3, False)}
    drawn = t.sample().collect()
    assert {c: sum(r.cell_id == c for r in drawn) for c in report} == {c: r.seats for c, r in report.items()}
    assert len({(r.cell_id, r.row) for r in drawn}) == len(drawn) and sorted(r["rank"] for r in drawn if r.cell_id == 1) == list(range(1, 11))
    again = TargetSample(df.repartition(7), targets, "id", ["kind", "ok"]).sample().collect()
    assert {(r.cell_id, r.row) for r in again} == {(r.cell_id, r.row) for r in drawn}
    other = TargetSample(df, targets, "id", ["kind", "ok"], seed=1).sample().collect()
    assert {(r.cell_id, r.row) for r in other} != {(r.cell_id, r.row) for r in drawn}


def test_shortfall(spark):
    """Floors of small cells take the seats of a large one: its rows would do, its seats do not."""
    targets = spark.createDataFrame([(1, 1, "big", 0.8, 100, 0), (1, 2, "x", 0.1, 100, 50), (1, 3, "y", 0.1, 100, 30), (2, 4, "z", 0.5, 10, 9), (2, 5, "big", 0.5, 10, 0), (3, 6, "y", 0.01, 100, 60)], "plan_id long, cell_id long, kind string, target_share double, sample_rows long, min_rows long")
    df = spark.range(1000).select("id", F.lit("big").alias("kind")).union(spark.range(2000, 2060).select("id", F.lit("X"))).union(spark.range(3000, 3040).select("id", F.lit(" y "))).union(spark.range(4000, 4005).select("id", F.lit("Z")))
    report = {r.cell_id: (r.wanted, r.seats, r.unmet, r.short, r.reason) for r in TargetSample(df, targets, "id", ["kind"]).report().collect()}
    assert report == {1: (80, 20, False, 60, "other cells"), 2: (10, 50, False, 0, None), 3: (10, 30, False, 0, None), 4: (5, 5, True, 0, "floor"), 5: (5, 5, False, 0, None), 6: (1, 40, True, 0, "floor")}


def test_empty_sides(spark, plan):
    df, targets = plan
    assert TargetSample(df, targets.where("false"), "id", ["kind", "ok"]).report().count() == 0
    r = TargetSample(df.where("false"), targets, "id", ["kind", "ok"]).report()
    assert r.count() == 6 and r.where("available = 0 and seats = 0").count() == 6
    assert TargetSample(df.where("false"), targets, "id", ["kind", "ok"]).sample().count() == 0
