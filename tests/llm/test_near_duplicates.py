import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import near_duplicates
from factloom.llm import words as near_words
from factloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_members

WORD = re.compile(r"[^\W_]+")


def runs(text, k):
    w = WORD.findall(text.lower())
    return frozenset(zip(*(w[i:] for i in range(k)))), tuple(w)


def brute(rows, k, t):
    """Components by comparing every pair."""
    sets = {i: runs(x, k) for i, x in rows if x is not None}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (x, wx), (y, wy) = sets[a], sets[b]
            if (x or y) and len(x & y) >= t * len(x | y) - 1e-12 or not x and not y and wx == wy:
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in sets}


def corpus(seed, n=100, vocabulary=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            base = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 9)):
                base[r.randrange(len(base))] = r.choice(words)
        else:
            base = [r.choice(words) for _ in range(r.randint(8, 40))]
        rows.append((i + 1, " ".join(base)))
    return rows


@pytest.mark.parametrize("seed, k, t, hot", [(1, 3, 0.6, 96), (2, 3, 0.6, 5), (3, 5, 0.8, 96)])
def test_against_all_pairs(spark, seed, k, t, hot):
    rows = corpus(seed) + [(900, ""), (901, ""), (902, "w1"), (903, "W1!"), (904, None), (905, "w1 w2")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id long, t string, mask string").withColumn("row", F.lit(0)).withColumn("text", F.lit("x"))
    got = {r.row: r.component for r in near_duplicate_groups(df.repartition(5), "id", F.col("t"), k=k, similarity=t, hot_table=hot).collect()}
    assert got == brute(rows, k, t)


def test_a_third_of_all_rows_equal_or_nearly(spark):
    base = [f"a{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(200)] + [(1000 + i, " ".join([*base[:30], f"x{i}", *base[31:]])) for i in range(200)] + [(2000 + i, " ".join(f"b{i}x{j}" for j in range(30))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(6)
    got = near_duplicate_members(df, "id", F.col("t"), k=3, similarity=0.6)
    assert got.count() == 400 and got.where("component <> 0").count() == 0


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, None)], "id long, t string")
    assert near_duplicate_groups(df, "id", F.col("t")).count() == 0
    long = " ".join(f"t{i % 5000}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x")], "id long, t string")
    assert {(r.row, r.component) for r in near_duplicate_groups(df, "id", F.col("t")).collect()} == {(1, 1), (2, 1), (3, 3)}


@pytest.mark.parametrize("seed, k, t, hot", [(2, 3, 0.6, 2), (4, 1, 0.5, 4), (5, 2, 1.0, 3)])
def test_crowded_tables_against_all_pairs(spark, seed, k, t, hot):
    rows = corpus(seed, 160) + [(900, ""), (901, ""), (902, "w1"), (903, "W1!"), (904, None), (905, "w1 w2")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.row: r.component for r in near_duplicate_groups(df.repartition(5), "id", F.col("t"), k=k, similarity=t, hot_table=hot).collect()}
    assert got == brute(rows, k, t)


def test_a_phrase_in_unlike_rows_is_not_paired_off(spark, monkeypatch):
    """No row is near a pivot of the six rounds, so all other rows are still open after the last one."""
    phrase = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join([*phrase, *[f"r{i}x{j}" for j in range(20)]])) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(140, 150)]
    compared = []
    plain = near_duplicates._similarities

    def counted(pairs, texts, k):
        compared.append(pairs.count())
        return plain(pairs, texts, k)

    monkeypatch.setattr(near_duplicates, "_similarities", counted)
    texts = spark.createDataFrame(rows, "row long, text string")
    links = near_duplicates._hot_links(texts.select(F.lit(1).cast("long").alias("mask"), "row"), texts, 3, 0.6)
    assert {(r.a, r.b) for r in links.where("a <> b").collect()} == {(i, 1000 + i) for i in range(140, 150)}
    assert len(compared) == 13 and compared[-1] == 10 and sum(compared) < 7 * len(rows)


def counted_comparisons(monkeypatch):
    counts, plain = [], near_duplicates._similarities

    def counted(pairs, texts, k):
        counts.append(pairs.count())
        return plain(pairs, texts, k)

    monkeypatch.setattr(near_duplicates, "_similarities", counted)
    return counts


def boilerplate(n, seed=3):
    """Unlike rows behind one lead; one in twenty repeats an earlier row with a word changed."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        tail = [f"w{r.randrange(20_000)}" for _ in range(12)]
        if i % 20 == 19:
            tail = rows[r.randrange(len(rows))][1].split()[20:]
            tail[r.randrange(12)] = f"e{i}"
        rows.append((i, " ".join([f"lead{j}" for j in range(20)] + tail)))
    return rows


@pytest.mark.parametrize("heavy_rows", [near_duplicates.HEAVY_ROWS, 50])
def test_a_lead_of_all_rows_costs_in_proportion(spark, monkeypatch, heavy_rows):
    """1,000 rows equal to all pairs; 5,000 rows of one table compare not much more than five times as many."""
    counts = counted_comparisons(monkeypatch)
    total = []
    for n in (1000, 5000):
        rows = boilerplate(n)
        df = spark.createDataFrame(rows, "id long, t string").repartition(4)
        got = {r.row: r.component for r in near_duplicate_groups(df, "id", F.col("t"), k=3, similarity=0.6, heavy_rows=heavy_rows).collect()}
        if n == 1000:
            assert got == brute(rows, 3, 0.6)
        total.append(sum(counts))
        counts.clear()
    assert 0 < total[1] <= 5 * 1.3 * total[0] + 100 and total[1] < 5 * 5000


@pytest.mark.parametrize("seed, k, t, hot, heavy_rows", [(7, 3, 0.6, 3, 2), (8, 2, 0.7, 96, 4)])
def test_heavy_runs_against_all_pairs(spark, seed, k, t, hot, heavy_rows):
    rows = corpus(seed, 120, 25)
    df = spark.createDataFrame(rows, "id long, t string").repartition(5)
    got = {r.row: r.component for r in near_duplicate_groups(df, "id", F.col("t"), k=k, similarity=t, hot_table=hot, heavy_rows=heavy_rows).collect()}
    assert got == brute(rows, k, t)


def test_entries_survive_packing():
    r = np.random.default_rng(2)
    for n in (1, 2, 5000):
        masks = r.integers(0, 2**64, n, np.uint64)
        rows, sizes, positions = r.integers(-(2**62), 2**62, n), r.integers(1, 2**31, n), r.integers(0, 2**31, n)
        rows[::3], sizes[::3] = rows[0], sizes[0]
        got = near_duplicates._unpack(*near_duplicates._pack(masks, rows, sizes, positions))
        assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(masks.tolist(), rows.tolist(), sizes.tolist(), positions.tolist()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB1_ .,éÉß漢字İΣς𝔄٣²\n'-"), max_size=20)), max_size=6), st.integers(1, 30))
def test_hashed_words_are_the_words(values, chars):
    """As many words as the pattern finds in each text, equal hashes for equal words; in slices of any size."""
    plain, near_words._CHARS = near_words._CHARS, chars
    try:
        flat, starts = near_words.word_hashes(pa.array(["skip", *values], pa.string()).slice(1))
    finally:
        near_words._CHARS = plain
    listed = [near_words.words(v) for v in values]
    assert np.diff(starts).tolist() == [len(x) for x in listed]
    pairs = set(zip((w for x in listed for w in x), flat.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
