import itertools
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import encoding
from factloom.llm.encoding import PATTERN, VOCABULARY, BatchMerges, encode_corpus, merge, read_ranks
from factloom.llm.leaks import leak_report, leaked_passages
from factloom.llm.tiling import greedy_tiles
from factloom.llm.transducer import Transducer, build
from factloom.llm.words import words


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=0, max_size=6), st.lists(st.integers(0, 99), max_size=4), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
def test_transducer(tmp_path_factory, table, others):
    path = str(tmp_path_factory.mktemp("t") / "x.fst")
    build(sorted(table.items()), path)
    t = Transducer(path)
    asked = [*table, *others]
    for word, n in zip(asked, t.numbers(asked).tolist()):
        if word in table and word:
            assert t.outputs(n) == table[word]
        elif word:
            assert n == -1
    with pytest.raises(ValueError):
        build([(b"b", []), (b"a", [])], path)


def test_suffixes_are_shared(tmp_path):
    words_ = sorted(f"{a}{b}ingly".encode() for a in "abcdefgh" for b in "klmnop")
    build(((w, [1]) for w in words_), str(tmp_path / "x"))
    assert len(Transducer(str(tmp_path / "x")).final) < 12


def test_merge_is_exact(ranks, public):
    r = random.Random(4)
    for n in (1, 2, 5, 20, 48, 49, 300, 5000):
        for alphabet in ("ab", "theing", "aéß漢🙂x"):
            text = "".join(r.choice(alphabet) for _ in range(n))
            assert [i for w in __import__("regex").findall(PATTERN, text) for i in merge(w.encode(), ranks)] == public.encode_ordinary(text)


def test_batch_merges_are_the_merges(ranks):
    r = random.Random(6)
    pieces = ["".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 5, 9, 20, 47, 48, 49, 80]))).encode() for alphabet in ("ab", "theing ", "aéß漢🙂x", "aaab") for _ in range(200)]
    pieces += [b"", b"\xff\xfe", b" the", *pieces[:5]]
    batch = BatchMerges(ranks)
    assert batch(pieces) == [merge(p, ranks) for p in pieces] and batch([]) == []


def test_corpus(spark, public):
    texts = [None, "", " ", "Hello  world\n\n x", "<|endoftext|> it's", "Kebofas Trıst 漢字🙂 y", "word " * 40_000, "z" * 50_000, "Hello  world\n\n x"]
    df = spark.createDataFrame([(i % 8, t, i) for i, t in enumerate(texts)], "k int, t string, ids int").withColumn("text", F.lit(1)).repartition(3)
    got = encode_corpus(df, "k", "t", words=16).collect()
    want = sorted((i % 8, public.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert sorted((r.key, list(r.ids)) for r in got) == want
    assert encode_corpus(df.where("false"), "k", "t").count() == 0


def test_a_lexicon_in_another_file_system(spark, public, monkeypatch):
    """A shared folder that is no path of its own: the file goes through Hadoop's file systems."""
    monkeypatch.setattr(encoding, "posix_path", lambda uri: None)
    df = spark.createDataFrame([(1, "Hello world, hello")], "k int, t string")
    assert list(encode_corpus(df, "k", "t").first().ids) == public.encode_ordinary("Hello world, hello")


def brute(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, p in items:
            v = words(p)
            if any(tuple(v[j : j + run]) in grams for j in range(len(v) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_leaks(spark, blocks):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(12)] + [(50, None), (51, "short one"), (52, "")]
    docs = [(90, None), (91, ""), (92, "  ")]
    for d in range(80):
        text = [r.choice(vocabulary) for _ in range(60)]
        for _ in range(r.randint(0, 3)):
            p = words(r.choice(items[:12])[1])
            a, n, at = r.randrange(18), r.randint(8, 14), r.randrange(60)
            text[at:at] = p[a : a + n]
        docs.append((d, ", ".join(text).upper()))
    df = spark.createDataFrame(docs + docs[-1:], "id long, t string").withColumn("doc_id", F.lit("clash")).repartition(4)
    q = spark.createDataFrame(items, "i long, p string")
    total = sum(len(p or "") for _, p in items)
    got = leaked_passages(df, "id", "t", q, "i", "p", block_chars=-(-total // blocks)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == brute(docs, items, 12)
    assert all(x.longest >= 12 and 0 < x.coverage <= 1 for x in got)
    assert leaked_passages(df.where("false"), "id", "t", q, "i", "p").count() == 0 and leaked_passages(df, "id", "t", q.where("false"), "i", "p").count() == 0


def test_reordered_passages_show_in_the_coverage(spark):
    p = [f"a{i}" for i in range(40)]
    doc = " ".join([*p[20:40], "mid", *p[:20]])
    df, q = spark.createDataFrame([(1, doc)], "id long, t string"), spark.createDataFrame([(7, " ".join(p))], "i long, p string")
    found = leaked_passages(df, "id", "t", q, "i", "p")
    row = found.first()
    assert (row.longest, row.tiles, row.coverage) == (20, 2, 1.0) and leak_report(found).first().documents == 1


def test_short_pieces_are_found_by_their_coverage(spark):
    p = [f"a{i}" for i in range(40)]
    doc = " mid ".join(" ".join(p[i : i + 8]) for i in (32, 16, 0, 24, 8))
    df, q = spark.createDataFrame([(1, doc), (2, " ".join(p[:8]))], "id long, t string"), spark.createDataFrame([(7, " ".join(p))], "i long, p string")
    assert leaked_passages(df, "id", "t", q, "i", "p").count() == 0
    assert [(r.doc_id, r.longest, r.tiles, r.coverage) for r in leaked_passages(df, "id", "t", q, "i", "p", coverage=0.5).collect()] == [(1, 8, 5, 1.0)]


def tiled_leaks(docs, items, run, piece, share):
    out = set()
    for (d, t), (i, p) in itertools.product(docs, items):
        a, b = words(p), words(t)
        tiles = greedy_tiles(a, b, piece)
        if a and (max((x[2] for x in tiles), default=0) >= run or sum(x[2] for x in tiles) >= share * len(a) - 1e-9):
            out.add((d, i))
    return out


@pytest.mark.parametrize("chars", [10**6, 10])
def test_both_ways_find_the_same_reordered_passages(spark, chars):
    """Against all pairs: passages with a common opening, cut in pieces and shuffled, by broadcast and by shuffle join."""
    r = random.Random(8)
    opening = [f"o{i}" for i in range(9)]
    items = [(i, " ".join(opening + [f"v{r.randrange(60)}" for _ in range(r.choice([3, 20, 31]))])) for i in range(15)]
    items.append((20, " ".join(opening[:5] * 8)))
    docs = []
    for d in range(60):
        p = words(r.choice(items)[1])
        size = r.choice([4, 5, 6, 10, 13])
        pieces = [p[i : i + size] for i in range(0, len(p), size)]
        r.shuffle(pieces)
        docs.append((d, " ".join(w for piece in pieces[: r.randint(1, len(pieces))] for w in [*piece, "mid"]) + " " + " ".join(opening[: r.randrange(9)])))
    df, q = spark.createDataFrame(docs, "id long, t string").repartition(4), spark.createDataFrame(items + items[:1] + [(99, None), (98, "")], "i long, p string")
    got = leaked_passages(df, "id", "t", q, "i", "p", coverage=0.6, block_chars=chars).collect()
    want = tiled_leaks(docs, items, 12, 5, 0.6)
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) + sum(i == items[0][0] for _, i in want)
    assert {(x.doc_id, x.item_id) for x in leaked_passages(df, "id", "t", q, "i", "p", block_chars=chars).collect()} == brute(docs, items, 12)
    assert leaked_passages(df, "id", "t", q.where("false"), "i", "p", 12, 5, 0, 0.5).count() == 0 and leaked_passages(df.where("false"), "id", "t", q, "i", "p", 12, 5, 0, 0.5).count() == 0
