import math
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm.broken_pairs import broken_pairs, defect, truncated
from factloom.llm.consistent_text import consistent_array, consistent_text
from factloom.llm.cut_texts import CUT, RUNNING, WEAK, WHOLE, CutTexts, ending, plainly_whole, significant_lengths
from factloom.llm.endings import open_parts
from factloom.llm.languages import foreign
from factloom.llm.tiling import greedy_tiles

PAIRS = {
    "Ａｂ１，": "Ab1,", "été": "été", "so­ft​": "soft", "a b c　d": "a b c d", "ﬁn ﬃ": "fin ffi", "Cоunсil": "Council", "Grοup": "Group", "հouse": "house",
    "Bokе́": "Boké", "﻿": "", "q̣̂": "q̣̂",
}
SAME = ["", "plain\ttext\n", "é ü ñ", "Жидя Рыжи", "θηξε αβγ", "m² 19½ №7 ™ “x” – ’", "かのる", "👍🏽 🙂", "\U0001f468‍\U0001f469", "❤️", "کتاب‌ها", "5 µm Ω"]


def test_forms():
    form, changed = consistent_array(pa.array([*PAIRS, *SAME, None]))
    assert form.to_pylist() == [*PAIRS.values(), *SAME, None]
    assert changed.tolist() == [k != v for k, v in PAIRS.items()] + [False] * (len(SAME) + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aeno Zé́̈Ａ１ ​ﬁжоеθο漢🙂\n"), max_size=12)), max_size=8))
def test_forms_are_stable_and_composed(values):
    form, _ = consistent_array(pa.array(values, pa.string()))
    again, changed = consistent_array(form)
    assert again.to_pylist() == form.to_pylist() and not changed.any()
    for v in form.to_pylist():
        assert v is None or not (set(v) & set(" ​ﬁＡ１")) and unicodedata.normalize("NFC", v) == v


MARKS = "".join(map(chr, [*range(0x300, 0x34F), *range(0x350, 0x370), 0x5AE, 0x93C, 0x94D, 0x9BE, 0xDCA, 0xDCF, 0x3099]))
CANONICAL = st.text(alphabet=st.one_of(st.sampled_from("aeouAqñệÅǰ"), st.sampled_from(MARKS), st.sampled_from("\u212b\u212a\uf900\u1112\u1161\u11ab한하\u11a8か\u0dd9\u09c7क\u0958")), max_size=14)


@settings(max_examples=300, deadline=None)
@given(CANONICAL, CANONICAL, st.randoms())
def test_canonically_equal_texts_have_one_form(a, b, r):
    """Marks of several classes in any order: equal under NFC is equal in form, the form stays, and it is equal to the text."""
    nfc, nfd = unicodedata.normalize("NFC", a), unicodedata.normalize("NFD", a)
    form = consistent_array(pa.array([a, nfd, nfc, a + "x" + b, nfc + "x" + unicodedata.normalize("NFD", b)]))[0].to_pylist()
    assert form[0] == form[1] == form[2] and form[3] == form[4]
    assert unicodedata.normalize("NFC", form[0]) == nfc and len(form[0]) == len(nfc)
    again, changed = consistent_array(pa.array(form))
    assert again.to_pylist() == form and not changed.any()


def test_more_forms():
    pairs = {"ｶﾞｯ": "ガッ", "noёl": "noël", "ᏢᎪx": "PAx", "ɡold": "gold", "a\u0302\u0323": "\u1ead", "a\u0323\u0302": "\u1ead", "\u00e2\u0323": "\u1ead", "\u212b\u212a\u2126\uf900": "\u00c5K\u03a9\u8c48", "\u1112\u1161\u11ab": "\ud55c"}
    same = ["соре", "ёлка", "З 3", "\u1ead"]
    form, changed = consistent_array(pa.array([*pairs, *same, "a" + "\u0323\u0302" * 20_000]))
    assert form.to_pylist()[:-1] == [*pairs.values(), *same] and changed.tolist()[:-1] == [True] * len(pairs) + [False] * len(same)
    assert unicodedata.normalize("NFC", form.to_pylist()[-1]) == unicodedata.normalize("NFC", "a" + "\u0323\u0302" * 20_000)


def test_sliced_arrays_and_null_chunks():
    a = pa.array(["skip", "Ａ", None, "b​"]).slice(1)
    assert consistent_array(a)[0].to_pylist() == ["A", None, "b"]
    assert consistent_array(pa.array([], pa.string()))[0].to_pylist() == []


def test_operator(spark):
    df = spark.createDataFrame([(1, "Ａ", "x"), (1, "Ａ", "x"), (2, None, "y"), (3, "z" * 200_000 + "​", "")], "id long, t string, form string").withColumn("field", F.lit(0))
    rows = consistent_text(df, "tab", "id", ["t", "form"]).collect()
    assert len(rows) == 8 and sum(r.changed for r in rows) == 3
    assert consistent_text(df, "tab", "id", ["t"], True).count() == 3 and consistent_text(df.where("false"), "tab", "id", ["t"]).count() == 0


@pytest.mark.parametrize("q, a, want", [
    ("Who planned X?", None, "empty"), ("Who planned X?", " N/A. ", "empty"), ("Who?", "--", "empty"), ("Who?", "[]", "empty"), ("Who?", "null", "empty"),
    ("Who planned Ana Bel?", "who planned ana bel ??", "copies_question"), ("Who planned Ana Bel?", "You asked: Who  planned Ana Bel?", "copies_question"), ("Who planned Ana Bel?", "WhoPlanned Ana Bel", "copies_question"),
    ("Who planned Ana Bel?", "Who planned Ana Bel? Tom Ray planned it.", None), ("Qui a dessiné Ana Bel ?", "C'est Tom Ray qui a dessiné Ana Bel.", None),
    ("Who?", "I'm sorry, but I can't help with that.", "refusal"), ("Wer?", "Das darf ich leider nicht beantworten.", "refusal"), ("¿Quién?", "Prefiero no opinar sobre eso.", "refusal"), ("Qui ?", "Je ne suis pas en mesure de répondre.", "refusal"),
    ("Who?", "Tom Ray planned it. The Trust could not prevent it.", None), ("Who?", "Before that, Ana had refused to sign the papers.", None),
    ("Where is X?", "La ville où se trouve X est Rom.", "other_language"), ("Wo steht X?", "The town where X stands is Rom.", "other_language"), ("Where is X?", "Столица этой страны.", "other_language"), ("In welchem Ort steht X?", "X steht am Rand von Rom.", None), ("Where is X?", "It stands in Rom. The local name is Жидя.", None),
    ("Where is X?", "X stands on the ed", "truncated"), ("Where is X?", "X stands near Dr.", "truncated"), ("Where is X?", "X stands…", "truncated"), ("Where is X?", "It is called (by some", "truncated"), ("Where?", "Rom", None), ("How many?", "2,039", None), ("Who?", "Ana Bel", None), ("Who?", "ana bel", None), ("What?", "Maps, stamps, etc.", None),
])
def test_defects(q, a, want):
    assert defect(q, a) == want


ADVICE = " You could try the city's website, or ask a librarian near you, who may be able to point you to a printed guide; please also consult other sources before you decide anything that matters."
FRANCE = "What is the capital of France?"


@pytest.mark.parametrize("q, a, want", [
    (FRANCE, "What is capital of France?", "copies_question"), (FRANCE, "What's the capital of France", "copies_question"), (FRANCE, "The question was: What is the capital of France", "copies_question"), (FRANCE, "The capital of France is Paris.", None),
    ("Is Paris the capital of France?", "Paris is the capital of France.", None), ("Did the Harbour Museum open in 1990?", "The Harbour Museum opened in 1990.", None), (FRANCE, FRANCE + " " + "It is Paris. " * 40, None), (FRANCE, "W" * 100_000, None),
    (FRANCE, "I'm sorry, but I cannot answer that." + ADVICE, "refusal"), (FRANCE, "As an AI language model, this question falls outside what I do.", "refusal"), (FRANCE, "Thank you for the question. I looked at it with care. Sadly I cannot answer that.", "refusal"),
    (FRANCE, "It is Paris. I cannot comment on the rest.", None), (FRANCE, "I cannot say for sure, but it was Paris.", None), (FRANCE, "I can't help with that. The capital is Paris, and it has been since 987.", None), ("Wer plante X?", "Das kann ich leider nicht sagen. Der Bau wurde von Ana Bel geplant.", None),
    ("Какая столица Франции?", "法国的首都是巴黎。", "other_language"), ("フランスの首都はどこですか", "巴黎", None), (FRANCE, "Stolicą Francji jest Paryż, położony nad Sekwaną i należący do największych miast.", "other_language"), (FRANCE, "başkent nehrin yanında bulunan eski bir kent olarak bilinir.", "other_language"), (FRANCE, "Maps, stamps, coins, letters, drawings and prints.", None), (FRANCE, "paris, london, rome, berlin", None),
    (FRANCE, "<div><b>Paris is the capital.", "truncated"), (FRANCE, "'Paris is the capital.", "truncated"), (FRANCE, '"Paris is the capital.', "truncated"), (FRANCE, "The traders' house, 'tis said, stood in the '90s.", None), (FRANCE, "It is 'Paris' (\"the city\").", None), (FRANCE, "```\nprint('(')\n```\nDone.", None), (FRANCE, "```\nParis.", "truncated"), (FRANCE, "- Paris.\n-", "truncated"), (FRANCE, "A <br/> line.", None),
])
def test_whole_answers_are_judged(q, a, want):
    assert defect(q, a) == want


def test_profiles_on_held_out_sentences():
    """Sentences that are in no profile: each is told from the other languages, and from its own it is not."""
    held_out = {
        "en": "every summer the members of the club row across the lake to remember their founder", "fr": "chaque été les membres du club traversent le lac à la rame pour se souvenir de leur fondateur", "de": "jeden sommer rudern die mitglieder des vereins über den see und erinnern an ihren gründer", "es": "cada verano los miembros del club cruzan el lago a remo para recordar a su fundador",
        "it": "ogni estate i soci del circolo attraversano il lago a remi per ricordare il loro fondatore", "pt": "todos os verões os membros do clube atravessam o lago a remo para lembrar o seu fundador", "nl": "elke zomer roeien de leden van de club over het meer om hun oprichter te gedenken", "pl": "każdego lata członkowie klubu przepływają jezioro, aby uczcić pamięć założyciela", "sv": "varje sommar ror klubbens medlemmar över sjön för att minnas sin grundare",
    }
    questions = {"en": "Who was the founder of the club?", "fr": "Qui est le fondateur du club ?", "de": "Wer ist der Gründer des Vereins?", "es": "¿Quién es el fundador del club?"}
    wrong = [(a, b) for a, q in questions.items() for b, said in held_out.items() if (defect(q, said + ".") == "other_language") != (a != b)]
    assert wrong == []


def test_pairs_operator(spark):
    df = spark.createDataFrame([(1, "Who?", None, "Ana"), (2, "", None, None), (3, None, "", ""), (4, "Who?", "Ａna​", "x" * 300_000), (1, "Who?", None, "Ana")], "id long, q string, a string, b string").withColumn("row_id", F.lit("clash"))
    assert sorted(tuple(r) for r in broken_pairs(df, "id", "q", ["a", "b"]).collect()) == [(1, "a", "empty"), (1, "a", "empty")]
    assert broken_pairs(df.where("false"), "id", "q", ["a"]).count() == 0


def test_languages_of_short_texts():
    assert not foreign("Wo?", "Wo sonst?") and not foreign("", "la la la") and foreign("How many members does it have?", "Il y a 12 membres dans le club.")


def brute_longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=24), st.text("abc", max_size=24), st.integers(1, 5))
def test_tiles(a, b, least):
    tiles = greedy_tiles(a, b, least)
    longest = brute_longest(a, b)
    assert (tiles[0][2] if tiles else 0) == (longest if longest >= least else 0)
    used_a, used_b = [i + x for i, _, n in tiles for x in range(n)], [j + x for _, j, n in tiles for x in range(n)]
    assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b) and all(a[i : i + n] == b[j : j + n] and n >= least for i, j, n in tiles)


@pytest.mark.parametrize("text", [None, "", " \n", "A b c.", "He left! ", "Is it?", 'He said "no."', "(See the entry on X.)", "All of it.\nLast revised: 1999-04-21", "It ended.\n* * *", "It ended. 🙂", "It ended.\n— Ana Bel, archive desk —", "It ended.\n[end of entry]", "It ended.\nEND OF RECORD", "Maps, stamps, etc.", "終わり。"])
def test_whole(text):
    assert ending(text) == WHOLE


@pytest.mark.parametrize("text", ["It was built. The tow", "It was built. The ", "It was built in 19", "It was built by Dr.", "It was built. It is approx.", "It was built…", "It was bui...", "It was built [...", "It was built by &quo", "It was built. The<p cla", "It was built. Caf�", "It was built.\nVerdict:", "It was built.\nLast revised: 1999-04-2", "It ended.\n[end of ent", "It was built, "])
def test_cut(text):
    assert ending(text) == CUT


def test_stack():
    assert open_parts('a (b [c] d) "e"') == [] and open_parts("a (b [c") == ["(", "["] and open_parts("```\nx") == ["```"] and open_parts("a ) b") == []


@pytest.mark.parametrize("answer, cut_off", [("1. Rome.\n2.", True), ("- Rome.\n- Bonn.\n*", True), ("It is <b>Rome.", True), ("<ul>It is <em>Rome</em>.", True), ("1. Rome.\n2. Bonn.", False), ("It was built in\n1999.", False), ("It is <b>Rome</b>.", False), ("It is <br>Rome.", False), ("2 <3 and 4> 3.", False)])
def test_lists_and_elements(answer, cut_off):
    assert truncated(answer) is cut_off


def test_limits_and_report(spark):
    rows = [(i, "s", "w" * (60 + int(-80 * math.log((i + 0.5) / 400))) + " is so.") for i in range(400)] + [(1000 + i, "s", ("This is it. " + "wo" * 100)[:150]) for i in range(60)] + [(2000 + i, None, None) for i in range(3)] + [(3000, "t", "   ")]
    df = spark.createDataFrame(rows, "id long, src string, t string").withColumn("source", F.lit("clash"))
    c = CutTexts(df, "id", "t", "src")
    assert {(r.source, r.unit, r.length) for r in c.limits().collect()} == {("s", "chars", 150), ("s", "bytes", 150)}
    assert c.found().count() == 60
    report = {r.source: r for r in c.report().collect()}
    assert (report["s"].texts, report["s"].cut, report["s"].at_limit, report[None].cut, report["t"].cut) == (460, 60, 60, 0, 0)
    none = CutTexts(df.where("false"), "id", "t", "src")
    assert none.found().count() == 0 and none.report().count() == 0


def test_limits_decide_what_endings_leave_open(spark):
    """Titles cut at a source's limit are found there only; a running line off the limits where its source ends whole."""
    whole = [(i, "s", "w" * (40 + i % 300) + " ends so.") for i in range(600)]
    at_limit = [(1000 + i, "s", ("Old Harbour Museum Guide " + chr(65 + i % 26) * 80)[:70]) for i in range(40)]
    titles = [(2000 + i, "s", "Old Harbour Guide " + "W" * i) for i in range(5)]
    running = [(3000, "s", "They built many houses quickly then stopped workin"), (3001, "loose", "They built many houses quickly then stopped workin"), (3002, "loose", "Old Harbour")]
    null, blank = [(4000 + i, None, "w" * (30 + i) + " is so.") for i in range(60)] + [(4100 + i, None, ("Grand Hotel " * 9)[:70]) for i in range(30)], [(5000 + i, "", ("Grand Hotel " * 9)[: 50 + i]) for i in range(30)]
    c = CutTexts(spark.createDataFrame(whole + at_limit + titles + running + null + blank, "id long, src string, t string"), "id", "t", "src")
    assert {(x.source, x.unit, x.length) for x in c.limits().collect()} == {(src, u, 70) for src in ("s", None) for u in ("chars", "bytes")}
    rules = {x.key: x.rule for x in c.marked().where("rule is not null").collect()}
    assert rules == {i: "limit" for i in [*range(1000, 1040), *range(4100, 4130)]} | {3000: "habit"}
    assert {ending(t) for _, _, t in at_limit} == {WEAK} and ending(running[0][2]) == RUNNING


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["It", "ends", "Dr.", "the.", "etc.", "so.", "so!", "?", "…", "..", "ÉTÉ.", "x.”", "\n", " ", "\u00a0", "e.g.", "🙂", "12."]), max_size=6).map(" ".join), max_size=30))
def test_the_plain_rule_agrees(spark, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", plainly_whole(F.col("t")).alias("plain")).collect()
    assert all(ending(r.t) == WHOLE for r in rows if r.plain)


def test_even_lengths_have_no_limit(spark):
    judged = spark.range(2000).selectExpr("id as key", "'s' as source", "100 + cast(-200 * ln((id + 0.5) / 2000) as bigint) as chars", "100 + cast(-200 * ln((id + 0.5) / 2000) as bigint) as bytes", "0 as ending")
    assert significant_lengths(judged).count() == 0
