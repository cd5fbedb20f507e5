"""Every policy against plain truth functions over all verdict lists up to two (three for the cascade)."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from factloom.functions import parsing, text
from factloom.operators import batch_policies, escalation, scoring

V = ("YES", "NO", "NOT SURE")
LISTS = [list(x) for n in range(3) for x in product(V, repeat=n)]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(s, a, o, t) for s in LISTS for a in LISTS for o in V for t in (True, False, None)]
    return spark.createDataFrame(rows, "syn array<string>, ant array<string>, orig string, truth boolean").repartition(4).cache()


def test_fixture_sizes(cases):
    assert cases.count() == 1521 and len(LISTS) ** 2 == 169


def expected_escalation(policy, syn, ant):
    sc, ac = sum(v != "YES" for v in syn), sum(v != "NO" for v in ant)
    sn, an = len(syn) or 1, len(ant) or 1
    paradox = ("YES" in syn and "YES" in ant) or ("NO" in syn and "NO" in ant)
    if policy == "strict":
        return [r for c, r in ((sc, "Strict: Synonym anomaly"), (ac, "Strict: Antonym anomaly"), (paradox, "Strict: Logical paradox")) if c]
    if policy == "paradox_only":
        return ["ParadoxOnly: Logical paradox"] if paradox else []
    out = ["StructureAware: Logical paradox"] if paradox else []
    for side, k, n in (("Synonym", sc, sn), ("Antonym", ac, an)):
        if k >= 2 or k / n >= 0.4:
            out.append(f"StructureAware: {side} anomaly threshold reached ({k}/{n})")
    return out


@pytest.mark.parametrize("policy", ["strict", "paradox_only", "structure_aware", "no such policy"])
def test_escalation(spark, policy):
    lists = [list(x) for n in range(4) for x in product(V, repeat=n)]
    df = spark.createDataFrame([(s, a) for s in lists for a in lists], "syn array<string>, ant array<string>").repartition(4)
    rows = escalation.escalation(df, "syn", "ant", policy).collect()
    assert len(rows) == 1600
    for r in rows:
        want = expected_escalation(policy, r.syn, r.ant)
        assert r.reasons == want and r.escalated == bool(want) and r.risk_prior == ""


def test_strict_and_structure_agree_up_to_two(spark, cases):
    pairs = cases.select("syn", "ant").distinct()
    a = escalation.escalation(pairs, "syn", "ant", "strict").select("syn", "ant", F.col("escalated").alias("x"))
    b = escalation.escalation(pairs, "syn", "ant", "structure_aware").select("syn", "ant", F.col("escalated").alias("y"))
    assert a.join(b, ["syn", "ant"]).where("x <> y").count() == 0
    three = spark.createDataFrame([(["YES", "YES", "NO"], [])], "syn array<string>, ant array<string>")
    assert [escalation.escalation(three, "syn", "ant", p).first().escalated for p in ("strict", "structure_aware")] == [True, False]


def quiet(truth, orig):
    if truth and orig != "YES":
        return "Silent Failure", "Missed True Fact"
    if not truth and orig == "YES":
        return "Silent Failure", "Missed Hallucination"
    return "None", "Success"


def expected_batch(policy, orig, syn, ant, truth):
    truth = bool(truth)
    t, f = [], []
    both = [(("YES" == orig or "YES" in syn) and "YES" in ant, "Contradictory Both YES"), (("NO" == orig or "NO" in syn) and "NO" in ant, "Contradictory Both NO")]
    if policy == "strict":
        hits = [(orig != ("YES" if truth else "NO"), "original", ("False Negative / Not Sure", "False Positive / Not Sure")), (any(v != ("YES" if truth else "NO") for v in syn), "synonym inconsistency", ("Inconsistent on Synonym", "Inconsistent on Synonym (False Positive)")), (any(v != ("NO" if truth else "YES") for v in ant), "antonym inconsistency", ("Failed to reject Antonym", "Inconsistent on Antonym"))]
        t, f = [n for h, n, _ in hits if h], [s[not truth] for h, _, s in hits if h]
        return (bool(t), " + ".join(t) or "None", " + ".join(f) or "None")
    if policy == "paradox_only":
        if syn and ant and set(syn) == set(ant) == {"NOT SURE"}:
            return True, "confidence collapse", "All NOT SURE"
    elif orig == "NOT SURE":
        t, f = ["original uncertainty"], ["Original Factoid NOT SURE"]
    for hit, said in both:
        if hit:
            t.append("logical paradox")
            f.append(said)
    if policy == "structure_aware" and orig != "NOT SURE":
        so, ao = sum(v != orig for v in syn), sum(v != ("NO" if orig == "YES" else "YES") for v in ant)
        for hit, said in ((ao >= 2, "Antonym Defense Breached (>=2 errors)"), (so >= 1 and ao >= 1, "Dual-sided Defense Breached (Syn>=1 & Ant>=1)")):
            if hit:
                t.append("threshold anomaly")
                f.append(said)
    if t:
        return True, " + ".join(dict.fromkeys(t)), " + ".join(f)
    return (False, *quiet(truth, orig))


@pytest.mark.parametrize("policy", list(batch_policies.POLICIES))
def test_batch_policy(cases, policy):
    for r in batch_policies.apply_policy(cases, policy).collect():
        assert (r.escalated, r.trigger, r.failure) == expected_batch(policy, r.orig, r.syn, r.ant, r.truth), r


def test_unknown_batch_policy_raises(cases):
    with pytest.raises(ValueError):
        batch_policies.apply_policy(cases, "nothing")


def test_original_correct_on_null_truth(spark):
    df = spark.createDataFrame([(None, "NO"), (None, "YES"), (True, "YES"), (False, "NOT SURE")], "t boolean, o string")
    rows = df.select(batch_policies.original_correct(F.col("t"), F.col("o")).alias("a"), batch_policies.original_correct(F.col("t"), F.col("o"), "false").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(False, True), (False, False), (True, True), (False, False)]


@pytest.mark.parametrize(
    "raw, want",
    [("NO. I am not sure", "NOT SURE"), ("NOTSURE", "NOT SURE"), ("YESNO", "NOT SURE"), ("", "NOT SURE"), (None, "NOT SURE"), ("yes.", "YES"), ("Well, no!", "NO"), ("yes or no", "YES"), ("é yes", "YES"), ("_yes", "NOT SURE"), ("éyes", "NOT SURE")],
)
def test_verdict(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(parsing.verdict(F.col("x"))).first()[0] == want


def test_batch_verdict_turns_unsure_into_no(spark):
    df = spark.createDataFrame([("not sure",), ("YES",), (None,)], "x string")
    assert [r[0] for r in df.select(parsing.batch_verdict(F.col("x"))).collect()] == ["NO", "YES", "NO"]
    assert [r[0] for r in df.select(parsing.batch_verdict(F.col("x"), "tri")).collect()] == ["NOT SURE", "YES", "NOT SURE"]


def test_factoids(spark):
    raws = {"[]": [], '{"a":1}': ["A"], '["x"] trailing': ["A"], '```json\n["x","y"]\n```': ["x", "y"], "[1,2]": ["1", "2"], "plain": ["A"], '"text"': ["A"], None: ["A"]}
    df = spark.createDataFrame([(k,) for k in raws], "x string")
    got = {r.x: r.f for r in df.select("x", parsing.factoids(F.col("x"), F.lit("A")).alias("f")).collect()}
    assert got == raws


def test_mutations_and_snippets(spark):
    df = spark.createDataFrame([(" a \n\n b\nc", "x" * 60), (None, None)], "m string, s string")
    rows = df.select(parsing.mutations(F.col("m"), 2).alias("m"), text.snippet(F.col("s"), 50).alias("s"), text.preview(F.lit(" a  b\tc "), 3).alias("p")).collect()
    assert rows[0].m == ["a", "b"] and rows[0].s == "x" * 50 + "..." and rows[0].p == "a b ..." and rows[1].m == [] and rows[1].s is None


def test_scores(spark, cases):
    cost = {"syn": {"YES": 0, "NO": 1}, "ant": {"YES": 1, "NO": 0}}
    for r in cases.select("syn", "ant", scoring.list_score(F.col("syn"), F.col("ant")).alias("s")).distinct().collect():
        costs = [cost["syn"].get(v, 0.5) for v in r.syn] + [cost["ant"].get(v, 0.5) for v in r.ant]
        assert abs(r.s - (sum(costs) / len(costs) if costs else 0.0)) < 1e-12
    odd = spark.createDataFrame([("syn", "maybe"), ("other", "NO"), ("ant", None)], "k string, v string")
    assert [tuple(r) for r in odd.select(scoring.penalty(F.col("k"), F.col("v")), scoring.penalty(F.col("k"), F.col("v"), 0.0)).collect()] == [(0.5, 0.0), (0.0, 0.0), (0.5, 0.0)]


def test_scores_survive_missing_probes(spark):
    facts = spark.createDataFrame([(1, 1), (1, 2)], "r int, f int")
    probes = spark.createDataFrame([(1, 1, "syn", "NO"), (1, 1, "ant", "NO")], "r int, f int, kind string, verdict string")
    scored = scoring.factoid_scores(facts, probes, ["r", "f"])
    assert {(x.f, x.score) for x in scored.collect()} == {(1, 0.5), (2, 0.0)}
    top = scoring.response_scores(spark.createDataFrame([(1,), (2,)], "r int"), scored, ["r"], ["score"])
    assert {(x.r, x.max_score) for x in top.collect()} == {(1, 0.5), (2, 0.0)}
