"""Providers, experiments and streams; no network."""

from pyspark.sql import functions as F

from factloom.operators.state import append_batch, finished
from factloom.plans.experiments import Cascade, Settings, cached_mutations, single_log, single_model, single_verifier, two_verifiers, with_mutations
from factloom.plans.queries import queries
from factloom.providers.base import ChatProvider, LexicalProvider, LocalServerProvider, ReplayProvider, Reply, Request, Retrying, ask, context_key, replay
from factloom.providers.steps import answer_factoids, decompose, inject, judge, passages, verify
from factloom.streaming.incremental import read_log, resume_into, windowed_rates

SF = "/root/testdata/sf0.001"
SAMPLE = "id int, question string, context string, knowledge string, right_answer string, hallucinated_answer string"


def samples(spark):
    return spark.createDataFrame([(1, "q", "The tower is red. It has ten rooms.", None, "The tower is red.", "The bridge is green. It has forty windows."), (2, "q", "", None, "", None)], SAMPLE)


def test_failures_are_results(spark):
    req = spark.createDataFrame([("verify", "s", "p", "x", "c"), ("verify", "s", "p", "x", "c"), ("verify", None, None, None, None)], "phase string, system string, prompt string, statement string, context string")
    for p in (ChatProvider("http://127.0.0.1:9/none", "m", timeout_s=1), LocalServerProvider("http://127.0.0.1:9/none", "m", timeout_s=1, on_failure="NOT SURE")):
        rows = ask(req, p, pool=2).collect()
        assert len(rows) == 3 and all(r.failed and r.text == p.on_failure for r in rows)


def test_bodies():
    from factloom.providers.base import Request

    r = Request("verify", "s", "p")
    assert ChatProvider("u", "m").body(r)["messages"][1]["content"] == "p"
    local = LocalServerProvider("u", "m", options={"top_p": 0.1}).body(r)
    assert local["options"] == {"temperature": 0.0, "num_predict": 100, "num_ctx": 8192, "top_p": 0.1} and local["stream"] is False
    assert ChatProvider("u", "m").parse({"choices": [{"message": {"content": " x "}}]}) == ("x", 0, 0)
    assert LocalServerProvider("u", "m").parse({"message": {"content": "y"}, "eval_count": 3}) == ("y", 0, 3)


def test_decompose_falls_back_to_the_answer(spark):
    r = spark.createDataFrame([(1, "bad"), (2, "good")], "k int, answer_text string")
    got = decompose(r, ReplayProvider({"bad": "no json", "good": '["a", "b"]'}), ["k"]).collect()
    assert sorted(tuple(x) for x in got) == [(1, 0, "bad"), (2, 0, "a"), (2, 1, "b")]


def test_verify_failure_is_not_sure_and_mutation_failure_is_empty(spark):
    probes = spark.createDataFrame([(1, "x", "c")], "k int, probe string, evidence string")
    assert verify(probes, ReplayProvider(), ["k"], "evidence").first().verdict == "NOT SURE"
    out = single_verifier(samples(spark), ReplayProvider(), ReplayProvider())
    assert {r.final_score for r in out.collect()} == {0.0}


def test_judge_and_inject(spark):
    s = spark.createDataFrame([(1, "a", "c"), (2, "", "c"), (3, "b", "c")], "k int, a string, c string")
    got = {r.k: r.supported for r in judge(s, ReplayProvider({"a": " True\n", "b": "perhaps"}), ["k"], "a", "c").collect()}
    assert got == {1: True, 2: False, 3: False}
    rows = inject(s, ReplayProvider({"a": "z"}), ["k"], "a").collect()
    assert all(1 <= len(r.strategies) <= 3 and len(set(r.strategies)) == len(r.strategies) for r in rows)


def test_replay_join(spark):
    r = spark.createDataFrame([(1,), (2,)], "k int")
    t = spark.createDataFrame([(1, "YES")], "k int, text string")
    assert {(x.k, x.text, x.failed) for x in replay(r, t, ["k"], "NOT SURE").collect()} == {(1, "YES", False), (2, "NOT SURE", True)}


def test_cascade(spark):
    p = LexicalProvider()
    c = Cascade(samples(spark), p, p, LexicalProvider(name="large"))
    rows = {(r.sample, r.answer_type): r for r in c.responses.collect()}
    assert len(rows) == 4 and rows[1, "right"].stage1_pred == 0 and rows[1, "hallucinated"].stage1_pred == 1
    assert rows[2, "right"].factoids_total == 0 and rows[2, "right"].cascade_final_score == 0.0
    r = c.rates().first()
    assert r.net_gain == r.rescued - r.hurt and c.confusion().count() == 1 and c.usage().count() >= 2
    off = Cascade(samples(spark), p, p, None)
    assert off.responses.agg(F.sum("factoid_escalation_count")).first()[0] == 0


def test_batch_and_resume(spark):
    f = "id int, factoid string, context string, factoid_type string, context_support boolean, mutations_list struct<synonyms: array<string>, antonyms: array<string>>"
    rec = spark.createDataFrame([(1, "The tower is red.", "The tower is red.", "t", True, None), (2, "The sea is deep.", "The tower is red.", "t", None, (["The sea is deep indeed."], []))], f)
    full = with_mutations(rec, LexicalProvider())
    lists = {r.id: r.mutations_list for r in full.collect()}
    assert len(lists[1].synonyms) == 2 and lists[2].synonyms == ["The sea is deep indeed."]
    one = {r.id: r for r in single_model(full, LexicalProvider(), "structure_aware", Settings(verdict_domain="tri")).collect()}
    assert one[1].correct and one[2].correct and not one[1].escalated
    done = spark.createDataFrame([(1,)], "id int")
    out = two_verifiers(full, LexicalProvider(name="s"), LexicalProvider(name="l"), done).collect()
    assert [r.id for r in out] == [2] and out[0].status in ("Missed Detection", "Valid Escalation")


def test_two_verifiers_cover_every_record(spark):
    records = spark.read.parquet(f"{SF}/example_dataset.parquet").where("factoid is not null")
    assert sorted(r.id for r in queries()["experiment_two_verifiers"](spark, SF).collect()) == sorted(r.id for r in records.collect())


def test_two_verifiers_resume_from_a_written_table(spark, tmp_path):
    f = "id int, factoid string, context string, factoid_type string, context_support boolean, mutations_list struct<synonyms: array<string>, antonyms: array<string>>"
    rec = spark.createDataFrame([(i, "The tower is red.", "The tower is red.", "t", True, None) for i in (10, 11, 20)], f)
    path, small, large = str(tmp_path / "done"), LexicalProvider(name="s"), LexicalProvider(name="l")
    assert {r.id for r in two_verifiers(rec, small, large, finished(spark, path, "id int")).collect()} == {10, 11, 20}
    append_batch(two_verifiers(rec.where("id < 20"), small, large), path)
    assert [r.id for r in two_verifiers(rec, small, large, finished(spark, path, "id int")).collect()] == [20]


def test_streams(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/response_log.parquet")
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    log.repartition(3).write.parquet(folder)
    for _ in range(2):
        q = resume_into(read_log(spark, folder, log.schema, 1), "log_id", target, str(tmp_path / f"c{_}"))
        q.awaitTermination(120)
    assert spark.read.parquet(target).count() == log.count()
    w = windowed_rates(read_log(spark, folder, log.schema), late="4000 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("w").agg(F.sum("responses")).first()[0] == log.count()


def test_every_phase_is_accounted_for(spark):
    p = LexicalProvider()
    c = Cascade(samples(spark), p, LexicalProvider(0.9, 0.5, "small"), LexicalProvider(name="large"))
    used = {(r["sample"], r.answer_type): r for r in c.usage().collect()}
    assert all(r.tokens_decompose > 0 for r in used.values()) and used[1, "right"].tokens_mutation > 0 and used[1, "right"].tokens_stage1_verify > 0
    log = {(r.id, r.answer_type): r for r in c.response_log().collect()}
    assert len(log) == 4 and len(c.response_log().columns) == 25 and len(c.factoid_log().columns) == 22
    for k, r in log.items():
        assert r.tokens_total == r.tokens_cloud_total + r.tokens_local_verify == used[k].tokens_total and r.tokens_api_decompose == used[k].tokens_decompose
    s = c.summary("large").first()
    assert s.sample_size == 2 and s.responses == 4 and s.tokens_total_avg == sum(r.tokens_total for r in log.values()) / 4 and s.net_gain == s.rescued - s.hurt
    facts = c.factoid_log().where("answer_type = 'hallucinated'").orderBy("id", "factoid_id").collect()
    assert [r.factoid_id for r in facts if r.id == 1] == [1, 2] and facts[0].stage1_syn_decisions.startswith('["')


def test_single_log_adds_the_calls(spark):
    rows = {r.id: r for r in single_log(samples(spark), LexicalProvider(), LexicalProvider()).collect()}
    one = rows[1]
    assert one.r_tokens == one.r_cloud_tokens + one.r_local_tokens + 1 + 2 + 4 and one.h_detected and not one.r_false_alarm
    assert rows[2].h_answer == "" and rows[2].h_score == 0.0 and rows[2].r_tokens == rows[2].r_cloud_tokens + 1


def test_replies_are_asked_for_again(spark):
    class Stubborn(ReplayProvider):
        """Says something else before it says what it should."""

        def open(self):
            said = iter(["hm", "well", "True", "late"] * 9)
            return lambda r: Reply(next(said), 1, 1)

    s = spark.createDataFrame([(1, "a", "c")], "k int, a string, c string")
    assert judge(s, Stubborn(), ["k"], "a", "c").first().supported and not judge(s, Stubborn(), ["k"], "a", "c", tries=2).first().supported
    reply = Retrying(Stubborn(), "true").open()(None)
    assert (reply.text, reply.prompt_tokens) == ("True", 3)


def test_think_and_options():
    body = LocalServerProvider("u", "m", think=False, num_ctx=None, options={"num_predict": 7}).body(Request("verify", "s", "p"))
    assert body["think"] is False and body["options"] == {"temperature": 0.0, "num_predict": 7} and "think" not in LocalServerProvider("u", "m").body(Request("verify", "s", "p"))


def test_mutations_are_cached_and_failures_are_not(spark, tmp_path):
    f = "id int, factoid string, mutations_list struct<synonyms: array<string>, antonyms: array<string>>"
    rec, path = spark.createDataFrame([(1, "a b.", None), (2, "c d.", None)], f), str(tmp_path / "cache")
    assert cached_mutations(rec, ReplayProvider(), path).count() == 2 and spark.read.parquet(path).count() == 0
    cached_mutations(rec.where("id = 1"), LexicalProvider(), path)
    again = {r.id: r.mutations_list for r in cached_mutations(rec, ReplayProvider(), path).collect()}
    assert len(again[1].synonyms) == 2 and not (again[2] and again[2].synonyms) and [r.id for r in spark.read.parquet(path).collect()] == [1]


def test_claims_of_both_answers(spark):
    s = spark.createDataFrame([(1, "A is. B is.", None), (2, "", "x")], "k int, right_answer string, hallucinated_answer string")
    got = answer_factoids(s, ReplayProvider({"A is. B is.": '["A is.", "  ", "B is."]', "x": '[""]'}), ["k"]).collect()
    assert sorted((r.k, r.answer_type, r.fact_idx, r.factoid) for r in got) == [(1, "right", 0, "A is."), (1, "right", 2, "B is.")]


def test_a_passage_joins_its_requests_at_the_call(spark):
    probes = spark.createDataFrame([(1, "x", "red"), (2, "y", "red"), (3, "x", None)], "k int, p string, c string")
    keyed = probes.select("k", "p", context_key(F.col("c")))
    apart = verify(keyed, LexicalProvider(), ["k"], "context_key", "p", contexts=passages(probes, "c")).collect()
    assert sorted(apart) == sorted(verify(probes, LexicalProvider(), ["k"], "c", "p").collect()) and len(apart) == 3
