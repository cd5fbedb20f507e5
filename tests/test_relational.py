import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import dataset, evaluation, reports, responses, state
from factloom.operators.components import connected_components
from factloom.operators.escalation import escalation
from factloom.plans.queries import queries
from factloom.session import shared_dir
from factloom.sources.records import QA_SAMPLE, Registry, broken_records, load_json, load_sample, markdown, positions, write_csv


def test_components_against_union_find(spark):
    import random

    random.seed(1)
    pairs = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a, b, "noise") for a, b in pairs] + [(None, 1, "x")], "src long, dst long, node string").repartition(8)
    got = {r.node: r.component for r in connected_components(df).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert connected_components(df.where("false")).count() == 0


def test_unpivot_and_flags(spark):
    s = spark.createDataFrame([(1, None, "c", "k", "r", None)], "id int, question string, context string, knowledge string, right_answer string, hallucinated_answer string")
    rows = responses.unpivot_answers(responses.with_evidence(s), ["id", "evidence"]).collect()
    assert [(r.answer_type, r.gold_label, r.answer_text, r.evidence) for r in rows] == [("hallucinated", True, "", "k"), ("right", False, "r", "k")]
    log = spark.createDataFrame([(0.5, 0.2, False, 1), (0.2, 0.5, False, 1), (0.7, 0.1, True, 0)], "stage1_final_score double, cascade_final_score double, gold_label boolean, factoid_escalation_count int")
    got = [(r.stage1_pred, r.cascade_correct, r.response_rescued, r.response_hurt, r.escalated_wrong) for r in responses.response_flags(log).collect()]
    assert got == [(1, 1, 1, 0, 1), (0, 0, 0, 1, 0), (1, 0, 0, 0, 0)]


def test_rates_hold_their_invariants(spark):
    log = spark.read.parquet("/root/testdata/sf0.001/response_log.parquet")
    r = evaluation.cascade_rates(log, []).first()
    c = evaluation.confusion_report(log, [], {"s": "stage1_pred"}, "gold_label").first()
    assert r.net_gain == r.rescued - r.hurt and c.s_tp + c.s_fp + c.s_tn + c.s_fn == r.responses
    assert evaluation.cascade_rates(log.where("false"), ["model"]).count() == 0
    empty = evaluation.confusion_report(log.where("false"), [], {"s": "stage1_pred"}, "gold_label").first()
    assert empty.s_precision == 0.0 and empty.s_accuracy == 0.0


def test_reports_leave_null_categories_out(spark):
    df = spark.createDataFrame([("a", True, True, "x + y", "F"), ("a", False, False, "None", "None"), (None, True, False, "x", "F")], "category string, escalated boolean, correct boolean, trigger string, failure string")
    assert reports.crosstab(df, "category", "failure").collect() == [("a", "F", 1)]
    assert reports.crosstab_wide(df, "category", "failure").collect() == [("a", 1)]
    s = reports.status_counts(df, "category").first()
    assert (s.n, s.over_escalation, s.missed_detection) == (2, 1, 1)
    wide = reports.verifier_report(df.withColumn("verifier", F.lit("v")), "category").first()
    assert wide.hit_combined == 1 and wide.n == 2
    assert "| a | 1 |" in markdown(reports.crosstab_wide(df, "category", "failure"))


def test_aligned_counts_every_row_of_every_category(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1)], "category string, escalations long")
    b = spark.createDataFrame([("y", 5), ("z", 3)], "category string, n long")
    assert {tuple(r) for r in reports.aligned([a, b], "category").collect()} == {("x", 2, 0), ("y", 1, 5), ("z", 0, 3)}
    sf = "/root/testdata/sf0.001"
    stats = {r.category: r for r in queries()["aligned_stats"](spark, sf).collect()}
    assert {k: (r.n, r.success_pass) for k, r in stats.items()} == {r.category: (r.n, r.success_pass) for r in queries()["status_by_category"](spark, sf).collect()}
    assert all(r.escalations <= r.n for r in stats.values())


def test_state(spark, tmp_path):
    todo = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    done = spark.createDataFrame([(1,), (1,)], "k int")
    assert {r.v for r in state.remaining(todo, done, "k").collect()} == {"b", "c"}
    new = spark.createDataFrame([(2, "z")], "k int, v string")
    assert {tuple(r) for r in state.upsert(todo, new, "k").collect()} == {(1, "a"), (None, "c"), (2, "z")}
    path = str(tmp_path / "t")
    assert state.finished(spark, path, "k int").count() == 0
    state.replace_table(todo, path)
    state.replace_table(new, path)
    assert spark.read.parquet(path).count() == 1
    state.append_batch(new, path)
    assert state.finished(spark, path, "k int, v string").count() == 2
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "x.parquet").write_text("no parquet")
    assert state.finished(spark, str(broken), "k int").count() == 0


def test_cache_does_not_keep_failures(spark):
    m = "mutations_list struct<synonyms: array<string>, antonyms: array<string>>"
    df = spark.createDataFrame([(1, (["a"], [])), (2, ([], [])), (3, None), (4, (None, ["b"]))], f"id int, {m}")
    assert {r.id for r in state.cacheable(df).collect()} == {1, 4}
    base = spark.createDataFrame([(1, None), (2, (["own"], []))], f"id int, {m}")
    got = {r.id: r.mutations_list for r in state.cached_or_base(base, df.where("id = 1"), "id", "mutations_list").collect()}
    assert got[1].synonyms == ["a"] and got[2].synonyms == ["own"]


def test_json_sources(spark, tmp_path):
    rows = [{"id": 7, "question": "q", "right_answer": 'r "x", y'}, {"question": None, "context": "c"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)) + "\n\n{broken\n")
    (tmp_path / "e.json").write_text("[]")
    for name in ("a.json", "l.json"):
        got = load_json(spark, str(tmp_path / name)).orderBy("id").collect()
        assert [(r.id, r.question, r.context) for r in got] == [(2, None, "c"), (7, "q", None)]
    assert load_json(spark, str(tmp_path / "e.json")).count() == 0
    with pytest.raises(Exception):
        load_json(spark, str(tmp_path / "none.json"))
    assert load_sample(spark, str(tmp_path / "a.json"), QA_SAMPLE, 1).count() == 1
    reg = Registry({"x": str(tmp_path / "a.json")})
    reg.register(spark)
    assert spark.sql("select count(*) n from x").first().n == 2
    with pytest.raises(KeyError):
        reg.load(spark, "y")
    out = str(tmp_path / "csv")
    write_csv(load_json(spark, str(tmp_path / "a.json")), out)
    assert spark.read.option("header", True).option("escape", '"').csv(out).where("right_answer is not null").first().right_answer == 'r "x", y'


def test_broken_records_are_counted(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"id": 1}\n{broken\n\n{"id": "x"}\n{"id": 2}\n')
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id"')
    assert {r.record for r in broken_records(spark, str(tmp_path / "l.json")).collect()} >= {"{broken"} and broken_records(spark, str(tmp_path / "a.json")).count() == 1
    with pytest.warns(UserWarning, match="broken records"):
        assert {r.id for r in load_json(spark, str(tmp_path / "l.json"), number_ids=False).collect()} == {1, 2}
    with pytest.raises(ValueError):
        load_json(spark, str(tmp_path / "a.json"), broken="raise")
    assert load_json(spark, str(tmp_path / "a.json"), broken="ignore").count() == 0


def test_a_table_that_cannot_be_read_is_no_fresh_start_where_asked(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        state.finished(spark, str(tmp_path), "k int", unreadable="raise")
    assert state.finished(spark, str(tmp_path / "none"), "k int", unreadable="raise").count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_statement_coverage_against_all_pairs(spark):
    """Common and rare words, repeated statements, shares at the threshold."""
    import random

    r = random.Random(2)
    names = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    text = lambda n: " ".join(r.choice(names[: r.choice([4, 40])]) for _ in range(n))
    statements, documents = [(i, text(r.randint(0, 9))) for i in range(40)] + [(90, None)], [(i, text(r.randint(0, 25))) for i in range(80)] + [(99, None)]
    s, d = spark.createDataFrame(statements, "sid int, t string"), spark.createDataFrame(documents, "did int, t string")
    for least in (0.0, 0.4, 0.5, 0.6, 0.8):
        want = {(i, j, len(a & b)) for i, x in statements for j, y in documents for a, b in [(set((x or "").split()), set((y or "").split()))] if a and len(a & b) / len(a) > least}
        assert {tuple(x)[:3] for x in dataset.statement_coverage(s, "sid", "t", d, "did", "t", least).collect()} == want


def test_risk_prior(spark):
    df = spark.createDataFrame([("It has 3 rooms.", ["NO"]), ("It is not red.", ["YES"]), ("All came.", ["NO"]), ("It is red.", ["NO"]), (None, ["NO"])], "f string, syn array<string>").withColumn("ant", F.array().cast("array<string>"))
    got = {p: [(r.risk_prior, r.reasons[-1:] == [r.risk_prior]) for r in escalation(df, "syn", "ant", p, fact="f").collect()] for p in ("strict", "paradox_only", "structure_aware")}
    names = ["RiskPrior: Numerical/Temporal", "RiskPrior: Negation", "RiskPrior: Scope/Comparison", "", ""]
    assert [x[0] for x in got["strict"]] == names
    assert [x[1] for x in got["strict"]] == [True, True, True, False, False] and [x[1] for x in got["structure_aware"]] == [True, False, True, False, False] and not any(x[1] for x in got["paradox_only"])
    assert {r.risk_prior for r in escalation(df, "syn", "ant").collect()} == {""}


def test_positions(spark):
    got = [r.position for r in positions(spark.range(100, numPartitions=7)).orderBy("id").collect()]
    assert got == list(range(1, 101))
    assert positions(spark.range(0)).count() == 0


@pytest.mark.parametrize("fact, want", [("Not more than one before 1990.", 2), ("It is higher than all others.", 5), ("Only one was acquired.", 3), ("It was founded by A in 1900.", 7), ("It opened in 1900.", 4), ("It has 12 rooms.", 6), ("It is red.", 1), ("", 1)])
def test_taxonomy(spark, fact, want):
    assert spark.createDataFrame([(fact,)], "f string").select(dataset.fact_type(F.col("f"))).first()[0].startswith(f"Cat {want}:")


def test_coverage_edges(spark):
    df = spark.createDataFrame([("12 34", "x"), ("red blue green pink cyan", "red blue"), ("red blue green", "red blue"), ("red red red", "blue"), (None, None)], "a string, c string")
    got = [r.coverage for r in dataset.lexical_coverage(df, "a", "c").collect()]
    assert got == [None, 0.4, pytest.approx(2 / 3), 0.0, None]
    assert dataset.grounding_filter(df, "a", "c").count() == 3


def test_pools_and_balanced_sample(spark):
    a = spark.createDataFrame([(1, "f", "c")], "id int, factoid string, context string")
    b = spark.createDataFrame([(2, "g"), (3, None)], "id int, factoid string")
    assert {r.id for r in dataset.merge_pools([a, b], ["id", "factoid"]).collect()} == {1, 2}
    df = spark.range(100).select("id", (F.col("id") % 10 == 0).alias("s"), F.lit("t").alias("t"))
    got = dataset.renumbered(dataset.balanced_sample(df, "id", ["t", "s"], 20), ["t", "s", "rank"]).collect()
    assert len(got) == 30 and sorted(r.new_id for r in got) == list(range(1, 31))


def test_field_mapping(spark):
    df = spark.createDataFrame([(5, "q", [("a",), ("b",), ("c",), ("d",)], [("long",)]), (6, None, [], [])], "question_id int, question string, docs array<struct<text: string>>, annotations array<struct<long_answer: string>>")
    rows = dataset.map_fields(df).collect()
    assert (rows[0].id, rows[0].context, rows[0].right_answer) == ("5", "a\n\nb\n\nc", "long")
    assert (rows[1].question, rows[1].context, rows[1].right_answer) == ("", "", "")
    assert [r.id for r in dataset.map_fields(df.drop("question_id")).collect()] == ["1", "2"]


def test_statement_coverage(spark):
    s = spark.createDataFrame([(1, "red green blue pink")], "sid int, t string")
    d = spark.createDataFrame([(1, "red green blue"), (2, "red"), (3, None)], "did int, t string")
    assert [tuple(r) for r in dataset.statement_coverage(s, "sid", "t", d, "did", "t").collect()] == [(1, 1, 3, 0.75)]
