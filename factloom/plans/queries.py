"""Queries over the test tables for the core operators. Whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import parsing, text
from factloom.operators import batch_policies, components, dataset, escalation, evaluation, reports, responses, scoring, state
from factloom.plans import sql
from factloom.plans.experiments import Cascade, single_log, single_model, single_verifier, two_verifiers, with_mutations
from factloom.providers.base import LexicalProvider, replay
from factloom.providers.steps import answer_factoids, inject, judge
from factloom.session import scratch_name
from factloom.sources import records


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- samples and responses -------------------------------------------------------------------------------------


def answer_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = responses.with_evidence(_table(spark, sf_dir, "example_asqa"))
    return responses.unpivot_answers(s, ["row_id", "evidence"])


def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce("context", F.lit(""))
    return _table(spark, sf_dir, "example_asqa").select("row_id", text.snippet(c, 50).alias("snippet_50"), text.snippet(c, 80).alias("snippet_80"))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.seeded_sample(_table(spark, sf_dir, "example_asqa"), "row_id", 100).select("row_id", "question")


def response_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ["stage1_pred", "cascade_pred", "stage1_correct", "cascade_correct", "response_escalated", "response_rescued", "response_hurt", "escalated_wrong"]
    return responses.response_flags(_table(spark, sf_dir, "response_log")).select("log_id", *flags)


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "response_log")
    cloud = F.col("tokens_api_decompose") + F.col("tokens_api_mutation") + F.col("tokens_api_stage2_verify")
    totals = responses.token_totals(cloud, F.lit(0), F.col("tokens_local_verify"), F.lit(0))
    legacy = responses.tokens_legacy(totals["tokens_total"], 1 + 2 * F.col("factoids_total"), 4 * F.col("factoids_total"))
    return log.select("log_id", totals["tokens_cloud_total"].alias("cloud"), totals["tokens_total"].alias("total"), legacy.alias("legacy"))


# --- verdicts and scores ---------------------------------------------------------------------------------------


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "example_asqa").select("row_id", F.coalesce("right_answer", F.lit("")).alias("a"), (F.col("row_id") % 6).alias("k"), "right_answer")


def _raw(k: Column, a: Column, null: Column) -> Column:
    return F.when(k == 0, F.concat(F.lit("Yes, "), a)).when(k == 1, F.concat(F.lit("no. "), a)).when(k == 2, F.concat(F.lit("NO. I am not sure: "), a)).when(k == 3, F.lit("NOTSURE")).when(k == 4, F.lit("YESNO")).otherwise(null)


def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 60).alias("preview"))


def probe_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of different length, zipped as far as both go."""
    zipped = responses.probe_pairs(F.col("syn1"), F.slice(F.col("ant1"), F.lit(1), F.lit(1)))
    return _lists(spark, sf_dir).select("fact_log_id", F.array_join(F.transform(zipped, lambda x: F.concat(x["text"], F.lit("="), x["output"])), ",").alias("pairs"))


def map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples with nested documents and annotations, made from the flat table."""
    docs = F.when(F.col("context").isNotNull(), F.transform(F.split("context", "\n\n"), lambda x: F.struct(x.alias("text"))))
    raw = _table(spark, sf_dir, "example_asqa").select(F.col("row_id").alias("question_id"), "question", docs.alias("docs"), F.array(F.struct(F.col("right_answer").alias("long_answer"))).alias("annotations"))
    return dataset.map_fields(raw)


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(F.col("k"), F.col("a"), F.col("right_answer"))
    return _replies(spark, sf_dir).select("row_id", parsing.verdict(raw).alias("verdict"))


def verdict_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(F.col("k"), F.col("a"), F.col("right_answer"))
    return _replies(spark, sf_dir).select("row_id", parsing.batch_verdict(raw).alias("legacy2"), parsing.batch_verdict(raw, "tri").alias("tri"), parsing.starts_yes(raw).alias("oracle_label"))


def mutation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies stood for by passages, whose lines are the mutations."""
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(parsing.mutations(F.regexp_replace("text", "\r", ""), 2), "|").alias("mutations"))


def factoid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "factoid_log")
    raw = F.when(F.col("fact_log_id") % 4 == 0, F.concat(F.lit("```json\n"), F.col("stage1_syn_decisions"), F.lit("\n```"))).when(F.col("fact_log_id") % 4 == 1, F.concat("stage1_syn_decisions", F.lit(" and so on"))).when(F.col("fact_log_id") % 4 == 2, F.lit('{"a": 1}')).otherwise(F.lit("[]"))
    return log.select("fact_log_id", F.posexplode_outer(parsing.factoids(raw, F.col("factoid_text"))).alias("fact_idx", "factoid"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "factoid_log")
    return log.withColumns({n: parsing.decisions(F.col(c)) for n, c in (("syn1", "stage1_syn_decisions"), ("ant1", "stage1_ant_decisions"), ("syn2", "final_syn_decisions"), ("ant2", "final_ant_decisions"))})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).withColumns({"score1": scoring.list_score(F.col("syn1"), F.col("ant1")), "score2": scoring.list_score(F.col("syn2"), F.col("ant2"))})


def factoid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("fact_log_id", F.round("score1", 4).alias("score1"), F.round("score2", 4).alias("score2"), scoring.flagged(F.col("score1")).alias("flagged1"))


def factoid_score_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stage-1 scores from the long probe table, factoids without probes included."""
    l = _lists(spark, sf_dir)

    def tagged(kind: str, c: str) -> Column:
        return F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("verdict")))

    probe = F.concat(tagged("syn", "syn1"), tagged("ant", "ant1"))
    probes = l.select("fact_log_id", F.inline(probe))
    return scoring.factoid_scores(l.select("fact_log_id"), probes, ["fact_log_id"]).select("fact_log_id", F.round("score", 4).alias("score"))


def response_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _table(spark, sf_dir, "response_log").select("log_id")
    out = scoring.response_scores(logs, _scored(spark, sf_dir), ["log_id"], ["score1", "score2"])
    return out.select("log_id", F.round("max_score1", 4).alias("stage1_final_score"), F.round("max_score2", 4).alias("cascade_final_score"))


# --- escalation ------------------------------------------------------------------------------------------------


def _escalate(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    out = escalation.escalation(_lists(spark, sf_dir).select("fact_log_id", "syn1", "ant1"), "syn1", "ant1", policy)
    return out.select("fact_log_id", "escalated", F.array_join("reasons", " | ").alias("reasons"), "syn_anomaly_count", "ant_anomaly_count", "syn_anomaly_ratio", "ant_anomaly_ratio", "logical_paradox", "both_yes", "both_no")


def escalate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _escalate(spark, sf_dir, "strict")


def escalate_paradox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _escalate(spark, sf_dir, "paradox_only")


def escalate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _escalate(spark, sf_dir, "structure_aware")


def escalate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = escalation.escalation(_lists(spark, sf_dir).select("fact_log_id", "factoid_text", "syn1", "ant1"), "syn1", "ant1", "strict", fact="factoid_text")
    return out.select("fact_log_id", "escalated", F.array_join("reasons", " | ").alias("reasons"), "risk_prior")


def cascade_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lists(spark, sf_dir)
    stage1 = l.select("fact_log_id", F.col("syn1").alias("syn"), F.col("ant1").alias("ant"))
    stage2 = l.where("escalated = 1").select("fact_log_id", F.col("syn2").alias("syn"), F.col("ant2").alias("ant"))
    return escalation.merge_stages(stage1, stage2, ["fact_log_id"]).select("fact_log_id", F.array_join("final_syn", ",").alias("final_syn"), F.array_join("final_ant", ",").alias("final_ant"))


def reason_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "factoid_log").withColumn("r", F.when(F.col("trigger_reasons").isNotNull(), F.array("trigger_reasons")))
    return responses.joined_reasons(log, ["log_id"], "factoid_id", "r").select("log_id", text.joined(F.col("reasons")).alias("reasons"))


def factoid_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = responses.nested_log(_table(spark, sf_dir, "factoid_log"), ["log_id"], "factoid_id", ["factoid_text"])
    return nested.select("log_id", F.array_join(F.transform("factoids", lambda f: f["factoid_text"]), " / ").alias("factoids"))


# --- evaluation ------------------------------------------------------------------------------------------------


def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.confusion_report(_table(spark, sf_dir, "response_log"), ["model"], {"stage1": "stage1_pred", "cascade": "cascade_pred"}, "gold_label")
    return out.select("model", *[F.col(c) if c.split("_")[1] in ("tp", "fp", "tn", "fn") else F.round(c, 6).alias(c) for c in out.columns if c != "model"])


def paired_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of one sample side by side, by conditional aggregation."""
    log = _table(spark, sf_dir, "response_log").where("id is not null")
    pick = lambda kind: F.max(F.when(F.col("answer_type") == kind, F.col("stage1_pred"))) == 1
    pairs = log.groupBy("model", "id").agg(pick("hallucinated").alias("h"), pick("right").alias("r"))
    out = evaluation.paired_confusion(pairs, ["model"], F.col("h"), F.col("r"))
    return out.select("model", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def cascade_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.cascade_rates(_table(spark, sf_dir, "response_log"), ["model"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cost_summary(_table(spark, sf_dir, "response_log"), ["model"])


def usage_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "response_log")
    phase = {"decompose": "tokens_api_decompose", "mutation": "tokens_api_mutation", "stage1_verify": "tokens_local_verify", "stage2_verify": "tokens_api_stage2_verify"}
    calls = log.select("model", F.inline(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(c).alias("prompt_tokens"), F.lit(0).cast("bigint").alias("completion_tokens"), (F.col("latency_s") / 4).alias("latency_s")) for p, c in phase.items()])))
    return evaluation.usage_by_phase(calls, ["model"])


# --- batch diagnosis -------------------------------------------------------------------------------------------


def _fixture(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Verdicts from the digits of event_id in base 3: a synthetic fixture, not measured output of a model."""
    e = F.col("event_id") + shift
    names = F.array(F.lit("YES"), F.lit("NO"), F.lit("NOT SURE"))

    def slot(k: int) -> Column:
        return F.element_at(names, F.pmod(F.floor(e / 3**k), F.lit(3)).cast("int") + 1)

    lengths = F.pmod(F.floor(e / 486), F.lit(9)).cast("int")
    truth = F.when(F.col("event_id") % 11 != 0, F.pmod(F.floor(F.col("event_id") / 243), F.lit(2)) == 1)
    syn, ant = F.slice(F.array(slot(1), slot(2)), F.lit(1), F.floor(lengths / 3).cast("int")), F.slice(F.array(slot(3), slot(4)), F.lit(1), lengths % 3)
    return _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("category"), slot(0).alias("orig"), syn.alias("syn"), ant.alias("ant"), truth.alias("truth"))


def _batch(spark: SparkSession, sf_dir: str, policy: str, shift: int = 0) -> DataFrame:
    return batch_policies.apply_policy(_fixture(spark, sf_dir, shift), policy).withColumn("correct", batch_policies.original_correct(F.col("truth"), F.col("orig"), "false"))


def batch_paradox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "paradox_only").select("event_id", "escalated", "trigger", "failure")


def batch_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "strict").select("event_id", "escalated", "trigger", "failure")


def batch_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "structure_aware").select("event_id", "escalated", "trigger", "failure")


def original_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fixture(spark, sf_dir)
    t, o = F.col("truth"), F.col("orig")
    return f.select("event_id", batch_policies.original_correct(t, o).alias("null_incorrect"), batch_policies.original_correct(t, o, "false").alias("null_false"))


def escalation_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.escalation_rate(_batch(spark, sf_dir, "paradox_only"), "category")


def failure_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.crosstab(_batch(spark, sf_dir, "structure_aware"), "category", "failure")


def trigger_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.crosstab(_batch(spark, sf_dir, "structure_aware"), "category", "trigger")


def status_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(_batch(spark, sf_dir, "structure_aware"), "category")


def trigger_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trigger_hits(_batch(spark, sf_dir, "structure_aware"), "category")


def strict_trigger_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trigger_hits(_batch(spark, sf_dir, "strict"), "category", reports.STRICT_HITS)


def aligned_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _batch(spark, sf_dir, "structure_aware")
    return reports.aligned([reports.escalation_rate(b.where("escalated"), "category").select("category", F.col("n").alias("escalations")), reports.status_counts(b, "category").select("category", "n", "success_pass")], "category")


def aligned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three statistics over all rows side by side; one of them lacks categories."""
    b = _batch(spark, sf_dir, "structure_aware")
    quiet = b.where("not escalated").groupBy("category").agg(F.count("*").alias("quiet")).where("category like '%c%'")
    return reports.aligned([reports.escalation_rate(b.where("escalated"), "category").select("category", F.col("n").alias("escalations")), reports.status_counts(b, "category"), quiet], "category").where("category is not null")


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_report(_batch(spark, sf_dir, "structure_aware"), "category")


def crosstab_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["original uncertainty", "logical paradox", "threshold anomaly", "logical paradox + threshold anomaly"]
    wide = reports.crosstab_wide(_batch(spark, sf_dir, "structure_aware"), "category", "trigger", names)
    return wide.select("category", *[F.col(n).alias(f"n{i}") for i, n in enumerate(names)])


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = records.markdown(reports.status_counts(_batch(spark, sf_dir, "structure_aware"), "category").orderBy("category")).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def _verifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small verifier and a large one, whose digits are shifted by one."""
    both = [_batch(spark, sf_dir, "structure_aware", shift).withColumn("verifier", F.lit(name)) for name, shift in (("small", 0), ("large", 1))]
    return both[0].unionByName(both[1])


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verifiers(spark, sf_dir).withColumn("correct", batch_policies.original_correct(F.col("truth"), F.col("orig")))
    pairs = reports.side_by_side(v, "event_id", "verifier", ["escalated", "correct", "category"], ("small", "large"))
    return pairs.select("event_id", F.col("small_category").alias("category"), F.col("small_escalated").alias("escalated"), F.col("small_correct").alias("small_ok"), F.col("large_correct").alias("large_ok"))


def verifier_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rescued, harmed = reports.recovered(F.col("escalated"), F.col("small_ok"), F.col("large_ok"))
    return _paired(spark, sf_dir).select("event_id", batch_policies.status(F.col("escalated"), F.col("small_ok")).alias("status"), rescued.alias("rescued"), harmed.alias("harmed"))


def comparative_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.comparative_summary(_paired(spark, sf_dir), "category").orderBy("category")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def per_verifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.verifier_report(_verifiers(spark, sf_dir), "category")


def percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = reports.escalation_rate(_batch(spark, sf_dir, "paradox_only"), "category")
    return rates.select("category", text.percent(F.round("escalation_rate", 4)).alias("escalation"))


# --- state -----------------------------------------------------------------------------------------------------


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.remaining(_table(spark, sf_dir, "response_log").select("log_id", "model"), _table(spark, sf_dir, "factoid_log").select("log_id"), "log_id")


def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "response_log")
    old = log.groupBy("model").agg(F.count("*").alias("n"))
    new = log.where("model = 'verifier-mid' and stage1_correct = 1").groupBy("model").agg(F.count("*").alias("n"))
    return state.upsert(old, new, "model")


def mutation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "example_dataset").select("id", "factoid")
    cache = state.cacheable(_table(spark, sf_dir, "example_dataset").select("id", "mutations_list"))
    out = state.cached_or_base(base, cache, "id", "mutations_list")
    return out.select("id", F.coalesce(F.size("mutations_list.synonyms"), F.lit(0)).alias("synonyms"), F.coalesce(F.size("mutations_list.antonyms"), F.lit(0)).alias("antonyms"))


def replayed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored replies instead of calls: a factoid's decisions stand for the replies to its text."""
    log = _table(spark, sf_dir, "factoid_log")
    stored = log.where("escalated = 1").select("fact_log_id", F.try_element_at(parsing.decisions(F.col("final_syn_decisions")), F.lit(1)).alias("text"))
    return replay(log.select("fact_log_id"), stored.where("text is not null"), ["fact_log_id"]).select("fact_log_id", parsing.verdict(F.col("text")).alias("verdict"), "failed")


# --- sources and sinks: written to the shared folder and read again -----------------------------------------------


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = scratch_name(spark, "json"), "row_id long, question string, context string, right_answer string"
    _table(spark, sf_dir, "example_asqa").select("row_id", "question", "context", "right_answer").write.json(path)
    return records.load_json(spark, path, schema)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, log = scratch_name(spark, "csv"), _table(spark, sf_dir, "response_log").select("log_id", "question", "answer_type", "gold_label", "stage1_final_score", "latency_s", "tokens_total", "escalation_reasons")
    records.write_csv(log, path)
    return records.read_csv(spark, path, log.schema)


def details_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, nested = scratch_name(spark, "details"), responses.nested_log(_table(spark, sf_dir, "factoid_log"), ["log_id"], "factoid_id", ["factoid_text", "escalated"])
    records.write_details(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select("log_id", F.inline("factoids"))


# --- dataset construction --------------------------------------------------------------------------------------


def lexical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.lexical_coverage(_table(spark, sf_dir, "example_asqa"), "right_answer", "context")
    return out.select("row_id", "answer_words", "covered_words", F.round("coverage", 6).alias("coverage"))


def grounding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.grounding_filter(_table(spark, sf_dir, "example_asqa"), "right_answer", "context").select("row_id")


def statement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.statement_coverage(_table(spark, sf_dir, "eval_item"), "item_id", "question", _table(spark, sf_dir, "documents"), "doc_id", "text", 0.6)
    return out.withColumn("coverage", F.round("coverage", 6))


def dual_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "example_asqa")
    both = dataset.lexical_coverage(dataset.lexical_coverage(df, "right_answer", "context").withColumnsRenamed({"coverage": "r", "answer_words": "rw", "covered_words": "rc"}), "hallucinated_answer", "context")
    return dataset.dual_validation(both, F.col("r") > 0.4, F.col("coverage") < 1.0).select("row_id")


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "example_dataset").select("id", dataset.fact_type(F.col("factoid")).alias("fact_type"))


def merge_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "example_dataset").select(F.col("id").alias("record"), "factoid", "context")
    b = _table(spark, sf_dir, "factoid_log").select(F.col("fact_log_id").alias("record"), F.col("factoid_text").alias("factoid"))
    pools = dataset.merge_pools([a.withColumn("pool", F.lit("dataset")), b.withColumn("pool", F.lit("log"))], ["factoid"])
    return pools.groupBy("pool").agg(F.count("*").alias("n"), F.count("context").alias("with_context"))


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "example_dataset").where("context_support is not null").withColumn("fact_type", dataset.fact_type(F.col("factoid"))).where("fact_type is not null")
    picked = dataset.balanced_sample(df.select("id", "fact_type", "context_support"), "id", ["fact_type", "context_support"], 50)
    return dataset.renumbered(picked, ["fact_type", "context_support", "rank"])


def source_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample rows of equal id: the groups that must not be split. Log and dataset rows name one id each and tie no others."""
    a = _table(spark, sf_dir, "example_asqa").where("id is not null").groupBy("id").agg(F.min("row_id").alias("first"))
    edges = _table(spark, sf_dir, "example_asqa").join(a, "id").select("row_id", "first")
    return components.connected_components(edges, "row_id", "first")


# --- experiments through the stand-in provider -------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "example_dataset").where("factoid is not null")


def experiment_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = LexicalProvider()
    return single_verifier(_table(spark, sf_dir, "example_asqa"), p, p, "row_id").withColumn("final_score", F.round("final_score", 6))


def experiment_single_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = LexicalProvider()
    return single_log(_table(spark, sf_dir, "example_asqa"), p, p, "row_id").withColumns({c: F.round(c, 6) for c in ("h_score", "r_score")})


def _cascade(spark: SparkSession, sf_dir: str) -> Cascade:
    return Cascade(_table(spark, sf_dir, "example_asqa"), LexicalProvider(), LexicalProvider(0.9, 0.5, "small"), LexicalProvider(0.75, 0.4, "large"), "row_id")


def experiment_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = {c: F.round(c, 6) for c in ("stage1_final_score", "cascade_final_score")}
    return _cascade(spark, sf_dir).responses.select("sample", "answer_type", "stage1_final_score", "cascade_final_score", "factoids_total", "factoid_escalation_count", "escalation_reasons").withColumns(scores)


def experiment_response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).response_log()


def experiment_factoid_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).factoid_log()


def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cascade(spark, sf_dir).summary("large")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def experiment_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_mutations(_records(spark, sf_dir), LexicalProvider())
    return single_model(r, LexicalProvider(), "structure_aware").select("id", "factoid_type", "escalated", "trigger", "failure", "correct")


def experiment_two_verifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = two_verifiers(_records(spark, sf_dir), LexicalProvider(0.9, 0.5, "small"), LexicalProvider(0.75, 0.4, "large"))
    return out.select("id", "factoid_type", "status", "rescued", "harmed")


def judge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "example_asqa"), LexicalProvider(), ["row_id"], "right_answer", "context")


def inject_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inject(_table(spark, sf_dir, "example_asqa").where("right_answer <> ''"), LexicalProvider(), ["row_id"], "right_answer")
    return out.select("row_id", F.array_join("strategies", ", ").alias("strategies"), "hallucinated_answer")


def factoid_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_factoids(_table(spark, sf_dir, "example_asqa"), LexicalProvider(), ["row_id"]).select("row_id", "answer_type", "fact_idx", "factoid")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (
        answer_unpivot, context_snippet, seeded_sample, response_flags, token_totals, verdict_parse, verdict_legacy, mutation_parse, factoid_parse, factoid_score, factoid_score_long, response_score,
        escalate_strict, escalate_paradox, escalate_structure, cascade_merge, reason_concat, factoid_nesting, confusion_prf, paired_confusion, cascade_rates, cost_summary, usage_by_phase,
        batch_paradox, batch_strict, batch_structure, original_correct, escalation_by_category, failure_crosstab, trigger_crosstab, status_by_category, trigger_hits, strict_trigger_hits, aligned_stats,
        verifier_compare, comparative_summary, per_verifier_report, percent_format, resume_antijoin, summary_upsert, mutation_cache, replayed_verdicts,
        lexical_coverage, grounding_filter, statement_coverage, dual_validation, taxonomy, merge_pools, balanced_sample, source_components,
        experiment_single, experiment_single_log, experiment_cascade, experiment_response_log, experiment_factoid_log, experiment_summary, experiment_batch, experiment_two_verifiers,
        judge_support, inject_strategies, factoid_extraction, preview_text, probe_zip, map_fields, escalate_risk, aligned_totals, category_report, crosstab_wide, markdown_report,
        json_roundtrip, csv_roundtrip, details_roundtrip,
    )
    return {f.__name__: f for f in all_of}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
