"""The experiments from samples to reports. Model calls are written before they are read; the rest is one plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.parsing import batch_verdict, decisions_text
from factloom.functions.text import snippet
from factloom.operators import batch_policies, evaluation, reports
from factloom.operators.escalation import escalation, merge_stages
from factloom.operators.responses import joined_reasons, response_flags, rounded_log, tokens_legacy, unpivot_answers, with_evidence
from factloom.operators.scoring import factoid_scores, flagged, list_score, response_scores
from factloom.operators.state import cacheable, cached_or_base, exists, remaining, replace_table
from factloom.providers.base import Provider, context_key
from factloom.providers.steps import USAGE, decompose_calls, mutate, mutate_calls, passages, verify
from factloom.session import cut


@dataclass(frozen=True)
class Settings:
    """Defaults of all experiments."""

    threshold: float = 0.5
    mutations: int = 2
    policy: str = "structure_aware"
    least_anomalies: int = 2
    anomaly_ratio: float = 0.4
    verdict_domain: str = "legacy2"
    null_truth: str = "incorrect"
    risk_prior: bool = False


def _responses(samples: DataFrame, key: str, prefer_knowledge: bool) -> DataFrame:
    s = samples.select(F.col(key).alias("sample"), "question", "context", "right_answer", "hallucinated_answer", *(["knowledge"] if "knowledge" in samples.columns else []))
    s = with_evidence(s) if prefer_knowledge and "knowledge" in s.columns else s.withColumn("evidence", F.coalesce("context", F.lit("")))
    return unpivot_answers(s, ["sample", "question", "evidence"])


def _lists(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict lists of each factoid in order; a factoid has at most a few probes."""
    def of(kind: str) -> Column:
        picked = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "verdict"))))
        return F.transform(picked, lambda x: x["verdict"])

    return probes.groupBy(*keys).agg(of("syn").alias("syn"), of("ant").alias("ant"))


def _calls(phases: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, phase, tokens, latency_s): one row for each use of a model call."""
    out = None
    for phase, df in phases.items():
        rows = df.select(*keys, F.lit(phase).alias("phase"), *USAGE)
        out = rows if out is None else out.unionByName(rows)
    return out


class _Probes:
    """Responses, their claims and the probes of these, with what decompose and mutate cost; passages by their key.

    Responses are a projection of the samples and carry a snippet of their evidence, not the text; samples are read
    again where they are needed, so what they come from should give the same rows each time.
    """

    def __init__(self, samples: DataFrame, generator: Provider, key: str, prefer_knowledge: bool, n: int, snippet_chars: int) -> None:
        keys, fact = ["sample", "answer_type"], ["sample", "answer_type", "fact_idx"]
        whole = _responses(samples, key, prefer_knowledge)
        self.responses = whole.withColumn("context_snippet", snippet(F.col("evidence"), snippet_chars)).drop("evidence")
        self.passages = passages(whole.where("not gold_label"), "evidence")  # one of a sample's two responses
        made = cut(decompose_calls(self.responses, generator, keys))
        self.facts = made.select(*keys, F.posexplode("facts").alias("fact_idx", "factoid"))
        mutated = cut(mutate_calls(self.facts, generator, fact, n))
        keyed = whole.select(*keys, context_key(F.col("evidence")))
        self.probes = mutated.select(*fact, "kind", F.posexplode("probes").alias("ord", "probe")).join(keyed, keys)
        self.phases = {"decompose": made, "mutation": mutated}

    def verified(self, probes: DataFrame, provider: Provider) -> DataFrame:
        said = verify(probes, provider, ["sample", "answer_type", "fact_idx", "kind", "ord"], "context_key", contexts=self.passages)
        return cut(said.drop("probe", "failed"))


def _single(samples: DataFrame, generator: Provider, verifier: Provider, key: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Scored responses with question, evidence and answer, and the calls behind them."""
    keys, fact = ["sample", "answer_type"], ["sample", "answer_type", "fact_idx"]
    p = _Probes(samples, generator, key, False, settings.mutations, 50)
    verdicts = p.verified(p.probes, verifier)
    scores = factoid_scores(p.facts, verdicts, fact, unknown=0.0)
    out = response_scores(p.responses, scores, keys, ["score"]).withColumnRenamed("max_score", "final_score")
    return out.withColumn("pred", flagged(F.col("final_score"), settings.threshold)), _calls({**p.phases, "stage1_verify": verdicts}, keys)


def single_verifier(samples: DataFrame, generator: Provider, verifier: Provider, key: str = "id", settings: Settings = Settings()) -> DataFrame:
    """Experiment 1: score and decision of each response with one verifier: (sample, answer_type, gold_label, final_score, pred)."""
    return _single(samples, generator, verifier, key, settings)[0].select("sample", "answer_type", "gold_label", "final_score", "pred")


def single_log(samples: DataFrame, generator: Provider, verifier: Provider, key: str = "id", settings: Settings = Settings()) -> DataFrame:
    """Experiment 1's log: one row a sample, the hallucinated and the right answer side by side.

    (id, question, context_snippet, h_answer, h_score, h_detected, h_latency_s, h_tokens, h_cloud_tokens,
    h_local_tokens, and the same with r_, r_false_alarm in place of h_detected). tokens adds the numbers of calls, as
    the original run does. Both rows of a sample meet by one aggregation.
    """
    scored, calls = _single(samples, generator, verifier, key, settings)
    keys = ["sample", "answer_type"]
    cloud = F.col("phase") != "stage1_verify"
    used = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    cost = calls.groupBy(*keys).agg(F.sum(F.when(cloud, used).otherwise(0)).alias("cloud"), F.sum(F.when(cloud, 0).otherwise(used)).alias("local"), F.count("*").alias("calls"), F.sum("latency_s").alias("latency"))
    rows = scored.join(cost, keys, "left").withColumn("tokens", tokens_legacy(F.col("cloud") + F.col("local"), F.col("calls"), F.lit(0)))

    def of(kind: str, c: str) -> Column:
        return F.max(F.when(F.col("answer_type") == kind, F.col(c)))

    sides = []
    for x, kind, decided in (("h", "hallucinated", "h_detected"), ("r", "right", "r_false_alarm")):
        sides += [of(kind, "answer_text").alias(f"{x}_answer"), of(kind, "final_score").alias(f"{x}_score"), of(kind, "pred").alias(decided), F.round(of(kind, "latency"), 2).alias(f"{x}_latency_s")]
        sides += [F.coalesce(of(kind, c), F.lit(0)).alias(f"{x}_{n}") for c, n in (("tokens", "tokens"), ("cloud", "cloud_tokens"), ("local", "local_tokens"))]
    return rows.groupBy(F.col("sample").alias("id")).agg(F.first("question").alias("question"), F.first("context_snippet").alias("context_snippet"), *sides)


class Cascade:
    """Experiment 2: stage 1 on all probes, the stronger verifier on all probes of escalated factoids, and the logs.

    responses and factoids are the results, calls the uses of all four phases; response_log(), factoid_log() and
    summary() are what the run writes.
    """

    def __init__(self, samples: DataFrame, generator: Provider, small: Provider, large: Provider | None, key: str = "id", settings: Settings = Settings()) -> None:
        keys, fact = ["sample", "answer_type"], ["sample", "answer_type", "fact_idx"]
        self.settings, self.names = settings, (small.name, large.name if large else "")
        p = _Probes(samples, generator, key, True, settings.mutations, 80)
        r, facts = p.responses, p.facts
        first = p.verified(p.probes, small)
        stage1 = facts.join(_lists(first, fact), fact, "left")
        phases = {**p.phases, "stage1_verify": first}
        if large is None:  # no cascade: nothing escalates, the log keeps its defaults
            none = F.array().cast("array<string>")
            decided = stage1.withColumns({"reasons": none, "escalated": F.lit(False), "final_syn": F.col("syn"), "final_ant": F.col("ant"), **{c: F.lit(0) for c in ("syn_anomaly_count", "ant_anomaly_count")}, **{c: F.lit(0.0) for c in ("syn_anomaly_ratio", "ant_anomaly_ratio")}, **{c: F.lit(False) for c in ("logical_paradox", "both_yes", "both_no")}, "risk_prior": F.lit("")})
        else:
            decided = cut(escalation(stage1, "syn", "ant", settings.policy, settings.anomaly_ratio, settings.least_anomalies, "factoid" if settings.risk_prior else None))
            again = p.probes.join(decided.where("escalated").select(*fact), fact, "left_semi")  # filtered before the model sees it
            phases["stage2_verify"] = second = p.verified(again, large)
            decided = merge_stages(decided, _lists(second, fact), fact)
        self.calls = _calls(phases, keys)
        self.factoids = decided.withColumns({"stage1_score": list_score(F.col("syn"), F.col("ant")), "cascade_score": list_score(F.col("final_syn"), F.col("final_ant"))})
        top = response_scores(r, self.factoids, keys, ["stage1_score", "cascade_score"]).withColumnsRenamed({"max_stage1_score": "stage1_final_score", "max_cascade_score": "cascade_final_score"})
        counts = self.factoids.groupBy(*keys).agg(F.count("*").alias("factoids_total"), F.count_if("escalated").alias("factoid_escalation_count"))
        top = top.join(counts, keys, "left").na.fill(0, ["factoids_total", "factoid_escalation_count"])
        reasons = joined_reasons(self.factoids, keys, "fact_idx", "reasons").select(*keys, F.array_join("reasons", " | ").alias("escalation_reasons"))
        self.responses = response_flags(top, settings.threshold).join(reasons, keys, "left").na.fill("", ["escalation_reasons"])

    def confusion(self) -> DataFrame:
        return evaluation.confusion_report(self.responses, [], {"stage1": "stage1_pred", "cascade": "cascade_pred"}, "gold_label")

    def rates(self) -> DataFrame:
        return evaluation.cascade_rates(self.responses, [])

    def usage(self) -> DataFrame:
        return evaluation.usage_by_phase(self.calls, ["sample", "answer_type"])

    def _costed(self) -> DataFrame:
        keys = ["sample", "answer_type"]
        phases = {"tokens_api_decompose": "decompose", "tokens_api_mutation": "mutation", "tokens_api_stage2_verify": "stage2_verify", "tokens_local_verify": "stage1_verify"}
        cost = self.usage().select(*keys, "latency_s", "tokens_total", *[F.col(f"tokens_{v}").alias(k) for k, v in phases.items()])
        cloud = F.col("tokens_api_decompose") + F.col("tokens_api_mutation") + F.col("tokens_api_stage2_verify")
        return self.responses.join(cost, keys, "left").na.fill(0, ["latency_s", "tokens_total", *phases]).withColumn("tokens_cloud_total", cloud)

    def response_log(self) -> DataFrame:
        """One row a response, 25 columns: texts, labels, scores, flags, counts, reasons, latency and tokens by phase."""
        flags = ["stage1_pred", "cascade_pred", "stage1_correct", "cascade_correct", "response_escalated", "response_rescued", "response_hurt", "factoids_total", "factoid_escalation_count", "escalation_reasons"]
        costs = ["latency_s", "tokens_total", "tokens_cloud_total", "tokens_local_verify", "tokens_api_decompose", "tokens_api_mutation", "tokens_api_stage2_verify"]
        return rounded_log(self._costed()).select(F.col("sample").alias("id"), "question", "context_snippet", "answer_type", F.col("gold_label").cast("int").alias("gold_label"), "answer_text", "stage1_final_score", "cascade_final_score", *flags, *costs)

    def factoid_log(self) -> DataFrame:
        """One row a factoid of a response, 22 columns: reasons, scores, verdict lists as JSON text, statistics."""
        ints = {c: F.col(c).cast("int") for c in ("escalated", "logical_paradox", "both_yes", "both_no")}
        lists = {"stage1_syn_decisions": "syn", "stage1_ant_decisions": "ant", "final_syn_decisions": "final_syn", "final_ant_decisions": "final_ant"}
        named = self.factoids.join(self.responses.select("sample", "answer_type", "question", F.col("gold_label").cast("int").alias("gold_label")), ["sample", "answer_type"])
        return named.select(
            F.col("sample").alias("id"), "question", "answer_type", "gold_label", (F.col("fact_idx") + 1).alias("factoid_id"), F.col("factoid").alias("factoid_text"), ints["escalated"].alias("escalated"), F.array_join("reasons", " | ").alias("trigger_reasons"),
            F.round("stage1_score", 4).alias("stage1_factoid_score"), F.round("cascade_score", 4).alias("cascade_factoid_score"), *[decisions_text(F.col(c)).alias(k) for k, c in lists.items()],
            "syn_anomaly_count", "ant_anomaly_count", "syn_anomaly_ratio", "ant_anomaly_ratio", *[ints[c].alias(c) for c in ("logical_paradox", "both_yes", "both_no")], "risk_prior",
        )

    def summary(self, model: str) -> DataFrame:
        """One row: settings, counts and scores of both stages, rates and averages; upsert() keeps one for each model."""
        log = cut(self._costed().withColumn("model", F.lit(model)))
        by = ["model"]
        parts = [evaluation.confusion_report(log, by, {"stage1": "stage1_pred", "cascade": "cascade_pred"}, "gold_label"), evaluation.cascade_rates(log, by), evaluation.cost_summary(log, by)]
        out = parts[0].join(parts[1], by).join(parts[2], by).join(log.groupBy("model").agg(F.countDistinct("sample").alias("sample_size")), by)
        s = self.settings
        return out.withColumns({"policy": F.lit(s.policy), "small_verifier": F.lit(self.names[0]), "stage2_verifier": F.lit(self.names[1]), "threshold": F.lit(s.threshold), "n_mutations": F.lit(s.mutations)})


def _judged(records: DataFrame, verifier: Provider, name: str, settings: Settings) -> DataFrame:
    """(id, verifier, orig, syn, ant): batch verdicts of the factoid and its mutations."""
    none = F.array().cast("array<string>")
    probe = F.array(F.struct(F.lit("orig").alias("kind"), F.lit(0).alias("ord"), F.coalesce("factoid", F.lit("")).alias("probe")))

    def tagged(kind: str, part: str) -> Column:
        listed = F.slice(F.coalesce(F.col("mutations_list")[part], none), 1, settings.mutations)
        return F.transform(listed, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), x.alias("probe")))

    probe = F.concat(probe, tagged("syn", "synonyms"), tagged("ant", "antonyms"))
    probes = records.select("id", context_key(F.col("context")), F.inline(probe))
    said = verify(probes, verifier, ["id", "kind", "ord"], "context_key", contexts=passages(records, "context")).withColumn("verdict", batch_verdict(F.col("verdict"), settings.verdict_domain))
    orig = F.max(F.when(F.col("kind") == "orig", F.col("verdict"))).alias("orig")
    lists = _lists(said, ["id"]).join(said.groupBy("id").agg(orig), "id")
    return lists.withColumn("verifier", F.lit(name))


def with_mutations(records: DataFrame, generator: Provider, n: int = 2, cache: DataFrame | None = None) -> DataFrame:
    """records with mutations_list: kept or cached lists as they are, the rest asked for and given back for caching."""
    if cache is not None:
        records = cached_or_base(records, cache, "id", "mutations_list")
    missing = records.where("mutations_list is null")
    made = mutate(missing.select("id", "factoid"), generator, ["id"], n)
    lists = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "probe")))), lambda x: x["probe"])
    made = made.groupBy("id").agg(F.struct(lists("syn").alias("synonyms"), lists("ant").alias("antonyms")).alias("made"))
    return records.join(made, "id", "left").withColumn("mutations_list", F.coalesce("mutations_list", "made")).drop("made")


def cached_mutations(records: DataFrame, generator: Provider, path: str, n: int = 2) -> DataFrame:
    """with_mutations over the cache at path, which afterwards holds every list worth keeping: no failed calls.

    What earlier runs cached for other records stays; the table is swapped in whole.
    """
    spark = records.sparkSession
    old = spark.read.parquet(path).select("id", "mutations_list") if exists(spark, path) else None
    full = cut(with_mutations(records, generator, n, old))
    kept = cacheable(full).select("id", "mutations_list")
    replace_table(kept if old is None else kept.unionByName(remaining(old, kept, "id")), path)
    return full


def single_model(records: DataFrame, verifier: Provider, policy: str, settings: Settings = Settings()) -> DataFrame:
    """Experiment 3: (id, factoid_type, truth, orig, syn, ant, escalated, trigger, failure, correct) by one policy."""
    said = _judged(records, verifier, verifier.name, settings).join(records.select("id", "factoid_type", F.col("context_support").alias("truth")), "id")
    out = batch_policies.apply_policy(said, policy)
    return out.withColumn("correct", batch_policies.original_correct(F.col("truth"), F.col("orig"), "false"))


def two_verifiers(records: DataFrame, small: Provider, large: Provider, done: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Experiment 3b: both verifiers on every record that is not done yet, compared: status, rescued, harmed."""
    todo = records if done is None else remaining(records, done, "id")
    both = _judged(todo, small, "small", settings).unionByName(_judged(todo, large, "large", settings))
    base = todo.select("id", "factoid_type", F.col("context_support").alias("truth"))
    judged = batch_policies.apply_policy(both.join(base, "id"), "structure_aware").withColumn("correct", batch_policies.original_correct(F.col("truth"), F.col("orig"), settings.null_truth))
    paired = reports.side_by_side(judged, "id", "verifier", ["escalated", "trigger", "failure", "correct", "orig"], ("small", "large"))
    rescued, harmed = reports.recovered(F.col("small_escalated"), F.col("small_correct"), F.col("large_correct"))
    return base.join(paired, "id").withColumns({"status": batch_policies.status(F.col("small_escalated"), F.col("small_correct")), "rescued": rescued, "harmed": harmed})
