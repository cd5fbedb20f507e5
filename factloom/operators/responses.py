"""From samples to responses, from factoid logs to response logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import evidence
from factloom.operators.scoring import flagged


def unpivot_answers(samples: DataFrame, keys: list[str], answers: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    """Two responses a sample: (keys, answer_type, gold_label, answer_text), the hallucinated one first.

    Missing texts become ''. One pass, no shuffle.
    """
    answers = answers or {"hallucinated": ("hallucinated_answer", True), "right": ("right_answer", False)}
    rows = F.array(*[F.struct(F.lit(name).alias("answer_type"), F.lit(gold).alias("gold_label"), F.coalesce(column, F.lit("")).alias("answer_text")) for name, (column, gold) in answers.items()])
    return samples.select(*keys, F.inline(rows))


def with_evidence(samples: DataFrame, knowledge: str = "knowledge", context: str = "context") -> DataFrame:
    return samples.withColumn("evidence", evidence(F.col(knowledge), F.col(context)))


def response_flags(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predictions, correctness, escalated, rescued, hurt and escalated_wrong, from the scores, gold_label and counts."""
    s1, s2 = flagged(F.col("stage1_final_score"), threshold), flagged(F.col("cascade_final_score"), threshold)
    ok1, ok2 = s1 == F.col("gold_label"), s2 == F.col("gold_label")
    esc = F.col("factoid_escalation_count") > 0
    return df.withColumns(
        {"stage1_pred": s1.cast("int"), "cascade_pred": s2.cast("int"), "stage1_correct": ok1.cast("int"), "cascade_correct": ok2.cast("int"), "response_escalated": esc.cast("int"), "response_rescued": (esc & ~ok1 & ok2).cast("int"), "response_hurt": (esc & ok1 & ~ok2).cast("int"), "escalated_wrong": (esc & ~ok1).cast("int")}
    )


def token_totals(prompt_tokens: Column, completion_tokens: Column, local_prompt: Column, local_completion: Column) -> dict[str, Column]:
    return {"tokens_cloud_total": prompt_tokens + completion_tokens, "tokens_local_verify": local_prompt + local_completion, "tokens_total": prompt_tokens + completion_tokens + local_prompt + local_completion}


def tokens_legacy(tokens: Column, api_calls: Column, local_calls: Column) -> Column:
    """The single-verifier run's token figure, which adds the numbers of calls."""
    return tokens + api_calls + local_calls


def joined_reasons(factoids: DataFrame, keys: list[str], index: str, reasons: str) -> DataFrame:
    """All reasons of a response in factoid order: (keys, reasons array). A response's factoids are few by nature."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(reasons).alias("r"))))
    return factoids.groupBy(*keys).agg(F.flatten(F.transform(packed, lambda x: F.coalesce(x["r"], F.array().cast("array<string>")))).alias("reasons"))


def nested_log(factoids: DataFrame, keys: list[str], index: str, columns: list[str]) -> DataFrame:
    """One row a response with its factoids as structs, in factoid order; for exports."""
    return factoids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, *columns))).alias("factoids"))


def rounded_log(df: DataFrame) -> DataFrame:
    """Scores and latency as the logs have them; everything else as it is."""
    return df.withColumns({"stage1_final_score": F.round("stage1_final_score", 4), "cascade_final_score": F.round("cascade_final_score", 4), "latency_s": F.round("latency_s", 2)})


def probe_pairs(texts: Column, outputs: Column) -> Column:
    """Texts with their verdicts, as many as both have."""
    n = F.least(F.size(texts), F.size(outputs))
    return F.arrays_zip(F.slice(texts, 1, n).alias("text"), F.slice(outputs, 1, n).alias("output"))
