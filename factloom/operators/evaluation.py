"""Confusion matrices, rates and costs. Every report is one aggregation, combined before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0 or nothing was counted."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def confusion(pred: Column, gold: Column, prefix: str = "") -> list[Column]:
    cells = {"tp": pred & gold, "fp": pred & ~gold, "tn": ~pred & ~gold, "fn": ~pred & gold}
    return [_count(c).alias(prefix + k) for k, c in cells.items()]


def prf(df: DataFrame, prefix: str = "") -> DataFrame:
    """precision, recall, f1 and accuracy from the four counts; zero denominators give 0.0."""
    tp, fp, tn, fn = (F.col(prefix + k) for k in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return df.withColumns({f"{prefix}precision": p, f"{prefix}recall": r, f"{prefix}f1": ratio(2 * p * r, p + r), f"{prefix}accuracy": ratio(tp + tn, tp + fp + tn + fn)})


def confusion_report(df: DataFrame, by: list[str], stages: dict[str, str], gold: str) -> DataFrame:
    """Counts and scores of every stage (name -> 0/1 prediction column) in one aggregation."""
    aggs = [c for name, pred in stages.items() for c in confusion(F.col(pred) == 1, F.col(gold), f"{name}_")]
    out = df.groupBy(*by).agg(*aggs)
    for name in stages:
        out = prf(out, f"{name}_")
    return out


def paired_confusion(df: DataFrame, by: list[str], h_flagged: Column, r_flagged: Column) -> DataFrame:
    """One row per sample, both answers side by side: the hallucinated one gives TP or FN, the right one FP or TN."""
    cells = {"tp": h_flagged, "fn": ~h_flagged, "fp": r_flagged, "tn": ~r_flagged}
    return prf(df.groupBy(*by).agg(*[_count(c).alias(k) for k, c in cells.items()]))


def cascade_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Escalation, rescue, harm, net gain and efficiency from the flags of a response log."""
    one = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    sums = df.groupBy(*by).agg(
        F.count("*").alias("responses"), one("response_escalated").alias("escalated"), one("response_rescued").alias("rescued"), one("response_hurt").alias("hurt"),
        F.count_if((F.col("response_escalated") == 1) & (F.col("stage1_correct") == 0)).alias("escalated_wrong"),
        one("factoids_total").alias("factoids"), one("factoid_escalation_count").alias("factoids_escalated"), one("stage1_correct").alias("ok1"), one("cascade_correct").alias("ok2"),
    )
    n, e = F.col("responses"), F.col("escalated")
    gain = F.col("ok2") - F.col("ok1")
    return sums.select(
        *by, "responses", "escalated", "rescued", "hurt", "escalated_wrong",
        ratio(e, n).alias("response_escalation_rate"), ratio(F.col("factoids_escalated"), F.col("factoids")).alias("factoid_escalation_rate"),
        ratio(F.col("rescued"), e).alias("rescue_rate"), ratio(F.col("rescued"), F.col("escalated_wrong")).alias("conditional_rescue_rate"), ratio(F.col("hurt"), e).alias("harm_rate"),
        gain.alias("net_gain"), (ratio(gain, e) * 100).alias("efficiency_per_100"),
    )


COSTS = ("latency_s", "tokens_total", "tokens_cloud_total", "tokens_local_verify", "tokens_api_decompose", "tokens_api_mutation", "tokens_api_stage2_verify")


def cost_summary(df: DataFrame, by: list[str], measures: tuple[str, ...] = COSTS) -> DataFrame:
    """Averages per response; nulls are left out of their own average. Rounded, as sums of doubles depend on order."""
    return df.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(f"{c}_avg") for c in measures])


def usage_by_phase(calls: DataFrame, keys: list[str], phases: tuple[str, ...] = ("decompose", "mutation", "stage1_verify", "stage2_verify")) -> DataFrame:
    """Tokens, calls and summed latency of each response by phase, from one row per model call."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    aggs = [F.sum(F.when(F.col("phase") == p, tokens).otherwise(0)).alias(f"tokens_{p}") for p in phases]
    return calls.groupBy(*keys).agg(*aggs, F.sum(tokens).alias("tokens_total"), F.count("prompt_tokens").alias("calls"), F.round(F.sum("latency_s"), 6).alias("latency_s"))
