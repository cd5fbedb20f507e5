"""Policies of the batch diagnosis: they see the original statement's verdict and the ground truth.

They are other functions than the cascade's policies of the same names. All are column expressions over
orig string, syn and ant array<string>, truth boolean (null counts as unsupported).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.parsing import NO, NOT_SURE, YES

# This label and the trigger and failure labels in the policies below, as the written results have them.
PARADOX = "logical paradox"


def _all_unsure(c: Column) -> Column:
    return (F.size(c) > 0) & F.forall(c, lambda v: v == NOT_SURE)


def _some(c: Column, *verdicts: str) -> Column:
    return F.exists(c, lambda v: v.isin(*verdicts))


def _pick(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in pairs]))


def _outcome(triggers: Column, failures: Column, otherwise: Column, distinct: bool = False) -> Column:
    shown = F.array_distinct(triggers) if distinct else triggers
    hit = F.size(triggers) > 0
    return F.struct(
        hit.alias("escalated"),
        F.when(hit, F.array_join(shown, " + ")).otherwise("None").alias("trigger"),
        F.when(hit, F.array_join(failures, " + ")).otherwise(otherwise).alias("failure"),
    )


def _silent(truth: Column, orig: Column) -> Column:
    """What a policy that does not escalate missed."""
    return F.when(truth & orig.isin(NO, NOT_SURE), F.struct(F.lit("Silent Failure").alias("t"), F.lit("Missed True Fact").alias("f"))).when(~truth & (orig == YES), F.struct(F.lit("Silent Failure").alias("t"), F.lit("Missed Hallucination").alias("f"))).otherwise(F.struct(F.lit("None").alias("t"), F.lit("Success").alias("f")))


def _with_silent(outcome: Column, truth: Column, orig: Column) -> Column:
    quiet = _silent(truth, orig)
    hit = outcome["escalated"]
    return F.struct(hit.alias("escalated"), F.when(hit, outcome["trigger"]).otherwise(quiet["t"]).alias("trigger"), F.when(hit, outcome["failure"]).otherwise(quiet["f"]).alias("failure"))


def _contradictions(orig: Column, syn: Column, ant: Column) -> tuple[Column, Column]:
    yes = (orig == YES) | F.array_contains(syn, YES)
    no = (orig == NO) | F.array_contains(syn, NO)
    return yes & F.array_contains(ant, YES), no & F.array_contains(ant, NO)


def paradox_only(orig: Column, syn: Column, ant: Column, truth: Column) -> Column:
    both_yes, both_no = _contradictions(orig, syn, ant)
    unsure = _all_unsure(syn) & _all_unsure(ant)
    triggers = F.when(unsure, F.array(F.lit("confidence collapse"))).otherwise(_pick((both_yes | both_no, PARADOX)))
    failures = F.when(unsure, F.array(F.lit("All NOT SURE"))).otherwise(_pick((both_yes, "Contradictory Both YES"), (both_no, "Contradictory Both NO")))
    return _with_silent(_outcome(triggers, failures, F.lit("Success")), truth, orig)


def strict(orig: Column, syn: Column, ant: Column, truth: Column) -> Column:
    """Uses the label: a diagnostic, not a policy to deploy. Its quiet outcome is None / None."""
    names = ("original", "synonym inconsistency", "antonym inconsistency")
    true_hits = (orig != YES, _some(syn, NO, NOT_SURE), _some(ant, YES, NOT_SURE))
    false_hits = (orig.isin(YES, NOT_SURE), _some(syn, YES, NOT_SURE), _some(ant, NO, NOT_SURE))
    true_said = ("False Negative / Not Sure", "Inconsistent on Synonym", "Failed to reject Antonym")
    false_said = ("False Positive / Not Sure", "Inconsistent on Synonym (False Positive)", "Inconsistent on Antonym")
    triggers = F.when(truth, _pick(*zip(true_hits, names))).otherwise(_pick(*zip(false_hits, names)))
    failures = F.when(truth, _pick(*zip(true_hits, true_said))).otherwise(_pick(*zip(false_hits, false_said)))
    return _outcome(triggers, failures, F.lit("None"))


def structure_aware(orig: Column, syn: Column, ant: Column, truth: Column) -> Column:
    both_yes, both_no = _contradictions(orig, syn, ant)
    decided = orig.isin(YES, NO)
    opposite = F.when(orig == YES, NO).otherwise(YES)
    syn_off = F.size(F.filter(syn, lambda v: v != orig))
    ant_off = F.size(F.filter(ant, lambda v: v != opposite))
    breached = decided & (ant_off >= 2)
    dual = decided & (syn_off >= 1) & (ant_off >= 1)
    triggers = _pick((orig == NOT_SURE, "original uncertainty"), (both_yes | both_no, PARADOX), (breached, "threshold anomaly"), (dual, "threshold anomaly"))
    failures = _pick((orig == NOT_SURE, "Original Factoid NOT SURE"), (both_yes, "Contradictory Both YES"), (both_no, "Contradictory Both NO"), (breached, "Antonym Defense Breached (>=2 errors)"), (dual, "Dual-sided Defense Breached (Syn>=1 & Ant>=1)"))
    return _with_silent(_outcome(triggers, failures, F.lit("Success"), distinct=True), truth, orig)


POLICIES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {"paradox_only": paradox_only, "strict": strict, "structure_aware": structure_aware}


def apply_policy(df: DataFrame, policy: str, orig: str = "orig", syn: str = "syn", ant: str = "ant", truth: str = "truth") -> DataFrame:
    """df with escalated, trigger and failure by the named policy; an unknown name raises."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
    none = F.array().cast("array<string>")
    out = POLICIES[policy](F.coalesce(orig, F.lit(NOT_SURE)), F.coalesce(syn, none), F.coalesce(ant, none), F.coalesce(truth, F.lit(False)))
    return df.withColumn("_outcome", out).withColumns({k: F.col("_outcome")[k] for k in ("escalated", "trigger", "failure")}).drop("_outcome")


def original_correct(truth: Column, orig: Column, null_truth: str = "incorrect") -> Column:
    """Whether the original verdict fits the truth. Null truth: 'incorrect', or 'false' to read it as unsupported."""
    if null_truth == "false":
        truth = F.coalesce(truth, F.lit(False))
    return F.coalesce((truth & (orig == YES)) | (~truth & (orig == NO)), F.lit(False))


def status(escalated: Column, correct: Column) -> Column:
    return F.when(escalated & ~correct, "Valid Escalation").when(escalated, "Over_escalation").when(correct, "Success Pass").otherwise("Missed Detection")


# The four outcomes, as the written results have them.
STATUSES = ("Valid Escalation", "Over_escalation", "Success Pass", "Missed Detection")
