"""When the cascade asks the stronger verifier: policies over verdict lists, and the merge of both stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.parsing import NO, NOT_SURE, YES


class Anomalies:
    """Counts, ratios and contradictions of a factoid's synonym and antonym verdicts; null lists are empty."""

    def __init__(self, syn: Column, ant: Column) -> None:
        none = F.array().cast("array<string>")
        self.syn, self.ant = F.coalesce(syn, none), F.coalesce(ant, none)
        self.syn_count = F.size(F.filter(self.syn, lambda v: v.isin(NO, NOT_SURE)))
        self.ant_count = F.size(F.filter(self.ant, lambda v: v.isin(YES, NOT_SURE)))
        self.syn_of, self.ant_of = F.greatest(F.size(self.syn), F.lit(1)), F.greatest(F.size(self.ant), F.lit(1))
        self.syn_ratio, self.ant_ratio = self.syn_count / self.syn_of, self.ant_count / self.ant_of
        self.both_yes = F.array_contains(self.syn, YES) & F.array_contains(self.ant, YES)
        self.both_no = F.array_contains(self.syn, NO) & F.array_contains(self.ant, NO)
        self.paradox = self.both_yes | self.both_no


def _reasons(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in pairs]))


def strict(a: Anomalies, ratio: float = 0.4, least: int = 2) -> Column:
    return _reasons((a.syn_count > 0, "Strict: Synonym anomaly"), (a.ant_count > 0, "Strict: Antonym anomaly"), (a.paradox, "Strict: Logical paradox"))


def paradox_only(a: Anomalies, ratio: float = 0.4, least: int = 2) -> Column:
    return _reasons((a.paradox, "ParadoxOnly: Logical paradox"))


def structure_aware(a: Anomalies, ratio: float = 0.4, least: int = 2) -> Column:
    def reached(side: str, k: Column, n: Column, share: Column) -> tuple[Column, Column]:
        return (k >= least) | (share >= ratio), F.format_string(f"StructureAware: {side} anomaly threshold reached (%d/%d)", k, n)

    return _reasons((a.paradox, "StructureAware: Logical paradox"), reached("Synonym", a.syn_count, a.syn_of, a.syn_ratio), reached("Antonym", a.ant_count, a.ant_of, a.ant_ratio))


# The risk prior's reasons and signals, in order.
RISKS = (
    ("RiskPrior: Numerical/Temporal", r"\b\d+\b"),
    ("RiskPrior: Negation", r"\b(not|never|no|none|cannot|without|lack)\b"),
    ("RiskPrior: Scope/Comparison", r"\b(more|less|most|least|better|worse|highest|lowest|all|every|only|always)\b"),
)


def risk_prior(fact: Column) -> Column:
    """The first risk whose signal a factoid has, or null."""
    t, out = F.lower(fact), F.when(fact.isNull(), F.lit(None).cast("string"))
    for name, signal in RISKS:
        out = out.when(t.rlike(signal), name)
    return out


POLICIES: dict[str, Callable[..., Column]] = {"strict": strict, "paradox_only": paradox_only, "structure_aware": structure_aware}


def escalation(df: DataFrame, syn: str, ant: str, policy: str = "structure_aware", ratio: float = 0.4, least: int = 2, fact: str | None = None) -> DataFrame:
    """df with reasons (in order), escalated and the logged statistics.

    An unknown policy name means structure_aware. Without a fact column the risk prior is inert: it adds no reason and
    risk_prior stays ''. With one, its reason comes last: always under strict, never under paradox_only, and beside
    another reason under structure_aware.
    """
    a = Anomalies(F.col(syn), F.col(ant))
    reasons = POLICIES.get(policy, structure_aware)(a, ratio, least)
    risk = F.lit(None).cast("string") if fact is None else risk_prior(F.col(fact))
    if fact is not None and policy != "paradox_only":
        reasons = F.when(F.lit(policy == "strict") | (F.size(reasons) > 0), F.array_compact(F.concat(reasons, F.array(risk)))).otherwise(reasons)
    return df.withColumns(
        {
            "reasons": reasons,
            "escalated": F.size(reasons) > 0,
            "syn_anomaly_count": a.syn_count,
            "ant_anomaly_count": a.ant_count,
            "syn_anomaly_ratio": F.round(a.syn_ratio, 4),
            "ant_anomaly_ratio": F.round(a.ant_ratio, 4),
            "logical_paradox": a.paradox,
            "both_yes": a.both_yes,
            "both_no": a.both_no,
            "risk_prior": F.coalesce(risk, F.lit("")),
        }
    )


def merge_stages(stage1: DataFrame, stage2: DataFrame, keys: list[str]) -> DataFrame:
    """Final verdicts: those of stage 2 where a factoid was asked again, else those of stage 1.

    stage1 has syn and ant lists per key; stage2 has them for the escalated keys only, one row each.
    """
    again = stage2.select(*keys, F.col("syn").alias("syn2"), F.col("ant").alias("ant2"))
    merged = stage1.join(again, keys, "left")
    return merged.withColumns({"final_syn": F.coalesce("syn2", "syn"), "final_ant": F.coalesce("ant2", "ant")}).drop("syn2", "ant2")
