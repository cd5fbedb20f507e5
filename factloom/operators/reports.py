"""Reports by category. Null categories are left out, as a crosstab has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.batch_policies import STATUSES, status
from factloom.operators.evaluation import ratio

STRICT_HITS = ("original", "synonym", "antonym", "+")
STRUCTURE_HITS = ("category prior", "original uncertainty", "logical paradox", "threshold anomaly", "+")


def _known(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col(category).isNotNull())


def _slug(text: str) -> str:
    return {"+": "combined"}.get(text, text.lower().replace(" ", "_").replace("-", "_"))


def escalation_rate(df: DataFrame, category: str, escalated: str = "escalated") -> DataFrame:
    """(category, n, escalation_rate)."""
    return _known(df, category).groupBy(category).agg(F.count("*").alias("n"), F.round(F.avg(F.col(escalated).cast("int")), 6).alias("escalation_rate"))


def crosstab(df: DataFrame, category: str, key: str, drop: str = "None") -> DataFrame:
    """Long form (category, key, n) without the key `drop`."""
    return _known(df, category).where((F.col(key) != drop) & F.col(key).isNotNull()).groupBy(category, key).agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, category: str, key: str, values: list[str] | None = None, drop: str = "None") -> DataFrame:
    """One row a category, one column a key, zeros filled; values spares the pass that finds the keys."""
    kept = _known(df, category).groupBy(category)
    return (kept.pivot(key, values) if values else kept.pivot(key)).count().na.fill(0).drop(drop)


def status_counts(df: DataFrame, category: str, escalated: str = "escalated", correct: str = "correct") -> DataFrame:
    """Counts of the four outcomes; they partition the rows."""
    s = status(F.col(escalated), F.col(correct))
    return _known(df, category).groupBy(category).agg(F.count("*").alias("n"), *[F.count_if(s == x).alias(_slug(x)) for x in STATUSES])


def trigger_hits(df: DataFrame, category: str, hits: tuple[str, ...] = STRUCTURE_HITS, trigger: str = "trigger") -> DataFrame:
    """How many rows name each part in their trigger; '+' counts combined triggers."""
    return _known(df, category).groupBy(category).agg(*[F.sum(F.col(trigger).contains(h).cast("int")).alias(f"hit_{_slug(h)}") for h in hits])


def comparative_summary(df: DataFrame, category: str, escalated: str = "escalated", small_ok: str = "small_ok", large_ok: str = "large_ok") -> DataFrame:
    """Two verifiers on the same items: shares of the outcomes, rescue, harm and efficiency, by category."""
    esc, small, large = F.col(escalated), F.col(small_ok), F.col(large_ok)
    s = status(esc, small)
    sums = _known(df, category).groupBy(category).agg(
        F.count("*").alias("n"), F.count_if(esc).alias("e"), *[F.count_if(s == x).alias(_slug(x)) for x in STATUSES],
        F.count_if(esc & ~small & large).alias("rescued"), F.count_if(esc & small & ~large).alias("harmed"),
    )
    n, e = F.col("n"), F.col("e")
    share = lambda c: ratio(F.col(c), n).alias(f"{c}_share")
    return sums.select(
        category, "n", ratio(e, n).alias("escalation_share"), *[share(_slug(x)) for x in STATUSES],
        ratio(F.col("rescued"), e).alias("rescue_rate"), ratio(F.col("rescued"), F.col("valid_escalation")).alias("conditional_rescue_rate"), ratio(F.col("harmed"), e).alias("harm_rate"),
        (ratio(F.col("rescued") - F.col("harmed"), e) * 100).alias("efficiency"),
    )


def verifier_report(df: DataFrame, category: str, verifier: str = "verifier", hits: tuple[str, ...] = STRUCTURE_HITS) -> DataFrame:
    """Rates, outcomes and trigger hits of each verifier and category, in one aggregation instead of three joined."""
    s = status(F.col("escalated"), F.col("correct"))
    return _known(df, category).groupBy(verifier, category).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("escalated").cast("int")), 6).alias("escalation_rate"), *[F.count_if(s == x).alias(_slug(x)) for x in STATUSES],
        *[F.sum(F.col("trigger").contains(h).cast("int")).alias(f"hit_{_slug(h)}") for h in hits],
    )


def category_report(df: DataFrame, category: str, hits: tuple[str, ...] = STRUCTURE_HITS) -> DataFrame:
    """Rates, outcomes, trigger hits and the exact combinations of triggers of each category, the last as 'name: n; ...'.

    Rows are first counted by trigger and outcome, with combining before the shuffle; a category has few of these.
    """
    s = status(F.col("escalated"), F.col("correct"))
    few = _known(df, category).groupBy(category, "trigger", "escalated", s.alias("s")).agg(F.count("*").alias("n"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    by_trigger = few.groupBy(category, "trigger").agg(F.sum("n").alias("t"))
    packed = F.array_sort(F.collect_list(F.when(F.col("trigger") != "None", F.concat("trigger", F.lit(": "), "t"))))
    combined = by_trigger.groupBy(category).agg(F.array_join(packed, "; ").alias("combinations"))
    sums = few.groupBy(category).agg(
        F.sum("n").alias("n"), F.round(total(F.col("escalated")) / F.sum("n"), 6).alias("escalation_rate"), *[total(F.col("s") == x).alias(_slug(x)) for x in STATUSES],
        *[total(F.col("trigger").contains(h)).alias(f"hit_{_slug(h)}") for h in hits],
    )
    return sums.join(combined, category)


def aligned(tables: list[DataFrame], on: str) -> DataFrame:
    """Tables of statistics side by side, absent categories filled with 0."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, on, "full")
    return out.na.fill(0)


def side_by_side(df: DataFrame, key: str, verifier: str, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """Two verifiers' results on one item in one row, by conditional aggregation: one shuffle, no self-join."""
    picks = [F.max(F.when(F.col(verifier) == v, F.col(c))).alias(f"{v}_{c}") for v in names for c in columns]
    return df.groupBy(key).agg(*picks)


def recovered(escalated: Column, small_ok: Column, large_ok: Column) -> tuple[Column, Column]:
    """(rescued, harmed) of an item by the original verdicts."""
    return escalated & ~small_ok & large_ok, escalated & small_ok & ~large_ok
