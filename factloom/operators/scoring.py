"""Penalties of verdicts, scores of factoids and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.parsing import NO, NOT_SURE, YES


def penalty(kind: Column, verdict: Column, unknown: float = 0.5) -> Column:
    """A synonym should be YES, an antonym NO; NOT SURE costs a half. Other kinds cost nothing.

    unknown is the price of a verdict outside the three (0.5 in the cascade, 0.0 in the single-verifier run).
    """
    bad = F.when(kind == "syn", F.lit(NO)).when(kind == "ant", F.lit(YES))
    good = F.when(kind == "syn", F.lit(YES)).when(kind == "ant", F.lit(NO))
    return F.when(bad.isNull(), 0.0).when(verdict == bad, 1.0).when(verdict == good, 0.0).when(verdict == NOT_SURE, 0.5).otherwise(unknown).cast("double")


def list_score(syn: Column, ant: Column, unknown: float = 0.5) -> Column:
    """Mean penalty over both verdict lists; 0.0 if both are empty or null."""
    none = F.array().cast("array<string>")
    costs = F.concat(F.transform(F.coalesce(syn, none), lambda v: penalty(F.lit("syn"), v, unknown)), F.transform(F.coalesce(ant, none), lambda v: penalty(F.lit("ant"), v, unknown)))
    return F.when(F.size(costs) == 0, 0.0).otherwise(F.try_divide(F.aggregate(costs, F.lit(0.0), lambda a, x: a + x), F.size(costs)))


def factoid_scores(factoids: DataFrame, probes: DataFrame, keys: list[str], unknown: float = 0.5) -> DataFrame:
    """score per factoid from the long probe table (keys, kind, verdict); factoids without probes keep 0.0.

    Partial averages are combined before the shuffle on the keys.
    """
    means = probes.groupBy(*keys).agg(F.avg(penalty(F.col("kind"), F.col("verdict"), unknown)).alias("score"))
    return factoids.join(means, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def response_scores(responses: DataFrame, scored: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The largest factoid score of each response, 0.0 for responses without factoids."""
    top = scored.groupBy(*keys).agg(*[F.max(c).alias(f"max_{c}") for c in columns])
    out = responses.join(top, keys, "left")
    return out.withColumns({f"max_{c}": F.coalesce(f"max_{c}", F.lit(0.0)) for c in columns})


def flagged(score: Column, threshold: float = 0.5) -> Column:
    """The decision on the unrounded score."""
    return score >= F.lit(threshold)
