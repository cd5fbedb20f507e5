"""What a model said, as data: verdicts, factoids, mutations, judgements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip

YES, NO, NOT_SURE = "YES", "NO", "NOT SURE"


def verdict(raw: Column) -> Column:
    """NOT SURE if the reply says so, else the first whole word YES or NO, else NOT SURE; null is NOT SURE."""
    u = F.upper(F.coalesce(raw, F.lit("")))
    word = F.regexp_extract(u, r"(?:^|[^\p{L}\p{N}_])(YES|NO)(?:[^\p{L}\p{N}_]|$)", 1)
    return F.when(u.contains(NOT_SURE), NOT_SURE).when(word != "", word).otherwise(NOT_SURE)


def two_valued(raw: Column) -> Column:
    """The batch runs' renormalised verdict: YES if contained, else NO if contained, which NOT SURE contains too."""
    u = F.upper(F.coalesce(raw, F.lit("")))
    return F.when(u.contains(YES), YES).when(u.contains(NO), NO).otherwise(NOT_SURE)


def batch_verdict(raw: Column, domain: str = "legacy2") -> Column:
    """legacy2: two_valued over the parsed verdict, so NOT SURE becomes NO; tri: the parsed verdict itself."""
    if domain not in ("legacy2", "tri"):
        raise ValueError(f"unknown verdict domain {domain!r}")
    return two_valued(verdict(raw)) if domain == "legacy2" else verdict(raw)


def _unfenced(raw: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(raw, F.lit("")), "```(?:json)?", ""))


def factoids(raw: Column, answer: Column) -> Column:
    """The reply's JSON array of strings; anything else stands for one factoid, the whole answer.

    [] stays empty. Text after the array makes the reply invalid, as a strict parser has it.
    """
    clean = _unfenced(raw)
    parsed = F.when(clean.rlike(r"^\[[\s\S]*\]$"), F.from_json(clean, "array<string>", {"mode": "PERMISSIVE"}))
    return F.coalesce(parsed, F.array(F.coalesce(answer, F.lit(""))))


def mutations(raw: Column, n: int) -> Column:
    """The first n non-blank lines of a reply."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), strip)
    return F.slice(F.filter(lines, lambda x: x != ""), 1, n)


def starts_yes(raw: Column) -> Column:
    """Oracle label: true if the reply starts with YES; everything else is false."""
    return F.coalesce(F.regexp_extract(F.upper(strip(raw)), "^(YES|NO)", 1) == YES, F.lit(False))


def is_true(raw: Column) -> Column:
    """Judge of grounding: only True counts; unexpected replies and null are false."""
    return F.coalesce(F.lower(strip(raw)) == "true", F.lit(False))


def decisions(text: Column) -> Column:
    """A JSON list of verdicts; null and broken text give the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def decisions_text(verdicts: Column) -> Column:
    """A list of verdicts as the logs have it: a JSON list with spaces; null is the empty list."""
    quoted = F.transform(F.coalesce(verdicts, F.array().cast("array<string>")), lambda v: F.concat(F.lit('"'), v, F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
