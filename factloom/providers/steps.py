"""The model steps as transforms: decompose, mutate, verify, judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.parsing import factoids, is_true, mutations, verdict
from factloom.functions.text import strip
from factloom.operators.responses import unpivot_answers
from factloom.providers.base import Provider, Retrying, ask, context_key

PROMPTS = {
    "decompose": "List every separate factual claim of the text as a JSON array of short, self-contained sentences. Add nothing, correct nothing, name what pronouns stand for.",
    "synonyms": "Restate the claim with the same meaning, one restatement a line, nothing else.",
    "antonyms": "State the opposite of the claim, one statement a line, nothing else.",
    "verify": "Say whether the passage supports the statement. Answer with YES, NO or NOT SURE only, from the passage alone.",
    "judge": "Say whether every fact of the answer is in the passage or follows from it. Answer True or False only.",
    "inject": "Change the answer so that it sounds likely but is wrong, keeping its language and length. Kinds of change to use: ",
}
INJECTIONS = ("Entity", "Negation", "Quantifier", "Time", "Comparative", "Numerical", "Relational")


USAGE = ("prompt_tokens", "completion_tokens", "latency_s")


def _requests(df: DataFrame, phase: str, statement: str, context: str | None = None, system: str | None = None) -> DataFrame:
    """One request a row; with a context column, its key in place of the text."""
    keep = [c for c in df.columns if c not in (statement, context)]
    said = F.coalesce(statement, F.lit(""))
    passage = [context_key(F.col(context))] if context else [said.alias("prompt"), F.lit("").alias("context")]
    return df.select(*keep, F.lit(phase).alias("phase"), F.lit(system or PROMPTS.get(phase, "")).alias("system"), said.alias("statement"), *passage)


def passages(df: DataFrame, context: str) -> DataFrame:
    """(context_key, context) of a column of passages."""
    return df.select(context_key(F.col(context)), F.col(context).alias("context"))


def decompose_calls(responses: DataFrame, provider: Provider, keys: list[str], answer: str = "answer_text") -> DataFrame:
    """(keys, facts, tokens and latency): one row a response, its claims as an array."""
    replies = ask(_requests(responses.select(*keys, F.col(answer).alias("a_")), "decompose", "a_"), provider)
    return replies.select(*keys, factoids(F.col("text"), F.col("statement")).alias("facts"), *USAGE)


def decompose(responses: DataFrame, provider: Provider, keys: list[str], answer: str = "answer_text") -> DataFrame:
    """(keys, fact_idx, factoid): one row a claim; an unreadable reply makes the whole answer the one claim."""
    return decompose_calls(responses, provider, keys, answer).select(*keys, F.posexplode("facts").alias("fact_idx", "factoid"))


def mutate_calls(facts: DataFrame, provider: Provider, keys: list[str], n: int = 2, factoid: str = "factoid") -> DataFrame:
    """(keys, kind, probes, tokens and latency): two rows a claim, its restatements (syn) and its opposites (ant)."""
    out = None
    for kind, phase in (("syn", "synonyms"), ("ant", "antonyms")):
        replies = ask(_requests(facts.select(*keys, F.col(factoid).alias("f_")), phase, "f_"), provider)
        made = F.when(~F.col("failed"), mutations(F.col("text"), n)).otherwise(F.array().cast("array<string>"))
        rows = replies.select(*keys, F.lit(kind).alias("kind"), made.alias("probes"), *USAGE)
        out = rows if out is None else out.unionByName(rows)
    return out


def mutate(facts: DataFrame, provider: Provider, keys: list[str], n: int = 2, factoid: str = "factoid") -> DataFrame:
    """(keys, kind, ord, probe): up to n restatements (syn) and n opposites (ant) of each claim; failures give none."""
    return mutate_calls(facts, provider, keys, n, factoid).select(*keys, "kind", F.posexplode("probes").alias("ord", "probe"))


def verify(probes: DataFrame, provider: Provider, keys: list[str], context: str, probe: str = "probe", contexts: DataFrame | None = None) -> DataFrame:
    """probes with verdict, tokens and latency. A failed call is NOT SURE.

    context is a column of passages; with contexts (context_key, context) it is one of their keys, and no passage is
    copied to its probes.
    """
    if contexts is None:
        contexts, asked = passages(probes, context), _requests(probes.select(*keys, F.col(probe).alias("p_"), F.col(context).alias("c_")), "verify", "p_", "c_")
    else:
        asked = probes.select(*keys, F.lit("verify").alias("phase"), F.lit(PROMPTS["verify"]).alias("system"), F.coalesce(probe, F.lit("")).alias("statement"), F.col(context).alias("context_key"))
    return ask(asked, provider, contexts=contexts).select(*keys, F.col("statement").alias(probe), verdict(F.col("text")).alias("verdict"), *USAGE, "failed")


def judge(samples: DataFrame, provider: Provider, keys: list[str], answer: str, context: str, tries: int = 3) -> DataFrame:
    """(keys, supported): empty fields are not asked and not supported; only a reply of True counts.

    A reply that is neither True nor False is asked for again, `tries` times in all; then the sample is not supported.
    """
    there = samples.where((F.coalesce(answer, F.lit("")) != "") & (F.coalesce(context, F.lit("")) != ""))
    asked = _requests(there.select(*keys, F.col(answer).alias("a_"), F.col(context).alias("c_")), "judge", "a_", "c_")
    replies = ask(asked, Retrying(provider, r"^\s*(?:true|false)\s*$", tries), contexts=passages(there, context))
    return samples.select(*keys).join(replies.select(*keys, is_true(F.col("text")).alias("supported")), keys, "left").na.fill(False, ["supported"])


def answer_factoids(samples: DataFrame, provider: Provider, keys: list[str]) -> DataFrame:
    """(keys, answer_type, source_answer, fact_idx, factoid): the claims of both answers; empty answers are not asked, blank claims dropped."""
    both = unpivot_answers(samples, keys).where("answer_text <> ''")
    facts = decompose(both, provider, [*keys, "answer_type", "answer_text"])
    return facts.where(strip(F.col("factoid")) != "").withColumnRenamed("answer_text", "source_answer")


def inject(samples: DataFrame, provider: Provider, keys: list[str], answer: str, seed: int = 42) -> DataFrame:
    """(keys, strategies, hallucinated_answer): one to three kinds of change, chosen by a seeded hash of the keys."""
    h = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), 1, 8), 16, 10).cast("long"), F.lit(7 * 3))
    order = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.element_at(F.array(*map(F.lit, INJECTIONS)), F.pmod(i * 3 + h, F.lit(7)).cast("int") + 1))
    chosen = samples.withColumn("strategies", F.slice(order, F.lit(1), (h / 7).cast("int") + 1))
    asked = _requests(chosen.select(*keys, "strategies", F.col(answer).alias("a_")), "inject", "a_").withColumn("system", F.concat(F.lit(PROMPTS["inject"]), F.array_join("strategies", ", ")))
    return ask(asked, provider).select(*keys, "strategies", F.col("text").alias("hallucinated_answer"))
