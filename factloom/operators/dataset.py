"""Dataset construction: field mapping, lexical grounding, fact types, pools and balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions.text import core_words, joined_documents
from factloom.session import cut

# Category names, and our own signal words; the specification gives only examples. In order of priority.
TAXONOMY = (
    ("Cat 2: Negation/Exception", r"\b(not|never|no|none|nobody|nothing|neither|nor|without|except|excluding|unless|cannot|isn't|wasn't|didn't|doesn't)\b"),
    ("Cat 5: Comparative/Superlative", r"\b(more|less|fewer|higher|lower|larger|smaller|greater|older|younger|taller|shorter|longer|better|worse|earlier|later|most|least|largest|smallest|highest|lowest|oldest|youngest|best|worst|than)\b"),
    ("Cat 3: Quantifier/Boundary", r"\b(only|all|every|each|some|any|many|few|several|majority|minority|half|both|entire|exactly|at least|at most|up to)\b"),
    ("Cat 7: Multi-entity/Multi-hop", r"\b(because|due to|caused by|led to|resulted in|acquired|merged|founded by|owned by|part of|joined|together with|through|thanks to|in order to|designed by|directed by)\b"),
    ("Cat 4: Time/Sequence", r"\b(before|after|since|until|during|first|last|then|century|decade|year|years|month|months|january|february|march|april|may|june|july|august|september|october|november|december|1[0-9]{3}|20[0-9]{2})\b"),
    ("Cat 6: Numerical/Computation", r"([0-9]|\b(percent|average|total|double|triple|sum|twice|dozen|hundred|thousand|million|billion)\b)"),
)
FALLBACK = "Cat 1: Entity/Alias/Lexical Rewrite"


def fact_type(text: Column) -> Column:
    """The first category whose signal occurs, in the order 2, 5, 3, 7, 4, 6, else category 1; null stays null."""
    t = F.lower(text)
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    for name, pattern in TAXONOMY:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise(FALLBACK)


def positions(df: DataFrame, name: str = "position") -> DataFrame:
    """df with the 1-based position of each row in input order, from counts per partition; no global sort.

    The partitions' offsets are a small table (one row a partition), joined back.
    """
    tagged = cut(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = tagged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_p", before.alias("_before")))  # one row a partition
    numbered = tagged.withColumn("_p", part).join(offsets, "_p")
    return numbered.withColumn(name, (F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).cast("long")).select(*df.columns, name)


def map_fields(df: DataFrame, docs: str = "docs", annotations: str = "annotations") -> DataFrame:
    """(id, question, context, right_answer) from raw samples: three documents, the first annotation's long answer.

    Samples without a question_id column get their 1-based position.
    """
    if "question_id" not in df.columns:
        df = positions(df, "question_id")
    first = F.try_element_at(F.transform(annotations, lambda a: a["long_answer"]), F.lit(1))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return df.select(F.col("question_id").cast("string").alias("id"), empty(F.col("question")).alias("question"), empty(joined_documents(F.col(docs))).alias("context"), empty(first).alias("right_answer"))


def lexical_coverage(df: DataFrame, answer: str, context: str) -> DataFrame:
    """df with answer_words, covered_words and coverage: the share of the answer's core words the context has.

    Both texts are in one row, so this is a projection: no join, no shuffle. Null coverage: the answer has no core words.
    """
    a, c = core_words(F.col(answer)), core_words(F.col(context))
    both = F.size(F.array_intersect(a, c))
    return df.withColumns({"answer_words": F.size(a), "covered_words": both, "coverage": F.try_divide(both.cast("double"), F.size(a).cast("double"))})


def grounding_filter(df: DataFrame, answer: str, context: str, threshold: float = 0.4) -> DataFrame:
    """Rows whose coverage is above the threshold, and those without core words; equality is dropped."""
    return lexical_coverage(df, answer, context).where(F.col("coverage").isNull() | (F.col("coverage") > threshold))


def statement_coverage(statements: DataFrame, s_id: str, s_text: str, documents: DataFrame, d_id: str, d_text: str, threshold: float = 0.4) -> DataFrame:
    """(s_id, d_id, matched, coverage) of statements against a whole corpus.

    A document that holds more than the share `threshold` of a statement's n words holds one of its n - floor(threshold
    n) rarest ones, whatever the order. Only under these a statement meets documents, rare words first by the number of
    documents; the pairs are then counted over all words. Words that occur in no statement leave the corpus side before
    the shuffle, and no common word brings all documents together unless a statement has nothing rarer.
    """
    s = statements.select(F.col(s_id).alias("s"), core_words(F.col(s_text)).alias("words")).dropDuplicates(["s"])
    texts = documents.select(F.col(d_id).alias("d"), F.col(d_text).alias("text"))
    words = texts.select("d", F.explode(core_words(F.col("text"))).alias("w"))
    wanted = s.select(F.explode("words").alias("w")).distinct()
    df = words.join(wanted, "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    order = W.partitionBy("s").orderBy(F.coalesce("df", F.lit(0)), "w")
    ranked = s.select("s", F.size("words").alias("n"), F.explode("words").alias("w")).join(df, "w", "left").withColumn("rank", F.row_number().over(order))
    probes = ranked.where(F.col("rank") <= F.col("n") - F.floor(F.lit(threshold) * F.col("n") + 1e-9)).select("s", "w")
    pairs = words.join(probes, "w").select("s", "d").distinct()
    held = texts.join(pairs.select("d").distinct(), "d", "left_semi").select("d", core_words(F.col("text")).alias("held"))
    out = pairs.join(held, "d").join(s, "s").select("s", "d", F.size(F.array_intersect("words", "held")).cast("long").alias("matched"), F.size("words").alias("n"))
    out = out.withColumn("coverage", F.col("matched") / F.col("n")).where(F.col("coverage") > threshold)
    return out.select(F.col("s").alias(s_id), F.col("d").alias(d_id), "matched", "coverage")


def dual_validation(df: DataFrame, right_supported: Column, false_contradicted: Column) -> DataFrame:
    """Keep samples whose right answer is supported and whose false one has an unsupported fact; missing is dirty."""
    return df.where(F.coalesce(right_supported & false_contradicted, F.lit(False)))


def merge_pools(pools: list[DataFrame], required: list[str]) -> DataFrame:
    """One pool of all, absent columns as null, rows without the required fields left out."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.where(" and ".join(f"`{c}` is not null" for c in required))


def seeded_order(key: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order that any engine can compute: multiplication modulo 2^32."""
    return F.pmod((key.cast("long") + seed) * F.lit(2654435761).cast("long"), F.lit(1 << 32).cast("long"))


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Exactly k rows (all, if there are fewer), the same ones each time; a top-k, not a full sort."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(k)


def balanced_sample(df: DataFrame, key: str, strata: list[str], quota: int, seed: int = 42) -> DataFrame:
    """At most quota rows of each stratum in seeded order, with a new sequence from 1; smaller strata give all they have.

    row_number <= quota is pushed below the shuffle as a limit per group, so a hot stratum sends quota rows a task.
    """
    order = W.partitionBy(*strata).orderBy("_o", key)
    picked = df.withColumn("_o", seeded_order(F.col(key), seed)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota)
    return picked.drop("_o")


def renumbered(sample: DataFrame, order: list[str], name: str = "new_id") -> DataFrame:
    """New ids 1.. in the given order; for samples, whose size is bounded by their quotas."""
    return sample.withColumn(name, F.row_number().over(W.orderBy(*order)))
