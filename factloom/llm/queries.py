"""Queries over the test tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.broken_pairs import broken_pairs
from factloom.llm.consistent_text import consistent_text
from factloom.llm.copies import collapse_copies, copy_groups, hash_report
from factloom.llm.cut_texts import CutTexts
from factloom.llm.encoding import encode_corpus
from factloom.llm.leaks import leak_report, leaked_passages
from factloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_members
from factloom.llm.target_sample import TargetSample

LABELS = ("factoid_type", "answer_type", "context_support")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, Column]:
    text = F.concat(F.coalesce("question", F.lit("")), F.lit(" "), F.col("context"))
    return _table(spark, sf_dir, "example_asqa").where("context <> ''"), "row_id", text


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = near_duplicate_members(*_samples(spark, sf_dir), k=3, similarity=0.6)
    return members.where("component <> row").select(F.col("component").alias("row_id_a"), F.col("row").alias("row_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(*_samples(spark, sf_dir), k=3, similarity=0.6)
    return groups.select(F.col("row").alias("row_id"), F.col("component").alias("group_id"))


def _forms(spark: SparkSession, sf_dir: str, changed_only: bool) -> DataFrame:
    a = consistent_text(_table(spark, sf_dir, "example_asqa"), "example_asqa", "row_id", ["context", "right_answer"], changed_only)
    return a.union(consistent_text(_table(spark, sf_dir, "example_dataset"), "example_dataset", "id", ["source_answer"], changed_only))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, True).select("table_name", "field", "row_key")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, False)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = copy_groups(_table(spark, sf_dir, "example_dataset"), "id", "question", "factoid")
    return groups.where("first <> row").select(F.col("first").alias("id_a"), F.col("row").alias("id_b"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_copies(_table(spark, sf_dir, "example_dataset"), "id", "question", "factoid").withColumnRenamed("first", "id")


def p3_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_report(_table(spark, sf_dir, "example_dataset"), "id", "question", "factoid")


def _sample(spark: SparkSession, sf_dir: str) -> TargetSample:
    return TargetSample(_table(spark, sf_dir, "example_dataset"), _table(spark, sf_dir, "sampling_target"), "id", LABELS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).report().where("unmet").select("plan_id", "cell_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).report().select("plan_id", "cell_id", "available", "wanted", "unmet")


def p4_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).report().select("plan_id", "cell_id", "seats", "short", "reason")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).sample().withColumnRenamed("row", "id").withColumn("priority", F.round("priority", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(_table(spark, sf_dir, "example_asqa"), "row_id", "question", ["right_answer", "hallucinated_answer"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def _leaks(spark: SparkSession, sf_dir: str, coverage: float | None = None) -> DataFrame:
    return leaked_passages(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_item"), "item_id", "passage", coverage=coverage)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(_leaks(spark, sf_dir, coverage=0.5))


def _cuts(spark: SparkSession, sf_dir: str) -> CutTexts:
    return CutTexts(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).found().withColumnRenamed("key", "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).report()


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).limits().select("source", "unit", "length", "n", "at_risk", *[F.round(c, 6).alias(c) for c in ("hazard", "near", "q")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (p1_found, p1_groups, p2_found, p2_forms, p3_found, p3_records, p3_hashes, p4_found, p4_report, p4_shortfall, p4_sample, p5_found, p6_ids, p7_found, p7_report, p8_found, p8_report, p8_limits)
    return {f.__name__: f for f in all_of}
