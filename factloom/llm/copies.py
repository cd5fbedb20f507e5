"""Copies hidden by formatting: one record each, with its number of copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.consistent_text import consistent_array
from factloom.operators.components import connected_components
from factloom.session import cut

#: What a text keeps: letters, digits, and the vowel signs of alphabets in which these are no accents.
_LEFT_OUT = r"[^\p{L}\p{N}[\p{M}&&[\u0900-\u109F\u1700-\u18AF\u1A00-\u1CFF\uA800-\uABFF]]]+"


def canonical(text: Column) -> Column:
    """Letters and digits only, without case, of a text in its consistent form. Runs in the JVM."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _LEFT_OUT, "")


def _any_order(text: Column, separator: str) -> Column:
    parts = F.array_sort(F.filter(F.transform(F.split(text, separator), canonical), lambda x: x != ""))
    return F.array_join(parts, "")


def _consistent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, a, b with the texts in their consistent form: widths, accents apart, joined letters, invisible characters."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *(consistent_array(batch.column(i), alike=False)[0].cast(pa.string()) for i in (1, 2))], names=["row", "a", "b"])


def _keyed(df: DataFrame, row_id: str, field_a: str, field_b: str, separator: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(row, keys): the keys of each row that takes part, as (key, check)."""
    a, b = F.col("a"), F.col("b")
    base = df.select(F.col(row_id).cast("long").alias("row"), F.col(field_a).alias("a"), F.col(field_b).alias("b")).where("row is not null and a is not null and b is not null")
    base = base.mapInArrow(_consistent, "row long, a string, b string")
    base = base.select("row", canonical(a).alias("a"), canonical(b).alias("b"), *[F.when(x.contains(separator), _any_order(x, separator)).alias(f"{n}_sorted") for n, x in (("a", a), ("b", b))]).where("a <> '' and b <> ''")

    def key(x: Column, y: Column) -> Column:
        pair = F.concat(F.least(x, y), F.lit("|"), F.greatest(x, y))
        return F.struct(F.unhex(digest(pair)).alias("key"), F.xxhash64(pair).alias("check"))

    variants = [key(x, y) for x, y in product(*[(F.col(n), F.coalesce(f"{n}_sorted", n)) for n in ("a", "b")])]
    plain = F.col("a_sorted").isNull() & F.col("b_sorted").isNull()
    return base.select("row", F.when(plain, F.array(variants[0])).otherwise(F.array_distinct(F.array(*variants))).alias("keys"))


def copy_groups(df: DataFrame, row_id: str, field_a: str, field_b: str, separator: str = ";", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(row, first): every row that takes part, and the smallest id among its copies (its own if it has none).

    row_id names a unique bigint column. Two rows are copies if both fields agree in their letters and digits, in
    order, ignoring case and all else; the fields may have changed places, and parts of a field between separators may
    come in any order. Texts are brought to their consistent form first, so an accent apart from its letter, a joined
    letter or a full-width separator makes no difference; vowel signs that compose with nothing count as letters. Rows
    where either field is null or has no letter or digit take no part. Copies of copies are copies. Empty input gives
    an empty result; other columns are not read.

    A row has the key of its plain order and, if it holds a separator, those of its sorted parts: the md5 digest of the
    canonical pair (128 bits), with xxhash64 of the same text carried along as collision check: keys only count as
    equal if both agree, and hash_report() counts the keys in which they do not. Counts and smallest ids are combined
    before the shuffle, so a key of a third of all rows is one row per task; the join back leaves a hot key to skew
    splitting. Only rows with several keys can bring groups together; these links go through connected components.
    """
    rows = cut(_keyed(df, row_id, field_a, field_b, separator, digest))
    entries = rows.select("row", F.inline("keys"), (F.size("keys") > 1).alias("several"))
    groups = entries.groupBy("key", "check").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.max("several").alias("several"))
    shared = cut(groups.where("n > 1").drop("n"))
    links = entries.where("several").join(shared, ["key", "check"]).select("row", "first")
    tops = connected_components(links, "row", "first").select(F.col("node").alias("first"), "component")
    head = F.col("keys")[0]
    own = rows.select("row", head["key"].alias("key"), head["check"].alias("check")).join(shared.select("key", "check", "first"), ["key", "check"], "left")
    own = own.select("row", F.coalesce("first", "row").alias("first")).join(tops, "first", "left")
    return own.select("row", F.coalesce("component", "first").alias("first"))


def hash_report(df: DataFrame, row_id: str, field_a: str, field_b: str, separator: str = ";", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(rows, keys, collisions): rows that take part, their distinct keys in plain order, and keys that stand for different pairs."""
    head = F.col("keys")[0]
    pairs = _keyed(df, row_id, field_a, field_b, separator, digest).groupBy(head["key"].alias("key"), head["check"].alias("check")).agg(F.count("*").alias("n"))
    keys = pairs.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("checks"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("checks") > 1).alias("collisions"))


def collapse_copies(df: DataFrame, row_id: str, field_a: str, field_b: str, separator: str = ";") -> DataFrame:
    """(first, copies): one record per group, with how many rows carry it. See copy_groups."""
    return copy_groups(df, row_id, field_a, field_b, separator).groupBy("first").agg(F.count("*").alias("copies"))
