"""Resume, upsert and caches as joins and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has not been done yet. Null keys are never done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key; null keys of old stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cached_or_base(base: DataFrame, cache: DataFrame, key: str, column: str) -> DataFrame:
    """base with the cached value of a column where there is one; the cache must have a key once."""
    held = cache.select(key, F.col(column).alias("_held"))
    out = base.join(held, key, "left")
    value = F.coalesce("_held", column) if column in base.columns else F.col("_held")
    return out.withColumn(column, value).drop("_held")


def cacheable(df: DataFrame, column: str = "mutations_list") -> DataFrame:
    """Rows worth caching: a failed call's empty lists are asked again next time."""
    both = F.size(F.coalesce(F.col(column)["synonyms"], F.array().cast("array<string>"))) + F.size(F.coalesce(F.col(column)["antonyms"], F.array().cast("array<string>")))
    return df.where(F.col(column).isNotNull() & (both > 0))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap: a reader sees the old or the new one, a failed write leaves the old one."""
    spark = df.sparkSession
    new, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    df.write.mode("overwrite").parquet(new)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(Path(old), True)
    if fs.exists(Path(path)):
        fs.rename(Path(path), Path(old))
    fs.rename(Path(new), Path(path))
    fs.delete(Path(old), True)


def append_batch(df: DataFrame, path: str) -> None:
    """A checkpoint of finished items: one committed append instead of a rewrite of everything so far."""
    df.write.mode("append").parquet(path)


def finished(spark: SparkSession, path: str, schema: str, unreadable: str = "fresh") -> DataFrame:
    """What earlier runs wrote. An absent table means a fresh start, and so does a broken one, as the original runs have it.

    With unreadable="raise" a table that is there but can't be read is an error: work that appends must not take a
    failed read for an empty table.
    """
    if unreadable not in ("fresh", "raise"):
        raise ValueError(f"unreadable must be 'fresh' or 'raise', not {unreadable!r}")
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - asked for above
        if unreadable == "raise":
            raise
        return spark.createDataFrame([], schema)
