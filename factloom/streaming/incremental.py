"""Response logs as a stream: finished items append once, rates by window of run time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from factloom.operators.state import append_batch, finished, remaining


def read_log(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def resume_into(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append what the target does not hold yet: a batch that is repeated after a failure adds nothing twice.

    Of the target only the key column is read, and of its files only the row groups that may hold keys between the
    batch's smallest and largest one. A target that is there but can't be read stops the stream.
    """
    spark = stream.sparkSession
    schema = stream.schema.simpleString()[len("struct<") : -1]

    def write(batch: DataFrame, _: int) -> None:
        ends = batch.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
        done = finished(spark, target, schema, unreadable="raise").select(key)
        if ends.low is not None:
            done = done.where(F.col(key).between(F.lit(ends.low), F.lit(ends.high)))
        append_batch(remaining(batch.dropDuplicates([key]), done, key), target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(stream: DataFrame, time: str = "run_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Responses, escalations, rescues and harms per window; rows later than `late` are left out of closed windows."""
    one = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c.removeprefix("response_"))
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a zone; the session's is taken
    sums = stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("responses"), one("response_escalated"), one("response_rescued"), one("response_hurt"))
    return sums.select(F.col("window.start").alias("window_start"), "responses", "escalated", "rescued", "hurt")
