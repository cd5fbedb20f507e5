"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    A folder of our own is made only where the setting is absent and the master is local (tests, one machine); on a
    cluster its absence is an error, as executors don't share a local folder. The result is a URI that Hadoop's file
    systems understand. Spark removes what is no longer used if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="factloom-shared-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared folder and forget how it was made; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def posix_path(uri: str) -> str | None:
    """The plain path of a file URI, or None for another file system."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def scratch_name(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark).rstrip("/"), f"{kind}-{uuid.uuid4().hex}")
