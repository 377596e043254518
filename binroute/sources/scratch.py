"""Written intermediate tables in the shared checkpoint folder.

A small table that is read several times (statistics, dictionaries, slice
totals) is written once and read back. That cuts its lineage in a way that
outlives executors, and it gives the optimizer the table's true file size, so
that Spark's own size check decides whether a join broadcasts it. A computed
aggregate has no such size: its estimate is that of the data below it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _plain(path: str) -> str:
    """A path without the ways to write a local one differently."""
    return re.sub("^file:/+", "/", path).rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one set by ``setCheckpointDir`` goes first.

    A cluster must name a folder that all its machines share. In local mode,
    where one machine does all, a temporary folder stands in.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    chosen = spark.sparkContext.getCheckpointDir()
    if configured and (not chosen or _plain(chosen).startswith(_plain(configured))):
        chosen = configured
    if spark.sparkContext.master.startswith("local"):
        if not chosen:
            chosen = tempfile.mkdtemp(prefix="binroute-")
            spark.sparkContext.setCheckpointDir(chosen)
    elif not chosen or _plain(chosen).startswith(tempfile.gettempdir()):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share, not to {chosen}")
    return chosen.rstrip("/")


def remove_scratch(spark: SparkSession) -> bool:
    """Delete what this application has written; for the end of a run, when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/binroute/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/binroute/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
