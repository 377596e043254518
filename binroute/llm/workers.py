"""Settings of a session whose Python workers run the text operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
BATCH, USUAL, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
#: Workers are kept for later tasks; with these they give memory back between batches.
ALLOCATION = {
    "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304",
}


def prepare(spark: SparkSession) -> None:
    """Put the package's folder on the path of Python workers started from now on, and keep them small.

    Texts are long: a thousand rows a batch keep a worker's memory low. A batch
    size that the session has set itself stays.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    for name, value in ALLOCATION.items():
        environment.setdefault(name, value)
    if spark.conf.get(BATCH) == USUAL:
        spark.conf.set(BATCH, ROWS)
