"""The corpus pipeline: from documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. Stages filter or edit what their predecessor kept:

1. language: texts in none of the languages go;
2. quality: texts that importance resampling does not choose go;
3. near-duplicates: one document of each class stays;
4. passages: repeated passages are cut from all but one text;
5. packing: token pieces placed in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binroute.llm import language, near_duplicates, passages, registry, resampling, workers
from binroute.llm.columns import set_aside
from binroute.sources.scratch import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in an accepted language. Null, empty and letterless texts go; a null
    ``lang`` or ``source`` is no evidence. Repeated rows share their fate, ties go to the
    earlier language, long texts are read whole. No rows: no rows. All columns stay."""
    workers.prepare(spark)
    narrow, back = set_aside(docs, ["text", "lang", "source"])
    rows = language.document_evidence(narrow)
    return back(language.identify(rows, language.fit(rows)).where("kept"))


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling chooses. A null or empty text has weight 0 and is judged like
    others; rows that tie with the last chosen one stay, equal rows share their fate. Without
    usable labels every row stays. No rows: no rows. All columns stay."""
    workers.prepare(spark)
    labels = registry.table(spark, sf_dir, "labels")
    return resampling.fit(docs, labels, F.col("quality") == 1)[0].keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the least id; of equal rows one. Null and
    empty texts are one class. No rows: no rows. All columns stay."""
    workers.prepare(spark)
    return near_duplicates.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that another text keeps; ``n_chars`` is counted anew where there is such a column.

    A row left without a word goes; null, empty and blank texts stay. Of equal long texts the
    rows of the least id stay. No rows: no rows. All other columns stay."""
    workers.prepare(spark)
    left = passages.remove(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences. A null or empty text is its end id alone; repeated rows are
    packed as often as they stand; long texts are cut into several pieces. No rows: no pieces."""
    workers.prepare(spark)
    return registry.packed(docs)


STAGES = [
    ("language", identify_language),
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Neither hashing, alignment nor packing can be written in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
