"""Loaders for tables, files, dictionaries and saved runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binroute.operators.filters import bins_from_column
from binroute.sources import schemas
from binroute.sources.scratch import materialize


# Texts that a CSV cell without a value may hold.
CSV_NULLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: str | int,
    upper: str | int,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database table in parallel ranges of ``partition_column``.

    The bounds only shape the ranges; rows outside them are read as well.
    Filters and column choices are pushed into the database.
    """
    options = {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }
    return spark.read.format("jdbc").options(**options, **dict(properties or {})).load()


def read_csv(spark: SparkSession, path: str, one_line: bool) -> DataFrame:
    """All columns of CSV files as text, read exactly or not at all.

    Quotes are doubled inside quoted fields. A row with more or fewer fields than
    the header, and a file whose header differs from the first file's, raise.
    An empty text is NULL, quoted or not.
    Quoted fields may hold line breaks; files without any can be read with
    ``one_line``, which lets Spark split them.
    """
    options = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "multiLine": not one_line}
    names = spark.read.options(**options, inferSchema=False).csv(path).columns
    text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.read.schema(text).options(**options, mode="FAILFAST", enforceSchema=False).csv(path)


def read_training_csv(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """Training rows from CSV with a header; columns in any order, others ignored."""
    rows = read_csv(spark, path, one_line)
    missing = [c for c in schemas.TRAINING.names if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    valued = rows.select(
        *[F.when(~F.col(c).isin(*CSV_NULLS), F.col(c)).alias(c) for c in schemas.TRAINING.names]
    )
    # A column with NULLs may have been written as decimals: 510123.0
    return valued.withColumn("bin", F.col("bin").cast("double").cast("long"))


@dataclass(frozen=True)
class Loaded:
    """What a tolerant load has read: good rows, and ``(file, reason, record)`` of the others."""

    rows: DataFrame
    rejects: DataFrame

    @property
    def reject_counts(self) -> DataFrame:
        return self.rejects.groupBy("file", "reason").agg(F.count("*").alias("records"))


class TooManyRejects(ValueError):
    pass


#: Why a record is no row: its file has another header, it has more or fewer fields than the header, its BIN is no number.
OTHER_HEADER, OTHER_LENGTH, BAD_BIN = "header", "fields", "bin"


def read_csv_tolerant(spark: SparkSession, path: str, columns: Sequence[str] | None = None, one_line: bool = False) -> DataFrame:
    """All records of CSV files as text, with ``_file``, ``_reason`` and ``_record`` (NULL for good rows), written.

    The header is that of the first file unless ``columns`` names it. Every file
    is read once and without its header being taken for granted: the line that
    equals the header is dropped, and a file without such a line is rejected as a
    whole, its own header line included.
    """
    options = {"quote": '"', "escape": '"', "encoding": "UTF-8", "multiLine": not one_line}
    names = list(columns or spark.read.options(**options, header=True, inferSchema=False).csv(path).columns)
    text = T.StructType([T.StructField(name, T.StringType()) for name in [*names, "_broken"]])
    raw = spark.read.schema(text).options(**options, header=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").csv(path)
    is_header = F.lit(True)
    for name in names:
        is_header = is_header & F.col(f"`{name}`").eqNullSafe(F.lit(name))
    fields = [F.col(f"`{name}`") for name in names]
    found = materialize(raw.select(*fields, "_broken", F.col("_metadata.file_path").alias("_file"), is_header.alias("_header")), "csv")
    # Written, so that the join knows how few they are: dealt by file, all lines of a file would meet in one task.
    headed = materialize(found.where("_header").select("_file").distinct().withColumn("_headed", F.lit(True)), "headed")
    reason = F.when(F.col("_headed").isNull(), OTHER_HEADER).when(F.col("_broken").isNotNull(), OTHER_LENGTH)
    judged = found.where("NOT _header").join(headed, "_file", "left").withColumn("_reason", reason)
    return judged.select(*fields, "_file", "_reason", F.coalesce("_broken", F.to_csv(F.struct(*fields))).alias("_record"))


def read_training_csv_tolerant(
    spark: SparkSession, path: str, max_share: float = 0.01, columns: Sequence[str] | None = None, one_line: bool = False
) -> Loaded:
    """As ``read_training_csv``, but a record that cannot be read becomes a row of a table of rejects.

    Raises ``TooManyRejects`` if more than ``max_share`` of the records are such.
    """
    records = read_csv_tolerant(spark, path, columns, one_line)
    missing = [c for c in schemas.TRAINING.names if c not in records.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    valued = [F.when(~F.col(c).isin(*CSV_NULLS), F.col(c)).alias(c) for c in schemas.TRAINING.names]
    read = records.select(*valued, "_file", "_reason", "_record")
    number = F.expr("try_cast(try_cast(bin AS double) AS long)")
    bad = F.col("bin").isNotNull() & number.isNull()
    read = read.withColumn("_reason", F.coalesce("_reason", F.when(bad, BAD_BIN))).withColumn("bin", number)
    read = materialize(read, "training")
    counts = read.groupBy("_reason").count().collect()  # one row per reason
    every, rejected = sum(r["count"] for r in counts), {r["_reason"]: r["count"] for r in counts if r["_reason"]}
    if sum(rejected.values()) > max_share * every:
        raise TooManyRejects(f"{sum(rejected.values())} of {every} records of {path} cannot be read: {rejected}")
    good = read.where(F.col("_reason").isNull()).select(*schemas.TRAINING.names)
    bad_rows = read.where(F.col("_reason").isNotNull())
    return Loaded(good, bad_rows.select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.col("_record").alias("record")))


def read_bin_csv(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """Tokens and BINs of the column ``BIN`` of a CSV file."""
    rows = read_csv(spark, path, one_line)
    if "BIN" not in rows.columns:
        raise ValueError(f"{path} has no column BIN")
    return bins_from_column(rows, "BIN")


def read_dictionary_json(spark: SparkSession, path: str, column_name: str) -> DataFrame:
    """One JSON object ``{category: code}``; a missing file is an empty dictionary.

    Anything else than such an object raises when the dictionary is read.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.DICTIONARY)
    entries = F.from_json("value", "map<string,int>", {"mode": "FAILFAST"})
    broken = F.raise_error(F.lit(f"{path} is not an object of categories and codes"))
    codes = F.coalesce(entries, broken.cast("map<string,int>"))
    rows = spark.read.text(path, wholetext=True).select(F.explode(codes).alias("category", "code"))
    return rows.select(
        F.lit(column_name).alias("column_name"),
        "category",
        F.coalesce("code", F.raise_error(F.concat(F.lit("no code for "), "category")).cast("int")).alias("code"),
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
