"""Attempts stored by month and payment, cards by payment.

Partitions by month let a date range skip files. Both tables are bucketed by
payment with the same number of buckets, so that grouping attempts by payment and
joining them with cards need no shuffle. Choose so many buckets that one month's
bucket is about a file of 128 MB; a payment lies in one bucket of its months.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binroute.sources import schemas

_NO_DATE = "none"


def _bucket(buckets: int) -> Column:
    """The bucket that Spark gives a payment."""
    return F.pmod(F.hash("txid"), F.lit(buckets))


def _month(created_date: Column) -> Column:
    return F.coalesce(F.date_format(created_date, "yyyy-MM"), F.lit(_NO_DATE))


def write_attempts(attempts: DataFrame, table: str, path: str, buckets: int, mode: str = "errorifexists") -> None:
    """Store attempts as a table; ``mode="append"`` adds new ones. Each bucket of a month is one file per call."""
    rows = attempts.withColumn("month", _month(F.col("created_date"))).repartition("month", _bucket(buckets))
    _save(rows, path, buckets, mode, ["month"]).saveAsTable(table)


def write_cards(customers: DataFrame, table: str, path: str, buckets: int, mode: str = "errorifexists") -> None:
    _save(customers.repartition(_bucket(buckets)), path, buckets, mode, []).saveAsTable(table)


def _save(rows: DataFrame, path: str, buckets: int, mode: str, by: list[str]):
    writer = rows.write.format("parquet").mode(mode).option("path", path).bucketBy(buckets, "txid").sortBy("txid")
    return writer.partitionBy(*by) if by else writer


def read_attempts(spark: SparkSession, table: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Attempts of the months that the closed date range touches; the exact dates are the caller's filter."""
    rows = spark.table(table)
    low, high = (str(d)[:7] if d else None for d in (start, end))
    if low:
        rows = rows.where((F.col("month") >= low) & (F.col("month") != _NO_DATE))
    if high:
        rows = rows.where((F.col("month") <= high) & (F.col("month") != _NO_DATE))
    return rows.drop("month")


def register(spark: SparkSession, table: str, path: str, buckets: int, schema: T.StructType = schemas.TRANSACTIONS) -> None:
    """Declare stored files as a table again, in a catalog that does not know them."""
    by_month = schema is schemas.TRANSACTIONS
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    months = ", month string) USING parquet PARTITIONED BY (month)" if by_month else ") USING parquet"
    spark.sql(
        f"CREATE TABLE {table} ({columns}{months} CLUSTERED BY (txid) SORTED BY (txid) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    if by_month:
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
