"""Shape, NULLs, duplicates and correlation of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_profile(rows: DataFrame) -> DataFrame:
    """Per column: NULLs, and the table's number of rows and columns."""
    counts = rows.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns]
    )
    return counts.unpivot("_rows", list(rows.columns), "column_name", "nulls").select(
        "column_name",
        "nulls",
        F.col("_rows").alias("row_count"),
        F.lit(len(rows.columns)).cast("long").alias("column_count"),
    )


def dedup_rows(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates()


def dedup_profile(rows: DataFrame) -> DataFrame:
    """Rows, distinct rows, and rows beyond the first copy."""
    copies = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
    )


def _pearson(a: Column, b: Column) -> Column:
    """NULL for a constant column, where ``corr`` fails in ANSI mode."""
    a, b = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def correlation(rows: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, highest first.

    A constant column has none; it comes last as NULL.
    """
    found = rows.agg(*[_pearson(F.col(c), F.col(target)).alias(c) for c in columns])
    return (
        found.select(F.lit(target).alias("target"), "*")
        .unpivot("target", list(columns), "column_name", "correlation")
        .select("column_name", "correlation")
        .orderBy(F.col("correlation").desc_nulls_last())
    )
