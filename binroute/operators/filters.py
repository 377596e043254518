"""Row filters on payment attempts and parsing of BIN input."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binroute.constants import ERROR_BLACKLIST
from binroute.functions import month_window, strip, trailing_month


def in_previous_month(attempts: DataFrame, as_of: date | str | None = None) -> DataFrame:
    return attempts.where(month_window(F.col("created_date"), as_of))


def in_trailing_month(attempts: DataFrame, as_of: date | str | None = None) -> DataFrame:
    return attempts.where(trailing_month(F.col("created_date"), as_of))


def in_date_range(attempts: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Both ends belong to the range."""
    return attempts.where(F.col("created_date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def not_in_blacklist(errors: Sequence[str] = ERROR_BLACKLIST) -> Column:
    """SQL ``NOT IN`` with a literal list: a NULL error text does not pass."""
    error = F.col("error_description")
    return error.isNotNull() & ~error.isin(*errors)


def drop_blacklisted_not_in(attempts: DataFrame, errors: Sequence[str] = ERROR_BLACKLIST) -> DataFrame:
    return attempts.where(not_in_blacklist(errors))


def drop_blacklisted_anti(attempts: DataFrame, blacklist: DataFrame) -> DataFrame:
    """SQL ``NOT EXISTS`` (or left join and ``IS NULL``): NULL errors are kept."""
    return attempts.join(blacklist.select("error_description"), "error_description", "left_anti").select(
        attempts.columns
    )


def flag_blacklisted(attempts: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Mark instead of drop; a NULL error is not blacklisted.

    Spark decides by the list's size whether to broadcast it. The rebalance
    parts the join from the aggregate, next to which frequent errors could not
    be split.
    """
    listed = blacklist.select("error_description").distinct().hint("rebalance").withColumn("_listed", F.lit(True))
    return (
        attempts.join(listed, "error_description", "left")
        .withColumn("blacklisted", F.coalesce("_listed", F.lit(False)))
        .select(*attempts.columns, "blacklisted")
    )


def blacklist_table(spark, errors: Sequence[str] = ERROR_BLACKLIST) -> DataFrame:
    return spark.createDataFrame([(e,) for e in errors], "error_description string")


# --- BIN input -----------------------------------------------------------------


def bins_from_text(texts: DataFrame, column: str = "bins") -> DataFrame:
    """One row per comma-separated token: ``token``, ``bin`` (NULL if invalid).

    A token is valid when it is six ASCII digits after stripping, so ``012345``
    gives 12345. A NULL text holds no token.
    """
    tokens = texts.select(F.explode(F.split(F.col(column), ",")).alias("token")).withColumn("token", strip("token"))
    return tokens.withColumn("bin", F.when(F.col("token").rlike("^[0-9]{6}$"), F.col("token").cast("long")))


def bins_from_column(rows: DataFrame, column: str = "BIN") -> DataFrame:
    """One row per value: ``token``, ``bin`` (NULL if invalid).

    A value is valid when it is a whole number (``510123`` or ``510123.0``)
    that has six digits without leading zeros. Signs and blanks are invalid.
    """
    token = strip(F.col(column).cast("string"))
    number = F.regexp_extract("token", r"^0*([1-9][0-9]{5})(\.0*)?$", 1)
    return rows.select(token.alias("token")).withColumn(
        "bin", F.when(number != "", F.nullif(number, F.lit("")).cast("long"))
    )


def bin_list(tokens: DataFrame) -> DataFrame:
    """The distinct valid BINs, with how often each was given."""
    return tokens.where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("times"))


def bin_counts(tokens: DataFrame) -> DataFrame:
    """One row: distinct valid BINs, repeats beyond the first, invalid tokens."""
    per_bin = tokens.groupBy("bin").agg(F.count("*").alias("n"))
    valid = F.col("bin").isNotNull()
    return per_bin.agg(
        F.count_if(valid).alias("valid"),
        F.coalesce(F.sum(F.when(valid, F.col("n") - 1)), F.lit(0)).alias("duplicate"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid"),
    )
