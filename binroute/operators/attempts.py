"""First attempt of each payment, and the cards behind payments.

No step here sends all rows of one ``txid`` to one task. Attempts are grouped
first, with map-side partial sums, so that what a window over ``txid`` sees is
at most one row per processor (and status) and moment; rows past the first
moment are dropped by the window group limit before the shuffle by ``txid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binroute.constants import APPROVED, DECLINED
from binroute.functions import bin_of


def is_approved() -> Column:
    return F.col("status") == APPROVED


def is_decided() -> Column:
    """Filtered attempts, other values and NULL count neither way."""
    return F.col("status").isin(APPROVED, DECLINED)


def first_times(attempts: DataFrame) -> DataFrame:
    """Earliest attempt per payment; NULL times are ignored."""
    return attempts.groupBy("txid").agg(F.min("created_datetime").alias("first_transaction_datetime"))


def keep_first(rows: DataFrame) -> DataFrame:
    """Rows at the first non-NULL moment of their payment, ties kept.

    For rows already grouped by payment, moment and processor. Rows without a
    payment number belong to no payment.
    """
    by_time = Window.partitionBy("txid").orderBy("created_datetime")
    return (
        rows.where(F.col("created_datetime").isNotNull() & F.col("txid").isNotNull())
        .withColumn("_rank", F.rank().over(by_time))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def first_attempts(attempts: DataFrame) -> DataFrame:
    """All raw rows at the first moment of their payment, ties kept.

    A join back on (payment, moment), for it can be split by the adaptive skew
    join when very many rows tie at one moment; a window could not.
    """
    firsts = first_times(attempts).select(
        "txid", F.col("first_transaction_datetime").alias("created_datetime")
    )
    return attempts.join(firsts, ["txid", "created_datetime"]).select(attempts.columns)


def first_attempt_per_processor(attempts: DataFrame) -> DataFrame:
    """One row per payment and processor among its first attempts.

    When a processor has several rows at that moment the smallest status wins.
    """
    earliest = attempts.groupBy("txid", "processor_name", "status").agg(
        F.min("created_datetime").alias("created_datetime")
    )
    return (
        keep_first(earliest)
        .groupBy("txid", "processor_name")
        .agg(F.min("status").alias("status"), F.first("created_datetime").alias("created_datetime"))
    )


def first_attempt_counts(flagged: DataFrame) -> DataFrame:
    """Counts of the first attempts per payment and processor, ties counted.

    Expects ``blacklisted``: such attempts take part in finding the first
    moment and are left out of the counts.
    """
    kept = ~F.col("blacklisted")
    per_moment = flagged.groupBy("txid", "processor_name", "created_datetime").agg(
        F.count_if(kept).alias("attempts"),
        F.count_if(kept & is_decided()).alias("total"),
        F.count_if(kept & is_approved()).alias("total_success"),
    )
    return keep_first(per_moment).where(F.col("attempts") > 0)


def cards_of(customers: DataFrame) -> DataFrame:
    """Payment and BIN of each card."""
    return customers.select("txid", bin_of(F.col("card_no")).alias("bin"))


def txn_with_bin(attempts: DataFrame, customers: DataFrame) -> DataFrame:
    """Each attempt with the BIN of each card of its payment (may fan out)."""
    return attempts.join(cards_of(customers), "txid").select("txid", "bin", "processor_name", "status")
