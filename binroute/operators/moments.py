"""First moments of payments as state that can be merged.

The state has, per month and payment, the attempts at the payment's first moment
in that month, counted by processor, status and blacklisting. What is first in
several months or batches is the first of their firsts, so states of parts of
the attempts merge into the state of all, in any order: attempts that arrive
late, or that are earlier than what is stored, need no look at the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binroute.constants import APPROVED, DECLINED

STATE = "month string, txid long, created_datetime timestamp_ntz, processor_name string, status string, blacklisted boolean, n long"
_ATTEMPT = ["txid", "created_datetime", "processor_name", "status", "blacklisted"]


def _first(rows: DataFrame, within: Sequence[str]) -> DataFrame:
    """Grouped rows at the first moment of each payment, ties kept and counts summed.

    As grouped rows meet the window, a payment is one row per processor, status
    and moment there, however many attempts it has; later moments go before the shuffle.
    """
    keys = [c for c in within if c != "txid"]
    grouped = rows.groupBy(*keys, *_ATTEMPT).agg(F.sum("n").alias("n"))
    by_time = Window.partitionBy(*within).orderBy("created_datetime")
    return grouped.withColumn("_rank", F.rank().over(by_time)).where(F.col("_rank") == 1).drop("_rank")


def first_moments(flagged: DataFrame) -> DataFrame:
    """The state of some attempts that say whether they are ``blacklisted``.

    Blacklisted attempts take part in finding the first moment; where they must
    not, drop them before. Attempts without a payment number, moment or date are in
    no payment, moment or month and go.
    """
    known = F.col("txid").isNotNull() & F.col("created_datetime").isNotNull() & F.col("created_date").isNotNull()
    month = F.date_format("created_date", "yyyy-MM").alias("month")
    return merged(flagged.where(known).select(month, *_ATTEMPT, F.lit(1).cast("long").alias("n")))


def merged(states: DataFrame) -> DataFrame:
    """One state of several laid under each other."""
    return _first(states, ["month", "txid"]).select("month", *_ATTEMPT, "n")


def over_months(state: DataFrame) -> DataFrame:
    """Attempts at the first moment of each payment in all months of a state."""
    return _first(state, ["txid"])


def first_times(state: DataFrame) -> DataFrame:
    """Earliest attempt per payment."""
    return state.groupBy("txid").agg(F.min("created_datetime").alias("first_transaction_datetime"))


def per_processor(state: DataFrame) -> DataFrame:
    """One row per payment and processor among its first attempts; the smallest status of several."""
    first = over_months(state)
    return first.groupBy("txid", "processor_name").agg(F.min("status").alias("status"), F.first("created_datetime").alias("created_datetime"))


def counts(state: DataFrame) -> DataFrame:
    """First attempts per payment and processor, ties counted and blacklisted ones left out."""
    kept = over_months(state).where(~F.col("blacklisted"))

    def number(*statuses: str):
        return F.sum(F.when(F.col("status").isin(*statuses), F.col("n")).otherwise(F.lit(0)))

    return kept.groupBy("txid", "processor_name").agg(
        F.sum("n").alias("attempts"), number(APPROVED, DECLINED).alias("total"), number(APPROVED).alias("total_success")
    )
