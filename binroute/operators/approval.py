"""Approval rates per BIN and processor, and the reports built on them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binroute.constants import ERROR_BLACKLIST, POOR_MAX_RATE, POOR_MIN_ATTEMPTS
from binroute.functions import bin_of, exact_percent, strip
from binroute.operators import attempts as att
from binroute.operators import bloom, filters
from binroute.sources.scratch import materialize


# --- active BINs and processors --------------------------------------------------


def active_bins(attempts: DataFrame, customers: DataFrame, blacklist: DataFrame, as_of=None) -> DataFrame:
    """BINs with an attempt in the previous month that is not blacklisted."""
    recent = filters.drop_blacklisted_anti(filters.in_previous_month(attempts, as_of), blacklist)
    payments = recent.select("txid").distinct()
    return att.cards_of(customers).join(payments, "txid", "left_semi").select("bin").distinct()


def active_bins_legacy(
    attempts: DataFrame, customers: DataFrame, errors: Sequence[str] = ERROR_BLACKLIST, as_of=None
) -> DataFrame:
    """As above with ``NOT IN``; a payment without a card yields a NULL BIN."""
    recent = filters.drop_blacklisted_not_in(filters.in_previous_month(attempts, as_of), errors)
    payments = recent.select("txid").distinct()
    return payments.join(att.cards_of(customers), "txid", "left").select("bin").distinct()


def active_processors(attempts: DataFrame, blacklist: DataFrame, as_of=None) -> DataFrame:
    recent = filters.drop_blacklisted_anti(filters.in_previous_month(attempts, as_of), blacklist)
    return recent.select("processor_name").distinct()


def active_processors_legacy(attempts: DataFrame, errors: Sequence[str] = ERROR_BLACKLIST, as_of=None) -> DataFrame:
    recent = filters.drop_blacklisted_not_in(filters.in_previous_month(attempts, as_of), errors)
    return recent.select("processor_name").distinct()


# --- BIN-processor statistics ----------------------------------------------------


def _rates(first: DataFrame, cards: DataFrame, processor: str, rate: str, digits: int) -> DataFrame:
    """Sum counted first attempts over the cards of their payments.

    Raw rows meet in the join, which the adaptive skew join can split.
    """
    counts = (
        first.join(cards, "txid")
        .groupBy("bin", F.col("processor_name").alias(processor))
        .agg(F.sum("total").alias("total"), F.sum("total_success").alias("total_success"))
    )
    return counts.withColumn(rate, exact_percent(F.col("total_success"), F.col("total"), digits))


def bin_processor_stats(
    attempts: DataFrame, customers: DataFrame, blacklist: DataFrame, as_of: date | str | None = None
) -> DataFrame:
    """Approval of first attempts since one month before ``as_of``.

    The first attempt is found before the blacklist applies, so a payment that
    first failed for a blacklisted reason is out. Attempts tied at the first
    moment all count. NULL errors are kept.
    """
    flagged = filters.flag_blacklisted(filters.in_trailing_month(attempts, as_of), blacklist)
    return stats_of_first(att.first_attempt_counts(flagged), customers)


def stats_of_first(first: DataFrame, customers: DataFrame) -> DataFrame:
    """Statistics from the counts of first attempts per payment and processor."""
    return _rates(first, att.cards_of(customers), "processor_name", "approval_rate", 4)


def bin_processor_stats_legacy(
    attempts: DataFrame,
    customers: DataFrame,
    errors: Sequence[str] = ERROR_BLACKLIST,
    as_of: date | str | None = None,
) -> DataFrame:
    """As above, with ``NOT IN``: attempts with a NULL error are left out too."""
    recent = filters.in_trailing_month(attempts, as_of)
    flagged = recent.withColumn("blacklisted", ~filters.not_in_blacklist(errors))
    return stats_of_first(att.first_attempt_counts(flagged), customers)


def poor_pairs(
    stats: DataFrame, min_attempts: int = POOR_MIN_ATTEMPTS, max_rate: float = POOR_MAX_RATE
) -> DataFrame:
    """Pairs with enough attempts and a low rate; a NULL rate is never poor."""
    return stats.where((F.col("approval_rate") <= max_rate) & (F.col("total") >= min_attempts)).select(
        "bin",
        "processor_name",
        "total",
        "total_success",
        F.col("approval_rate").alias("approval_rate_percent"),
    )


# --- ranking ---------------------------------------------------------------------


def _rank(rates: DataFrame) -> DataFrame:
    """Dense rank per BIN by rounded rate; a NULL rate ranks first."""
    by_rate = Window.partitionBy("bin").orderBy(F.col("ar").desc_nulls_first())
    return rates.withColumn("rnk", F.dense_rank().over(by_rate).cast("long"))


def _listed_cards(customers: DataFrame, bins: DataFrame | Sequence | None) -> DataFrame:
    """Cards of the wanted BINs; a list and a frame with the same values give the same.

    BINs are compared as text, numbers in their shortest form. Wanted BINs and
    the cards found are written, so joins know their sizes.
    """
    cards = att.cards_of(customers)
    if bins is None:
        return cards
    if not isinstance(bins, DataFrame):
        return materialize(cards.where(F.col("bin").isin(*[str(b) for b in bins])), "cards")
    wanted = bins.select(F.col("bin").cast("string").alias("bin")).where(F.col("bin").isNotNull()).distinct()
    return materialize(cards.join(materialize(wanted, "bins"), "bin", "left_semi"), "cards")


def approval_rate_ranked(
    attempts: DataFrame,
    customers: DataFrame,
    start: date | str,
    end: date | str,
    bins: DataFrame | Sequence[str] | None = None,
    processors: Sequence[str] | None = None,
    errors: Sequence[str] = ERROR_BLACKLIST,
) -> DataFrame:
    """Processors of each BIN ranked by approval of first attempts.

    The blacklist applies before the first attempt is found (``NOT IN``: NULL
    errors are out), and a processor counts once per payment. ``bins`` and
    ``processors`` restrict the result; None keeps all.
    """
    cards = _listed_cards(customers, bins)
    usable = filters.drop_blacklisted_not_in(filters.in_date_range(attempts, start, end), errors)
    if bins is not None:
        # First attempts are found per payment, so payments of other BINs can go
        # before any attempt is shuffled for that purpose; most go at the scan.
        usable = bloom.only_possible(usable, "txid", cards.select("txid")).join(cards, "txid", "left_semi")
    return _ranked_first(att.first_attempt_per_processor(usable), cards, processors)


def rank_first(
    first: DataFrame, customers: DataFrame, bins: DataFrame | Sequence[str] | None = None, processors: Sequence[str] | None = None
) -> DataFrame:
    """The ranking from first attempts, one per payment and processor, that are found already."""
    return _ranked_first(first, _listed_cards(customers, bins), processors)


def _ranked_first(first: DataFrame, cards: DataFrame, processors: Sequence[str] | None) -> DataFrame:
    if processors is not None:
        first = first.where(F.col("processor_name").isin(*processors))
    counted = first.select(
        "txid",
        "processor_name",
        att.is_decided().cast("long").alias("total"),
        att.is_approved().cast("long").alias("total_success"),
    ).na.fill(0, ["total", "total_success"])
    return _rank(_rates(counted, cards, "processor", "ar", 3))


def approval_rate_legacy(
    attempts: DataFrame,
    customers: DataFrame,
    start: date | str,
    end: date | str,
    bins: DataFrame | Sequence[str] | None = None,
    errors: Sequence[str] = ERROR_BLACKLIST,
) -> DataFrame:
    """The ranking without de-duplication.

    Date range and blacklist only find the first moment; then every attempt of
    the payment at that moment counts, blacklisted or not, unless its processor
    is NULL.
    """
    cards = _listed_cards(customers, bins)
    if bins is not None:
        attempts = bloom.only_possible(attempts, "txid", cards.select("txid")).join(cards, "txid", "left_semi")
    usable = filters.drop_blacklisted_not_in(filters.in_date_range(attempts, start, end), errors)
    moments = att.first_times(usable).withColumnRenamed("first_transaction_datetime", "created_datetime")
    # Raw attempts meet the moments first: the rest of the history is not shuffled for the counts.
    first = (
        attempts.where(F.col("processor_name").isNotNull())
        .join(moments, ["txid", "created_datetime"])
        .groupBy("txid", "processor_name")
        .agg(F.count_if(att.is_decided()).alias("total"), F.count_if(att.is_approved()).alias("total_success"))
    )
    return _rank(_rates(first, cards, "processor", "ar", 3))


# --- orders of the results ---------------------------------------------------------
# Results are sets; these put them in the order in which they are shown.


def by_rank(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy("bin", "rnk")


def by_bin(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("bin"))


def worst_first(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("approval_rate_percent")


def most_first(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("Count"))


# --- report on the ranking -------------------------------------------------------


def report_ranked(ranked: DataFrame, external: Sequence[str]) -> DataFrame:
    """The ranking under report names, with NULLs filled after ranking."""
    return (
        # The names of the report.
        ranked.withColumnsRenamed(
            {
                "bin": "BIN",
                "processor": "Processor",
                "total": "Total Transactions",
                "total_success": "Total Success",
                "ar": "Approval Rate (%)",
                "rnk": "Rank",
            }
        )
        .withColumn("BIN", strip(F.col("BIN").cast("long").cast("string")))
        .withColumn("Processor", strip("Processor"))
        .withColumn("Fallback External", F.when(F.col("Processor").isin(*external), "Yes").otherwise("No"))
        .na.fill(0.0, ["Approval Rate (%)"])
        .na.fill(0, ["Total Transactions", "Total Success"])
    )


def report_reranked(report: DataFrame) -> DataFrame:
    """Ranks taken again after NULL rates became 0."""
    by_rate = Window.partitionBy("BIN").orderBy(F.desc("Approval Rate (%)"))
    return report.withColumn("Rank", F.dense_rank().over(by_rate).cast("long"))


def processor_distribution(report: DataFrame) -> DataFrame:
    return report.groupBy("Processor", "Fallback External", "Total Transactions").agg(
        F.avg("Approval Rate (%)").alias("Approval Rate (%)")
    )


def external_counts(report: DataFrame) -> DataFrame:
    return report.where(F.col("Fallback External") == "Yes").groupBy("Processor").agg(F.count("*").alias("Count"))


def internal_external_summary(report: DataFrame) -> DataFrame:
    """Mean rate of internal and of external rows; 0 where there are none."""
    rate, outside = F.col("Approval Rate (%)"), F.col("Fallback External") == "Yes"
    return report.agg(
        F.coalesce(F.avg(F.when(~outside, rate)), F.lit(0.0)).alias("avg_internal"),
        F.coalesce(F.avg(F.when(outside, rate)), F.lit(0.0)).alias("avg_external"),
    )
