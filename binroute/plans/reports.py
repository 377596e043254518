"""The two reports: ranking with its summaries, and poor pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from binroute.constants import ERROR_BLACKLIST
from binroute.operators import approval
from binroute.sources.scratch import materialize


@dataclass(frozen=True)
class RankingReport:
    """One row per BIN and processor, and what is derived from those rows."""

    rows: DataFrame

    @property
    def processor_distribution(self) -> DataFrame:
        return approval.processor_distribution(self.rows)

    @property
    def external_counts(self) -> DataFrame:
        return approval.most_first(approval.external_counts(self.rows))

    @property
    def internal_external_summary(self) -> DataFrame:
        return approval.internal_external_summary(self.rows)

    @property
    def reranked(self) -> DataFrame:
        return approval.report_reranked(self.rows)


def ranking_report(
    attempts: DataFrame,
    customers: DataFrame,
    start: date | str,
    end: date | str,
    bins: DataFrame | Sequence[str],
    external: Sequence[str],
    errors: Sequence[str] = ERROR_BLACKLIST,
) -> RankingReport:
    """The report for some BINs, computed once and written for its summaries."""
    ranked = approval.approval_rate_ranked(attempts, customers, start, end, bins, errors=errors)
    return RankingReport(materialize(approval.report_ranked(ranked, external), "report"))


@dataclass(frozen=True)
class PairStats:
    """Written statistics per BIN and processor, for any number of criteria."""

    rows: DataFrame

    def poor(self, min_attempts: int, max_rate: float) -> DataFrame:
        return approval.worst_first(approval.poor_pairs(self.rows, min_attempts, max_rate))


def pair_stats(
    attempts: DataFrame, customers: DataFrame, blacklist: DataFrame, as_of: date | str | None = None
) -> PairStats:
    return PairStats(materialize(approval.bin_processor_stats(attempts, customers, blacklist, as_of), "pair-stats"))
