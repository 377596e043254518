from helpers import LATER, NOON, tuples

from binroute.operators import filters
from binroute.plans import reports


def test_reports_are_computed_once_and_agree(spark, attempts, customers):
    rows = attempts(
        (1, "A", "approved", "", NOON),
        (2, "A", "declined", "", NOON),
        (3, "X", "approved", "", NOON),
        (3, "A", "approved", "", LATER),
        (4, "B", "filtered", "", NOON),
    )
    cards = customers((1, "4000011"), (2, "4000012"), (3, "4000013"), (4, "4000024"))
    bins = spark.createDataFrame([(400001,), (400002,)], "bin long")
    report = reports.ranking_report(rows, cards, "2026-01-01", "2026-01-31", bins, ["X"])
    assert tuples(report.rows, "BIN", "Processor", "Approval Rate (%)", "Rank", "Fallback External") == [
        ("400001", "A", 50.0, 2, "No"),
        ("400001", "X", 100.0, 1, "Yes"),
        ("400002", "B", 0.0, 1, "No"),
    ]
    assert tuples(report.internal_external_summary) == [(25.0, 100.0)]
    assert tuples(report.external_counts) == [("X", 1)]
    assert tuples(report.processor_distribution, "Processor", "Total Transactions") == [("A", 2), ("B", 0), ("X", 1)]
    assert tuples(report.reranked, "Processor", "Rank") == [("A", 2), ("B", 1), ("X", 1)]

    stats = reports.pair_stats(rows, cards, filters.blacklist_table(spark), "2026-01-20")
    assert tuples(stats.poor(1, 60.0)) == [("400001", "A", 2, 1, 50.0)]
    assert [r.processor_name for r in stats.poor(1, 100.0).collect()] == ["A", "X"]
