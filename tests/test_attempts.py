"""Edge cases of filters, first attempts and approval rates."""

import datetime as dt

import pytest
from helpers import LATER, NOON, tuples

from binroute.constants import ERROR_BLACKLIST
from binroute.operators import approval, filters
from binroute.operators import attempts as att

OK, BAD, HONOR = "approved", "declined", "Do not honor"
JANUARY = ("2026-01-01", "2026-01-31")


def test_null_error_is_dropped_by_not_in_and_kept_by_anti_join(spark, attempts):
    rows = attempts((1, "A", OK, None, NOON), (2, "A", BAD, "Expired card", NOON), (3, "A", BAD, HONOR, NOON))
    assert tuples(filters.drop_blacklisted_not_in(rows), "txid") == [(3,)]
    assert tuples(filters.drop_blacklisted_anti(rows, filters.blacklist_table(spark)), "txid") == [(1,), (3,)]


def test_blacklist_has_35_entries():
    assert len(set(ERROR_BLACKLIST)) == 35


def test_first_attempt_blacklisted(spark, attempts, customers):
    rows = attempts((1, "A", BAD, "Expired card", NOON), (1, "B", OK, HONOR, LATER))
    cards = customers((1, "4000011111"))
    ranked = approval.approval_rate_ranked(rows, cards, *JANUARY)
    assert tuples(ranked) == [("400001", "B", 1, 1, 100.0, 1)]
    stats = approval.bin_processor_stats(rows, cards, filters.blacklist_table(spark), "2026-01-20")
    assert tuples(stats) == []


def test_processors_tied_at_first_time_are_both_kept(attempts):
    rows = attempts((1, "A", BAD, HONOR, NOON), (1, "B", OK, HONOR, NOON), (1, "C", OK, HONOR, LATER))
    assert tuples(att.first_attempts(rows), "processor_name") == [("A",), ("B",)]
    assert tuples(att.first_attempt_per_processor(rows), "processor_name") == [("A",), ("B",)]


def test_same_processor_twice_at_first_time(spark, attempts, customers):
    rows = attempts((1, "A", BAD, HONOR, NOON), (1, "A", OK, HONOR, NOON))
    cards = customers((1, "4000011111"))
    assert tuples(att.first_attempt_per_processor(rows), "txid", "processor_name", "status") == [(1, "A", OK)]
    assert tuples(approval.approval_rate_ranked(rows, cards, *JANUARY), "total", "total_success") == [(1, 1)]
    stats = approval.bin_processor_stats(rows, cards, filters.blacklist_table(spark), "2026-01-20")
    assert tuples(stats, "total", "total_success", "approval_rate") == [(2, 1, 50.0)]


def test_null_time_never_wins(attempts):
    rows = attempts((1, "A", BAD, HONOR, None), (1, "B", OK, HONOR, NOON), (2, "C", OK, HONOR, None))
    assert tuples(att.first_attempts(rows), "processor_name") == [("B",)]
    assert tuples(att.first_attempt_per_processor(rows), "processor_name") == [("B",)]


def test_pair_with_only_filtered_attempts(spark, attempts, customers):
    rows = attempts(
        (1, "A", "filtered", HONOR, NOON), (2, "B", OK, HONOR, NOON), (3, "C", BAD, HONOR, NOON)
    )
    cards = customers((1, "4000011"), (2, "4000012"), (3, "4000013"))
    ranked = approval.approval_rate_ranked(rows, cards, *JANUARY)
    assert tuples(ranked, "processor", "total", "ar", "rnk") == [
        ("A", 0, None, 1),
        ("B", 1, 100.0, 2),
        ("C", 1, 0.0, 3),
    ]
    report = approval.report_ranked(ranked, ["C"])
    assert tuples(report, "Processor", "Approval Rate (%)", "Rank", "Fallback External") == [
        ("A", 0.0, 1, "No"),
        ("B", 100.0, 2, "No"),
        ("C", 0.0, 3, "Yes"),
    ]
    assert tuples(approval.report_reranked(report), "Processor", "Rank") == [("A", 2), ("B", 1), ("C", 2)]
    stats = approval.bin_processor_stats(rows, cards, filters.blacklist_table(spark), "2026-01-20")
    assert tuples(approval.poor_pairs(stats, 0, 90.0), "processor_name") == [("C",)]


def test_other_and_null_status_count_neither_way(attempts, customers):
    rows = attempts((1, "A", "pending", HONOR, NOON), (2, "A", None, HONOR, NOON), (3, "A", OK, HONOR, NOON))
    cards = customers((1, "4000011"), (2, "4000012"), (3, "4000013"))
    ranked = approval.approval_rate_ranked(rows, cards, *JANUARY)
    assert tuples(ranked, "total", "total_success") == [(1, 1)]


def test_short_card_and_two_cards(attempts, customers):
    rows = attempts((1, "A", OK, HONOR, NOON))
    cards = customers((1, "4012"), (1, "4000011"), (1, "4000012"))
    ranked = approval.approval_rate_ranked(rows, cards, *JANUARY)
    assert tuples(ranked, "bin", "total") == [("400001", 2), ("4012", 1)]
    assert tuples(att.txn_with_bin(rows, cards), "bin") == [("400001",), ("400001",), ("4012",)]


def test_date_ranges_are_closed_or_half_open(attempts):
    days = [dt.date(2025, 12, 31), dt.date(2026, 1, 1), dt.date(2026, 1, 31), dt.date(2026, 2, 1)]
    rows = attempts(*[(i, "A", OK, HONOR, NOON, d) for i, d in enumerate(days)])
    assert tuples(filters.in_date_range(rows, *JANUARY), "txid") == [(1,), (2,)]
    assert tuples(filters.in_previous_month(rows, "2026-02-28"), "txid") == [(1,), (2,)]
    assert tuples(filters.in_previous_month(rows, "2026-03-31"), "txid") == [(3,)]
    assert tuples(filters.in_trailing_month(rows, "2026-02-28"), "txid") == [(2,), (3,)]
    # A month before the 31st of March is the end of February.
    assert tuples(filters.in_trailing_month(rows, "2026-03-01"), "txid") == [(3,)]


def test_bin_and_processor_restrictions(spark, attempts, customers):
    rows = attempts((1, "A", OK, HONOR, NOON), (2, "A", BAD, HONOR, NOON), (2, "B", OK, HONOR, NOON))
    cards = customers((1, "4000011"), (2, "4000022"))
    listed = approval.approval_rate_ranked(rows, cards, *JANUARY, bins=["400002"])
    frame = spark.createDataFrame([(400002,), (400002,), (7,)], "bin long")
    framed = approval.approval_rate_ranked(rows, cards, *JANUARY, bins=frame)
    assert tuples(listed) == tuples(framed) == [("400002", "A", 1, 0, 0.0, 2), ("400002", "B", 1, 1, 100.0, 1)]
    only_b = approval.approval_rate_ranked(rows, cards, *JANUARY, processors=["B"])
    assert tuples(only_b, "bin", "processor") == [("400002", "B")]
    assert tuples(approval.approval_rate_ranked(rows, cards, *JANUARY, bins=[])) == []


def test_bins_are_compared_as_text(spark, attempts, customers):
    rows = attempts(*[(i, "A", OK, HONOR, NOON) for i in range(1, 5)])
    cards = customers((1, "01234567"), (2, "AB12CD9"), (3, "40"), (4, "4000011"))
    wanted = ["012345", "AB12CD", "40", None, "12345"]
    frame = spark.createDataFrame([(b,) for b in wanted], "bin string")
    listed = approval.approval_rate_ranked(rows, cards, *JANUARY, bins=wanted[:3])
    assert tuples(listed, "bin") == [("012345",), ("40",), ("AB12CD",)]
    assert tuples(approval.approval_rate_ranked(rows, cards, *JANUARY, bins=frame)) == tuples(listed)
    assert tuples(approval.approval_rate_legacy(rows, cards, *JANUARY, bins=frame)) == tuples(listed)


def test_attempts_without_a_payment_are_left_out(attempts):
    rows = attempts((None, "A", OK, HONOR, NOON), (1, "A", OK, HONOR, NOON))
    assert tuples(att.first_attempt_per_processor(rows), "txid") == [(1,)]
    assert tuples(att.first_attempts(rows), "txid") == [(1,)]


def test_orders(spark):
    rows = spark.createDataFrame([("2", 1, None), ("1", 2, 5.0), ("1", 1, 7.0), ("3", 1, 9.0)], "bin string, rnk long, ar double")
    assert [(r.bin, r.rnk) for r in approval.by_rank(rows).collect()] == [("1", 1), ("1", 2), ("2", 1), ("3", 1)]
    assert [r.bin for r in approval.by_bin(rows.select("bin").distinct()).collect()] == ["3", "2", "1"]
    poor = rows.withColumnRenamed("ar", "approval_rate_percent")
    assert [r.approval_rate_percent for r in approval.worst_first(poor).collect()] == [None, 5.0, 7.0, 9.0]
    counts = rows.withColumnRenamed("rnk", "Count")
    assert approval.most_first(counts).first()["Count"] == 2


def test_legacy_counts_blacklisted_attempts_at_the_first_moment(attempts, customers):
    rows = attempts(
        (1, "A", BAD, "Expired card", NOON),
        (1, "B", OK, HONOR, NOON),
        (1, "B", BAD, HONOR, NOON),
        (1, None, OK, HONOR, NOON),
        (1, "C", OK, HONOR, LATER),
    )
    legacy = approval.approval_rate_legacy(rows, customers((1, "4000011")), *JANUARY)
    assert tuples(legacy, "processor", "total", "total_success", "ar", "rnk") == [
        ("A", 1, 0, 0.0, 2),
        ("B", 2, 1, 50.0, 1),
    ]


def test_active_lists(spark, attempts, customers):
    rows = attempts(
        (1, "A", OK, None, NOON), (2, "B", BAD, "Lost Card", NOON), (3, "C", OK, HONOR, NOON), (4, "D", OK, HONOR, NOON)
    )
    cards = customers((1, "4000011"), (2, "4000022"), (3, "4000033"))
    listed = filters.blacklist_table(spark)
    assert tuples(approval.active_bins(rows, cards, listed, "2026-02-10")) == [("400001",), ("400003",)]
    assert tuples(approval.active_bins_legacy(rows, cards, as_of="2026-02-10")) == [("400003",), (None,)]
    assert tuples(approval.active_processors(rows, listed, "2026-02-10")) == [("A",), ("C",), ("D",)]
    assert tuples(approval.active_processors_legacy(rows, as_of="2026-02-10")) == [("C",), ("D",)]


@pytest.mark.parametrize(
    "success, total, digits, expected",
    [(1, 3, 4, 33.3333), (2, 3, 3, 66.667), (1, 16000, 4, 0.0063), (1, 200000, 3, 0.001), (0, 0, 3, None), (5, 5, 4, 100.0)],
)
def test_percent_rounds_half_up_exactly(spark, success, total, digits, expected):
    from pyspark.sql import functions as F

    from binroute.functions import exact_percent

    row = spark.createDataFrame([(success, total)], "s long, t long")
    assert row.select(exact_percent(F.col("s"), F.col("t"), digits)).first()[0] == expected


def test_summary_of_an_empty_side_is_zero(attempts, customers):
    rows = attempts((1, "A", OK, HONOR, NOON))
    ranked = approval.approval_rate_ranked(rows, customers((1, "4000011")), *JANUARY)
    summary = approval.internal_external_summary(approval.report_ranked(ranked, []))
    assert tuples(summary) == [(100.0, 0.0)]


def test_report_normalises_bin_and_processor(attempts, customers):
    rows = attempts((1, " A\t", OK, HONOR, NOON))
    report = approval.report_ranked(
        approval.approval_rate_ranked(rows, customers((1, "0123456")), *JANUARY), ["A"]
    )
    assert tuples(report, "BIN", "Processor", "Fallback External") == [("12345", "A", "Yes")]


def test_bin_text(spark):
    texts = spark.createDataFrame([("510123, 462263,510123,abc,12345",)], "bins string")
    tokens = filters.bins_from_text(texts)
    assert tuples(filters.bin_counts(tokens)) == [(2, 1, 2)]
    assert tuples(filters.bin_list(tokens)) == [(462263, 1), (510123, 2)]
    leading = filters.bins_from_text(spark.createDataFrame([("012345,",)], "bins string"))
    assert tuples(leading, "token", "bin") == [("", None), ("012345", 12345)]


def test_bin_column(spark):
    values = ["510123", "510123.0", "012345", "0510123", "-51012", "51012x", "", None, "5101234", "510123.5", " 462263 "]
    tokens = filters.bins_from_column(spark.createDataFrame([(v,) for v in values], "BIN string"))
    assert tuples(filters.bin_list(tokens)) == [(462263, 1), (510123, 3)]
    assert tuples(filters.bin_counts(tokens)) == [(2, 2, 7)]
