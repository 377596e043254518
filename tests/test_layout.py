"""Attempts by month and payment: skipped files, no shuffle by payment, same rows."""

import datetime as dt

import pytest
from helpers import tuples

from binroute.operators import approval, filters
from binroute.operators import attempts as att
from binroute.sources import layout, schemas

BUCKETS = 4


@pytest.fixture
def stored(spark, tmp_path):
    rows = [
        (i % 97 if i % 50 else None, f"P{i % 3}", ("approved", "declined", "filtered")[i % 5 % 3], None if i % 7 == 0 else "x",
         dt.datetime(2026, 1 + i % 4, 1 + i % 28, i % 3), dt.date(2026, 1 + i % 4, 1 + i % 28) if i % 31 else None)
        for i in range(800)
    ]
    attempts = spark.createDataFrame(rows, schemas.TRANSACTIONS)
    cards = spark.createDataFrame([(i, f"{400000 + i % 9}00") for i in range(97)], schemas.CUSTOMERS)
    layout.write_attempts(attempts, "t_attempts", str(tmp_path / "attempts"), BUCKETS)
    layout.write_cards(cards, "t_cards", str(tmp_path / "cards"), BUCKETS)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield attempts, cards, tmp_path
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    spark.sql("DROP TABLE IF EXISTS t_attempts")
    spark.sql("DROP TABLE IF EXISTS t_cards")


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_the_range_skips_files_and_the_join_shuffles_nothing(spark, stored, capsys):
    few = layout.read_attempts(spark, "t_attempts", "2026-02-10", "2026-03-05")
    plan = plan_of(att.txn_with_bin(few, spark.table("t_cards")), capsys)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    assert "month#" in plan[plan.index("PartitionFilters") :].splitlines()[0] and ">= 2026-02" in plan and "<= 2026-03" in plan
    assert {f.split("month=")[1][:7] for f in few.inputFiles()} == {"2026-02", "2026-03"}


def test_first_attempts_and_their_cards_meet_without_a_shuffle(spark, stored, capsys):
    ranked = approval.approval_rate_ranked(layout.read_attempts(spark, "t_attempts", "2026-02-01", "2026-03-31"), spark.table("t_cards"), "2026-02-01", "2026-03-31")
    plan = plan_of(ranked, capsys)
    # What is left is the grouping by BIN and processor and the ranking by BIN.
    assert "hashpartitioning(txid" not in plan and plan.count("Exchange hashpartitioning(bin") == 2


@pytest.mark.parametrize("start, end", [("2026-02-10", "2026-03-05"), ("2026-01-01", "2026-04-30"), ("2025-01-01", "2025-12-31")])
def test_same_rows(spark, stored, start, end):
    attempts, cards, _ = stored
    kept = layout.read_attempts(spark, "t_attempts", start, end)
    expected = filters.in_date_range(attempts, start, end)
    assert tuples(filters.in_date_range(kept, start, end)) == tuples(expected)
    ranked = approval.approval_rate_ranked(kept, spark.table("t_cards"), start, end)
    assert tuples(ranked) == tuples(approval.approval_rate_ranked(attempts, cards, start, end))
    assert tuples(layout.read_attempts(spark, "t_attempts")) == tuples(attempts)  # rows without a date too


def test_later_attempts_are_added_and_files_stay_few(spark, stored, tmp_path):
    attempts, _, _ = stored
    more = spark.createDataFrame([(5, "P9", "approved", "x", dt.datetime(2026, 2, 2), dt.date(2026, 2, 2))], schemas.TRANSACTIONS)
    layout.write_attempts(more, "t_attempts", str(tmp_path / "attempts"), BUCKETS, mode="append")
    assert tuples(layout.read_attempts(spark, "t_attempts")) == tuples(attempts.unionByName(more))
    assert len(list((tmp_path / "attempts" / "month=2026-01").glob("*.parquet"))) <= BUCKETS
    assert len(list((tmp_path / "attempts" / "month=2026-02").glob("*.parquet"))) <= BUCKETS + 1


def test_files_become_a_table_again(spark, stored, tmp_path, capsys):
    attempts, cards, _ = stored
    layout.register(spark, "t_again", str(tmp_path / "attempts"), BUCKETS)
    layout.register(spark, "t_cards_again", str(tmp_path / "cards"), BUCKETS, schemas.CUSTOMERS)
    try:
        assert tuples(layout.read_attempts(spark, "t_again")) == tuples(attempts)
        assert tuples(spark.table("t_cards_again")) == tuples(cards)
        joined = att.txn_with_bin(layout.read_attempts(spark, "t_again"), spark.table("t_cards_again"))
        assert "Exchange" not in plan_of(joined, capsys)
    finally:
        spark.sql("DROP TABLE t_again")
        spark.sql("DROP TABLE t_cards_again")
