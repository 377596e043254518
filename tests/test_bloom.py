"""The Bloom filter in front of exact joins."""

import pytest
from helpers import DAY, NOON, tuples
from pyspark.sql import functions as F

from binroute.operators import approval, bloom


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_no_key_is_lost_and_few_others_stay(spark, n):
    keys = spark.range(n).select((F.col("id") * 37 - 900).alias("k"))
    rows = spark.range(-3000, 40000).select(F.col("id").alias("value"), F.lit("x").alias("k"))
    passed = bloom.only_possible(rows, "value", keys)
    assert passed.columns == rows.columns
    wanted = {r["k"] for r in keys.collect()} & set(range(-3000, 40000))
    found = {r["value"] for r in passed.select("value").collect()}
    assert wanted <= found and len(found - wanted) <= 0.1 * 43000
    assert n or not found


def test_strings_and_nulls(spark):
    keys = spark.createDataFrame([("a",), (None,), ("c",)], "k string")
    rows = spark.createDataFrame([("a",), (None,), ("b",), ("c",)], "v string")
    assert {("a",), ("c",)} <= set(tuples(bloom.only_possible(rows, "v", keys)))
    assert (None,) not in tuples(bloom.only_possible(rows, "v", keys))


def test_size_is_bounded(spark):
    assert bloom.size_for(0) == bloom.size_for(8) == 64 and bloom.size_for(9) == 128
    assert bloom.size_for(bloom.MOST_BITS // bloom.BITS_PER_KEY) == bloom.MOST_BITS
    assert bloom.size_for(bloom.MOST_BITS // bloom.BITS_PER_KEY + 1) is None
    rows = spark.range(5)
    assert bloom.only_possible(rows, "id", rows, n_keys=1 << 40) is rows


def test_the_filter_lies_below_the_exchange(spark, attempts, customers, tmp_path, capsys):
    """Attempts of other BINs are dropped in the stage that scans them; the exact semi-join stays."""
    many = attempts(*[(i, f"P{i % 3}", "approved", "x", NOON, DAY) for i in range(4000)])
    many.write.parquet(str(tmp_path / "attempts"))
    cards = customers(*[(i, f"{400000 + i % 100}0000") for i in range(4000)])
    stored = spark.read.parquet(str(tmp_path / "attempts"))
    wanted = spark.createDataFrame([("400007",)], "bin string")
    ranked = approval.approval_rate_ranked(stored, cards, "2026-01-01", "2026-01-31", bins=wanted)
    ranked.explain()
    plan = capsys.readouterr().out
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet [" in line and "processor_name" in line)
    test = max(i for i, line in enumerate(lines[:scan]) if "Filter" in line and "shiftright(" in line)
    semi = max(i for i, line in enumerate(lines[:test]) if "LeftSemi" in line)
    assert semi < test < scan and "subquery" in lines[test]
    assert not any("Exchange hashpartitioning" in line for line in lines[test:scan])
    assert tuples(ranked, "bin", "total") == tuples(
        approval.approval_rate_ranked(stored, cards, "2026-01-01", "2026-01-31").where("bin = '400007'"), "bin", "total"
    )


def test_fewer_rows_are_shuffled(spark):
    keys = spark.range(0, 100000, 1000).toDF("k")
    rows = spark.range(100000).select(F.col("id").alias("txid"))
    passed = bloom.only_possible(rows, "txid", keys)
    assert passed.count() <= 0.1 * rows.count() and passed.join(keys, F.col("txid") == F.col("k"), "left_semi").count() == 100
