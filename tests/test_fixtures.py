"""Input tables whose tasks do not grow with the given tables, and queries that read them once."""

import pytest
from helpers import tuples
from pyspark.sql import functions as F

import __spark_entry__ as entry
from binroute import fixtures as fx
from binroute.operators import split
from binroute.sources import readers


@pytest.fixture
def tables(spark, tmp_path):
    """Rows of the test's own: 3000 lines of 1000 orders of 50 holders."""
    line = spark.range(3000).select(
        (F.col("id") % 1000).alias("l_orderkey"), (F.col("id") % 211).alias("l_partkey"), (F.col("id") % 97).alias("l_suppkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.lit("1998-03-04").cast("timestamp_ntz").alias("l_shipdate"),
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    order = spark.range(1000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    order.write.parquet(f"{tmp_path}/orders.parquet")
    holder = spark.range(50).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("X").alias("c_mktsegment"))
    holder.write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("build", [fx.transactions, fx.training])
def test_a_task_sees_no_more_of_a_larger_table(spark, tables, monkeypatch, build):
    whole = tuples(build(spark, tables))
    monkeypatch.setattr(fx, "LINES_PER_PART", 100)
    rows = build(spark, tables)
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(counts) > 20 and max(counts) < 300
    assert tuples(rows) == whole


def test_damaged_files_follow_the_partitions(spark, tables, monkeypatch):
    monkeypatch.setattr(fx, "LINES_PER_PART", 100)
    loaded = entry._damaged_csv(spark, tables)
    assert loaded.rejects.select("file").distinct().count() > 12
    heads = loaded.rejects.where((F.col("reason") == "header") & F.col("record").startswith("project_name"))
    assert heads.count() == 3
    kept = fx.training(spark, tables).where(~(F.col("l_orderkey") % 13).isin(1, 2, 3, 4))
    assert tuples(loaded.rows) == tuples(kept.select(*loaded.rows.columns))


def test_records_are_not_dealt_by_file(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("bin,status\n1,approved\n2,declined\n")
    readers.read_csv_tolerant(spark, str(tmp_path / "t.csv"), one_line=True).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_file" not in plan


def test_split_computes_its_rows_once(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y")).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    done = split.stratified_split(rows, "y", F.xxhash64("id").bitwiseAND(0xFFFFFFFF))
    assert not set(rows.inputFiles()) & set(done.inputFiles())
    assert done.count() == 1000 and done.where("is_holdout").count() == 200
