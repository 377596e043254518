"""The input tables of FIXTURES.md, derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binroute.constants import ERROR_BLACKLIST

AS_OF = "2001-06-15"
EXTERNAL = ("EXT-0", "EXT-1")
PROCESSOR_SEED = {"PROC-02": 0, "PROC-03": 1, "EXT-0": 4}
#: Lines in one partition, about; a task's memory is that of so many lines however large the table is.
LINES_PER_PART = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines_with(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with their orders; many lines are dealt by order over as many partitions as they ask for.

    What groups or joins by order afterwards stays in these partitions, so a task's
    memory does not grow with the table. Few lines are left to Spark.
    """
    spark = lines.sparkSession
    parts = -(-lines.count() // LINES_PER_PART)
    if parts > spark.sparkContext.defaultParallelism:
        # With fewer partitions than Spark's own, its joins would shuffle once more.
        parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _processor() -> Column:
    lane = F.col("l_suppkey") % 20
    return (
        F.when(F.col("l_partkey") % 89 == 7, F.lit(None).cast("string"))
        .when(F.col("l_orderkey") < 3, F.concat(F.lit("RARE-"), (F.col("l_suppkey") % 3).cast("string")))
        .when(lane < 2, F.concat(F.lit("EXT-"), lane.cast("string")))
        .otherwise(F.concat(F.lit("PROC-"), F.lpad(lane.cast("string"), 2, "0")))
    )


def _status() -> Column:
    return (
        F.when(F.col("l_partkey") % 97 == 5, F.lit(None).cast("string"))
        .when((F.col("l_returnflag") == "A") & (F.col("o_custkey") % 7 != 0), "approved")
        .when(F.col("l_returnflag") == "N", "filtered")
        .otherwise("declined")
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kind = (F.col("l_partkey") % 100).cast("int")
    return _lines_with(lines, orders).select(
        F.col("l_orderkey").alias("txid"),
        _processor().alias("processor_name"),
        _status().alias("status"),
        F.when(kind < len(ERROR_BLACKLIST), F.get(F.lit(list(ERROR_BLACKLIST)), kind))
        .when(kind < 45, F.lit(None).cast("string"))
        .when(kind < 55, "")
        .otherwise("Do not honor")
        .alias("error_description"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("created_datetime"),
        F.col("l_shipdate").cast("date").alias("created_date"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card per payment, two for every ninth; every hundred-and-first card is too short."""
    number = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    seconds = F.when(F.col("o_orderkey") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    cards = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(seconds).alias("nth"))
    whole = F.concat((400000 + (F.col("o_custkey") + F.col("nth")) % 70).cast("string"), number)
    return cards.select(
        F.col("o_orderkey").alias("txid"), F.when(F.col("o_orderkey") % 101 == 0, "4000").otherwise(whole).alias("card_no")
    )


def lettered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose first six characters start with 0, hold letters, or are fewer than six."""
    kind = F.col("o_custkey") % 4
    start = F.when(kind == 0, "012345").when(kind == 1, "AB12CD").when(kind == 2, "40").otherwise("400001")
    end = F.when(kind == 2, "").otherwise(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txid"), F.concat(start, end).alias("card_no"))


def training(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Training rows; the two line keys only serve ordering and are not unique. ``more`` names columns of the line."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    holders = table(spark, sf_dir, "customer")
    currency = F.col("l_linenumber") % 3
    # Orders meet their holders first: they are far fewer than lines, which are then shuffled once.
    owned = orders.join(holders, orders.o_custkey == holders.c_custkey)
    return (
        _lines_with(lines, owned)
        .where((F.col("o_custkey") % 70 + F.col("l_suppkey") % 20) % 11 != 0)
        .select(
            F.when(F.col("o_custkey") % 71 != 3, 400000 + F.col("o_custkey") % 70).cast("long").alias("bin"),
            F.concat(F.lit("M-"), F.col("c_nationkey").cast("string")).alias("merchant"),
            F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("o_orderpriority"))
            .alias("card_type"),
            _status().alias("status"),
            F.when(F.col("l_linestatus") == "F", "f").otherwise("t").alias("is_3d"),
            F.when(currency == 0, "EUR").when(currency == 1, "USD").otherwise("GBP").alias("currency"),
            _processor().alias("processor_name"),
            F.col("c_mktsegment").alias("project_name"),
            F.col("l_orderkey"),
            F.col("l_linenumber"),
            *more,
        )
    )
