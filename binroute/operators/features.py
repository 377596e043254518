"""Success statistics, training features and candidate features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binroute.constants import MIN_PROCESSOR_ROWS
from binroute.functions import bin_prefix, bin_suffix
from binroute.sources.scratch import materialize

PAIR = ["bin", "processor_name_encoded"]


def with_bin_parts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"bin_prefix": bin_prefix(F.col("bin")), "bin_suffix": bin_suffix(F.col("bin"))})


def labelled(encoded: DataFrame) -> DataFrame:
    """Add the label (approved has code 0; filtered is a failure) and BIN parts."""
    flag = F.when(F.col("status_encoded") == 0, 1).otherwise(0)
    return with_bin_parts(encoded.withColumn("success_flag", flag))


def drop_null_bin(rows: DataFrame) -> DataFrame:
    return rows.na.drop(subset=["bin"])


def pair_counts(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Rows and successes per BIN and processor; all statistics follow from it.

    ``weight`` is as in a category profile.
    """
    n = (F.lit(1) if weight is None else weight).cast("long")
    return (
        drop_null_bin(rows)
        .groupBy(*PAIR)
        .agg(F.sum(n).alias("tx"), F.sum(n * F.col("success_flag")).alias("success"))
    )


def successful_bins(pairs: DataFrame) -> DataFrame:
    """BINs with a mean above 0, that is with any success."""
    return pairs.groupBy("bin").agg(F.sum("success").alias("success")).where(F.col("success") > 0).select("bin")


def valid_processors(pairs: DataFrame, min_rows: int = MIN_PROCESSOR_ROWS) -> DataFrame:
    return (
        pairs.groupBy("processor_name_encoded")
        .agg(F.sum("tx").alias("tx"))
        .where(F.col("tx") >= min_rows)
        .select("processor_name_encoded")
    )


@dataclass(frozen=True)
class Stats:
    """Success statistics of the pairs that survive the filters.

    ``pairs`` is the written table with all six statistics per pair; the tables
    of the data model are views of it.
    """

    pairs: DataFrame

    @property
    def bin_tx(self) -> DataFrame:
        return self.pairs.groupBy("bin").agg(F.sum("bin_processor_tx_count").alias("bin_tx_count"))

    @property
    def bin_success(self) -> DataFrame:
        rate = F.sum("bin_processor_success_count") / F.sum("bin_processor_tx_count")
        return self.pairs.groupBy("bin").agg(rate.alias("bin_success_rate"))

    @property
    def proc_success(self) -> DataFrame:
        rate = F.sum("bin_processor_success_count") / F.sum("bin_processor_tx_count")
        return self.pairs.groupBy("processor_name_encoded").agg(rate.alias("processor_success_rate"))

    @property
    def bin_proc_stats(self) -> DataFrame:
        return self.pairs.select(
            *PAIR, "bin_processor_tx_count", "bin_processor_success_count", "bin_processor_success_rate"
        )

    @property
    def all_processors(self) -> DataFrame:
        return self.pairs.select("processor_name_encoded").distinct()

    @property
    def global_fallback(self) -> DataFrame:
        """One row of unweighted means: two over BINs, three over pairs."""
        per_bin = self.pairs.groupBy("bin").agg(
            F.sum("bin_processor_tx_count").alias("tx"), F.sum("bin_processor_success_count").alias("success")
        )
        bins = per_bin.agg(
            F.avg("tx").alias("bin_tx_count"), F.avg(F.col("success") / F.col("tx")).alias("bin_success_rate")
        )
        names = ("bin_processor_tx_count", "bin_processor_success_count", "bin_processor_success_rate")
        pairs = self.pairs.agg(*[F.avg(name).alias(name) for name in names])
        means = bins.select(F.struct("*")).scalar()
        return pairs.select(
            means.getField("bin_tx_count").alias("bin_tx_count"),
            means.getField("bin_success_rate").alias("bin_success_rate"),
            *names,
        )


def fit_stats(
    pairs: DataFrame, require_success: bool = True, min_processor_rows: int = MIN_PROCESSOR_ROWS
) -> Stats:
    """Filter pairs and compute all statistics.

    With ``require_success`` (retraining) BINs without any success go first, and
    what is left decides which processors are frequent enough. Without it
    (notebook order) only rare processors are dropped.
    """
    written = materialize(pairs, "pairs")
    if require_success:
        written = written.join(successful_bins(written), "bin", "left_semi")
    processors = (
        written.groupBy("processor_name_encoded")
        .agg(F.sum("tx").alias("_tx"), F.sum("success").alias("_success"))
        .where(F.col("_tx") >= min_processor_rows)
        .select("processor_name_encoded", (F.col("_success") / F.col("_tx")).alias("processor_success_rate"))
    )
    frequent = written.join(processors, "processor_name_encoded")
    bins = frequent.groupBy("bin").agg(F.sum("tx").alias("bin_tx_count"), F.sum("success").alias("_success"))
    per_bin = bins.select("bin", "bin_tx_count", (F.col("_success") / F.col("bin_tx_count")).alias("bin_success_rate"))
    return Stats(
        materialize(
            frequent.join(per_bin, "bin").select(
                *PAIR,
                "bin_tx_count",
                "bin_success_rate",
                "processor_success_rate",
                F.col("tx").alias("bin_processor_tx_count"),
                F.col("success").alias("bin_processor_success_count"),
                (F.col("success") / F.col("tx")).alias("bin_processor_success_rate"),
            ),
            "stats",
        )
    )


def training_features(rows: DataFrame, stats: Stats) -> DataFrame:
    """Rows that survive the filters, with their statistics and NULLs as 0.

    One join on (BIN, processor) both applies the filters and attaches all six
    statistics. The written statistics have a known size, so Spark decides by
    it between a broadcast and a shuffle with skew splitting.
    """
    return rows.join(stats.pairs, PAIR).na.fill(0)


def candidate_pairs(bins: DataFrame, processors: DataFrame, bins_per_lane: int = 4096) -> DataFrame:
    """Every BIN with every processor, as an equi-join on a lane number.

    There is a lane for so many BINs. Each BIN lies in one lane, and the
    processors, of which there are fewer, are copied to all.
    """
    lanes = 1 + bins.count() // bins_per_lane
    placed = bins.withColumn("lane", F.pmod(F.xxhash64("bin"), F.lit(lanes)).cast("int"))
    spread = processors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return placed.join(spread, "lane").drop("lane")


def candidate_features(bins: DataFrame, stats: Stats, is_3d: Column | int) -> DataFrame:
    """Features of every BIN and processor, with means for what is unknown.

    An unknown BIN takes the global means; a known BIN takes them for an unknown
    pair only.
    """
    means = stats.global_fallback.select(F.struct("*")).scalar()
    rows = _candidates(bins, stats)
    known = F.col("bin_tx_count").isNotNull()

    def pair(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), means.getField(name))

    return _feature_columns(
        rows,
        is_3d,
        bin_tx_count=F.when(known, F.col("bin_tx_count").cast("double")).otherwise(means.getField("bin_tx_count")),
        bin_success_rate=F.when(known, F.coalesce("bin_success_rate", F.lit(0.0))).otherwise(
            means.getField("bin_success_rate")
        ),
        bin_processor_tx_count=pair("bin_processor_tx_count"),
        bin_processor_success_count=pair("bin_processor_success_count"),
        bin_processor_success_rate=pair("bin_processor_success_rate"),
    )


def candidate_features_nb(bins: DataFrame, stats: Stats, is_3d: Column | int) -> DataFrame:
    """As above in the notebook's form: whatever is unknown is 0."""
    names = (
        "bin_tx_count",
        "bin_success_rate",
        "bin_processor_tx_count",
        "bin_processor_success_count",
        "bin_processor_success_rate",
    )
    filled = {name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in names}
    return _feature_columns(_candidates(bins, stats), is_3d, **filled)


def _candidates(bins: DataFrame, stats: Stats) -> DataFrame:
    """Pairs with BIN, processor and pair statistics, NULL where unknown."""
    wanted = bins.select(F.col("bin").cast("long").alias("bin")).distinct()
    per_bin = stats.bin_tx.join(stats.bin_success, "bin")
    with_bin = materialize(wanted.join(per_bin, "bin", "left"), "candidate-bins")
    return candidate_pairs(with_bin, stats.proc_success).join(stats.bin_proc_stats, PAIR, "left")


def _feature_columns(rows: DataFrame, is_3d: Column | int, **values: Column) -> DataFrame:
    code = is_3d if isinstance(is_3d, Column) else F.lit(is_3d)
    return rows.select(
        "bin",
        "processor_name_encoded",
        bin_prefix(F.col("bin")).alias("bin_prefix"),
        bin_suffix(F.col("bin")).alias("bin_suffix"),
        code.cast("int").alias("is_3d_encoded"),
        values["bin_tx_count"].alias("bin_tx_count"),
        values["bin_success_rate"].alias("bin_success_rate"),
        F.coalesce("processor_success_rate", F.lit(0.0)).alias("processor_success_rate"),
        values["bin_processor_tx_count"].alias("bin_processor_tx_count"),
        values["bin_processor_success_count"].alias("bin_processor_success_count"),
        values["bin_processor_success_rate"].alias("bin_processor_success_rate"),
    )
