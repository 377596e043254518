"""From scored candidates to ranked processors per BIN.

A BIN has at most one candidate per processor, so its window is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binroute.constants import ROUTED_PER_BIN, ROUTING_THRESHOLD, SCORES_PER_BIN
from binroute.functions import strip


def top_processors(
    scored: DataFrame, external: Sequence[str], top_n: int = SCORES_PER_BIN, threshold: float = 0.0
) -> DataFrame:
    """Best processors per BIN by score in percent.

    The percentage is the whole number of hundredths nearest to it, half to
    even, over 100: how array libraries round, and not by decimal digits.
    Expects ``bin, processor_name_encoded, processor, score``; equal scores keep
    the order of the processor codes.
    """
    percent = F.rint(F.col("score") * 100 * 100) / 100
    best = Window.partitionBy("bin").orderBy(F.desc("predicted_success"), "processor_name_encoded")
    return (
        scored.withColumn("predicted_success", percent)
        .where(F.col("predicted_success") >= threshold * 100)
        .withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= top_n)
        .select(
            F.col("bin").alias("BIN"),
            F.col("processor").alias("Processor"),
            F.col("predicted_success").alias("Predicted Success %"),
            F.col("rank").alias("Rank"),
            F.when(F.col("processor").isin(*external), "Yes").otherwise("No").alias("Fallback External"),
        )
    )


def route_internal_first(
    scored: DataFrame,
    external: Sequence[str],
    top_n: int = ROUTED_PER_BIN,
    threshold: float = ROUTING_THRESHOLD,
) -> DataFrame:
    """Internal processors at or above the threshold; only where a BIN has none,
    all external ones whatever their score. Then the first ``top_n``."""
    outside = F.col("processor").isin(*external)
    good = ~outside & (F.col("score") >= threshold)
    per_bin = Window.partitionBy("bin")
    best = per_bin.orderBy(F.desc("score"), "processor_name_encoded")
    return (
        scored.withColumns({"_outside": outside, "_good": good})
        .withColumn("_any_good", F.max("_good").over(per_bin))
        .where(F.col("_good") | (F.col("_outside") & ~F.col("_any_good")))
        .withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= top_n)
        .select("bin", "processor", F.col("score").alias("predicted_success"), "rank")
    )


def predicted_vs_actual(predicted: DataFrame, report: DataFrame) -> DataFrame:
    """Every row of the approval report with the prediction for it, if any."""
    scores = predicted.select(
        strip(F.col("BIN").cast("string")).alias("BIN"),
        strip("Processor").alias("Processor"),
        "Predicted Success %",
        F.col("Rank").alias("Predicted Rank"),
    )
    return scores.join(report, ["BIN", "Processor"], "right")
