"""Exact stratified hold-out without sorting the rows.

A global order per class would put a third or more of all rows into one task.
Instead the position that ends the hold-out is searched digit by digit: counts
per leading digits of the order key, then per trailing digits among the rows
that share the leading ones, then the other columns among equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binroute.constants import HOLDOUT_FRACTION
from binroute.functions import safe_div
from binroute.operators.totals import running_totals
from binroute.sources.scratch import materialize

DIGIT_BITS = 16
DIGIT = (1 << DIGIT_BITS) - 1


def class_quotas(counts: DataFrame, label: str, fraction: float = HOLDOUT_FRACTION) -> DataFrame:
    """Hold-out rows per class from counts ``label, n``; one row per class.

    The hold-out has ``ceil(fraction * n)`` rows. Each class keeps the floor of
    its share of the rest for training, and classes with the largest remainders
    (the smaller label on a tie) keep one more until the rest is used up.
    """
    sizes = counts.groupBy(label).agg(F.sum("n").alias("n"))
    # These windows have no partition on purpose: they see one row per class.
    everything = Window.partitionBy()
    by_remainder = Window.partitionBy().orderBy(F.desc("remainder"), label)
    total = F.sum("n").over(everything)
    kept = total - F.ceil(F.lit(fraction) * total)
    # n * kept exceeds a long from some billions of rows on.
    share = F.col("n").cast("decimal(19,0)") * F.col("kept").cast("decimal(19,0)")
    return (
        sizes.select(label, "n", kept.alias("kept"), total.alias("total"))
        .withColumn("share", share)
        .withColumns({"floor": F.expr("share div total"), "remainder": F.col("share") % F.col("total")})
        .withColumn("open", F.col("kept") - F.sum("floor").over(everything))
        .withColumn("train", F.col("floor") + (F.row_number().over(by_remainder) <= F.col("open")).cast("long"))
        .select(label, (F.col("n") - F.col("train")).cast("long").alias("quota"))
    )


def _cut(counts: DataFrame, label: str, digit: str) -> DataFrame:
    """Per class, the digit at which ``quota`` rows are reached, and how many
    rows are still needed inside it. Sees at most 2^16 rows per class."""
    up_to = Window.partitionBy(label).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("reached", F.sum("n").over(up_to))
        .where((F.col("reached") >= F.col("quota")) & (F.col("reached") - F.col("n") < F.col("quota")))
        .select(label, F.col(digit), (F.col("quota") - F.col("reached") + F.col("n")).alias("need"))
    )


def stratified_split(
    rows: DataFrame, label: str, order_key: Column, fraction: float = HOLDOUT_FRACTION
) -> DataFrame:
    """Add ``is_holdout``: the ``quota`` smallest rows of each class by key.

    ``order_key`` is a whole number in [0, 2^32), a hash of the row's content.
    Rows with the key at the cut are ordered by their other columns; copies of
    one row are interchangeable, so the result does not depend on files or
    partitions. ``rows`` is computed once and written with its key: it is read
    for the counts by leading digits, for the rows that share the cut's digits and
    for the result, and each of these would repeat the joins behind it.
    """
    written = materialize(rows.withColumn("_key", order_key.cast("long")), "keyed")
    keyed = written.withColumn("_high", F.shiftright("_key", DIGIT_BITS))
    # The counts per digit are written: at most 2^16 rows per class, and read more than once.
    high = materialize(keyed.groupBy(label, "_high").agg(F.count("*").alias("n")), "high")
    quotas = materialize(class_quotas(high, label, fraction), "quotas")
    at_high = materialize(_cut(high.join(quotas, label), label, "_high"), "cut-high")
    cut_high = at_high.select(label, F.col("_high").alias("_cut_high"), F.col("need").alias("quota"))

    # Rows with the cut's leading digits, equal ones counted: about one in 2^16.
    inside = keyed.join(cut_high, label).where(F.col("_high") == F.col("_cut_high"))
    near = materialize(inside.groupBy(*rows.columns, "_key", "quota").agg(F.count("*").alias("copies")), "near-cut")
    low = near.groupBy(label, "quota", "_key").agg(F.sum("copies").alias("n"))
    at_low = materialize(_cut(low, label, "_key").withColumnRenamed("_key", "_cut_key"), "cut")
    judged = near.join(at_low, label)
    # Different rows with exactly the last key: usually one per class.
    equal = judged.where(F.col("_key") == F.col("_cut_key"))
    placed = running_totals(equal, [F.col(c) for c in rows.columns if c != label], {"reached": "copies"}, within=[label])
    held = F.greatest(F.least(F.col("need") - F.col("reached") + F.col("copies"), F.col("copies")), F.lit(0))
    clear = judged.where(F.col("_key") != F.col("_cut_key")).withColumn(
        "held", F.when(F.col("_key") < F.col("_cut_key"), F.col("copies")).otherwise(0)
    )
    counted = clear.select(*rows.columns, "copies", "held").unionByName(
        placed.select(*rows.columns, "copies", held.alias("held"))
    )

    outside = keyed.join(cut_high, label, "left").where(F.coalesce(F.col("_high") != F.col("_cut_high"), F.lit(True)))
    # A class with an empty quota has no cut and stays in training.
    chosen = F.coalesce(F.col("_high") < F.col("_cut_high"), F.lit(False))
    return outside.select(*rows.columns, chosen.alias("is_holdout")).unionByName(_copies(counted, rows.columns))


def _copies(counted: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as it was counted, the first ``held`` of them in the hold-out."""
    last = F.floor((F.col("copies") - 1) / DIGIT)
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    left = F.least(F.col("copies") - F.col("_block") * DIGIT, F.lit(DIGIT).cast("long"))
    each = blocks.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return each.select(*columns, (F.col("_block") * DIGIT + F.col("_nth") <= F.col("held")).alias("is_holdout"))


def class_ratio(split: DataFrame, label: str) -> DataFrame:
    """Negatives per positive in the training part."""
    training = ~F.col("is_holdout")
    return split.agg(
        safe_div(F.count_if(training & (F.col(label) == 0)), F.count_if(training & (F.col(label) == 1))).alias(
            "class_ratio"
        )
    )
