"""Running totals over a total order without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binroute.sources.scratch import materialize


def running_totals(
    rows: DataFrame,
    order: Sequence[Column],
    measures: Mapping[str, str],
    within: Sequence[str] = (),
) -> DataFrame:
    """Add, per ``{new column: summed column}``, the running total in ``order``.

    With ``within``, each group of those columns is totalled on its own. The
    ordering columns (with ``within``) must be unique per row: callers group
    first, so no range slice can be filled by copies of one value.

    Rows are range-partitioned into ordered slices and written with their slice
    number. The totals per (slice, group) number at most slices + groups, and
    only they pass through a window over all slices; every other window stays
    inside one slice.
    """
    keys = list(within)
    ordered = rows.repartitionByRange(*[F.col(k) for k in keys], *order)
    sliced = materialize(ordered.withColumn("_slice", F.spark_partition_id()), "slices")

    per_slice = sliced.groupBy("_slice", *keys).agg(
        *[F.sum(source).alias(f"_sum_{name}") for name, source in measures.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        "_slice",
        *keys,
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in measures],
    )

    inside = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Written, so that Spark knows its size: one row per slice and group that meets it.
    joined = sliced.join(materialize(offsets, "offsets"), ["_slice", *keys])
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[
            (F.col(f"_before_{name}") + F.sum(source).over(inside)).alias(name)
            for name, source in measures.items()
        ],
    )
