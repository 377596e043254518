"""Statistics that grow by the new rows: counts kept per month and summed.

Counts of raw categories add up, whatever dictionary a run used; statistics do
not, as both of their filters (BINs with a success, processors with enough rows)
look at all rows. So the counts of each month are stored, a refresh scans only
the rows it is given, and filters, codes and statistics are computed again from
the sums, which have a row per BIN and category and not per payment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binroute.constants import MIN_PROCESSOR_ROWS
from binroute.operators import encoding, features
from binroute.plans import training as plan
from binroute.sources import writers
from binroute.sources.commits import Conflict
from binroute.sources.schemas import CATEGORICAL
from binroute.sources.scratch import materialize

COUNTS = "bin long, " + ", ".join(f"{c} string" for c in plan.COUNTED) + ", n long"
VALUES = "column_name string, category string, n long"


def month_of(created_date: Column) -> Column:
    """``2026-01``; rows without a date share a month of their own."""
    return F.coalesce(F.date_format(created_date, "yyyy-MM"), F.lit("none"))


def count_months(rows: DataFrame, month: Column, columns: Sequence[str] = CATEGORICAL) -> tuple[DataFrame, DataFrame]:
    """Rows per month, BIN and counted categories, and per month and value of each other column."""
    others = [c for c in columns if c not in plan.COUNTED]
    return plan.counted_sets(rows.withColumn("month", month), others, ["month"])


def summed(counts: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and profile of all rows from counts of their parts."""
    names = ["bin", *plan.COUNTED]
    whole = materialize(counts.groupBy(*names).agg(F.sum("n").alias("n")), "counts")
    others = values.groupBy("column_name", "category").agg(F.sum("n").alias("n"))
    return whole, encoding.category_profile(whole, plan.COUNTED, F.col("n")).unionByName(others)


def refresh_and_publish(
    rows: DataFrame,
    month: Column,
    base: str,
    seed: DataFrame | None = None,
    replace: bool = False,
    columns: Sequence[str] = CATEGORICAL,
    require_success: bool = True,
    min_processor_rows: int = MIN_PROCESSOR_ROWS,
    attempts: int = 20,
) -> features.Stats:
    """Count the given rows, add them to the stored months and publish new statistics.

    With ``replace`` the rows are all there are of their months and take the place
    of what was counted; otherwise they are late or new rows that are added. The
    current model stays, and so does every code. Of two refreshes at once the
    later one to commit sums again with the earlier one's counts, so neither is
    lost. A refresh that fails has added nothing.
    """
    spark = rows.sparkSession
    run_ts = writers.new_run_ts()
    new = writers.save_months(*count_months(rows, month, columns), base, run_ts)
    for _ in range(attempts):
        commit, current = writers.latest(spark, base)
        stored = current.months if current else {}
        months = {**stored, **{m: [run_ts] if replace else [*stored.get(m, []), run_ts] for m in new}}
        counts, profile = summed(
            writers.load_months(spark, base, months, "counts", COUNTS), writers.load_months(spark, base, months, "values", VALUES)
        )
        existing = plan._stored(spark, base, current, seed)
        encoder, _, stats = plan.fit_counts(counts, profile, existing, require_success, min_processor_rows)
        here = writers.new_run_ts()
        dictionary_run = writers.save_dictionary(encoder.dictionary, base, here, current.dictionary_run if current else None)
        writers.save_stats(stats, base, here)
        run = writers.Run(
            here, current.accuracy if current else None, f"statistics of {len(months)} months", dictionary_run, here,
            current.model_run if current else None, months,
        )
        try:
            writers.publish(spark, base, commit, run)
            return writers.load_stats(spark, base, here)
        except Conflict:
            continue
    raise Conflict(f"{attempts} other runs were published in {base}")


def compact(spark, base: str) -> None:
    """Sum the parts of each month into one, so that months with many late rows stay one read.

    A compaction that meets a newer commit begins again from it.
    """

    def change(commit):
        run = writers.Run(**commit.content) if commit else None
        if run is None or all(len(parts) < 2 for parts in run.months.values()):
            return None
        many = {m: parts for m, parts in run.months.items() if len(parts) > 1}
        run_ts = writers.new_run_ts()
        tables = []
        for name, schema, keys in (("counts", COUNTS, ["bin", *plan.COUNTED]), ("values", VALUES, ["column_name", "category"])):
            each = [writers.load_months(spark, base, {m: parts}, name, schema).withColumn("month", F.lit(m)) for m, parts in many.items()]
            whole = each[0]
            for other in each[1:]:
                whole = whole.unionByName(other)
            tables.append(whole.groupBy("month", *keys).agg(F.sum("n").alias("n")))
        writers.save_months(*tables, base, run_ts)
        return {**commit.content, "run_ts": run_ts, "months": {**run.months, **{m: [run_ts] for m in many}}}

    writers.log(spark, base).update(change)
