"""Stable category codes: null fill, dictionary growth, encode and decode.

A dictionary is a frame ``column_name, category, code``. Codes once given never
change; unseen categories are appended. ``StringIndexer`` would renumber them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binroute.operators.totals import running_totals
from binroute.sources.schemas import CATEGORICAL, DICTIONARY
from binroute.sources.scratch import materialize


def dictionary_frame(spark: SparkSession, codes: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Dictionary from ``{column: {category: code}}``."""
    rows = [(column, category, code) for column, entries in codes.items() for category, code in entries.items()]
    return spark.createDataFrame(rows, DICTIONARY)


def category_profile(
    rows: DataFrame, columns: Sequence[str] = CATEGORICAL, weight: Column | None = None
) -> DataFrame:
    """Rows per value of each column, NULL included, in one pass over the data.

    Everything that fitting needs (modes, unseen values) comes from this table,
    whose size is that of the distinct values. ``weight`` is the number of rows
    that a row of an already counted table stands for.
    """
    strings = rows.select(
        *[F.col(c).cast("string").alias(c) for c in columns],
        (F.lit(1) if weight is None else weight).cast("long").alias("_weight"),
    )
    return (
        strings.unpivot("_weight", list(columns), "column_name", "category")
        .groupBy("column_name", "category")
        .agg(F.sum("_weight").alias("n"))
    )


def written_profile(rows: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    return materialize(category_profile(rows, columns), "profile")


def column_modes(profile: DataFrame) -> DataFrame:
    """Most frequent value per column; the smallest of several."""
    best = F.min(F.struct((-F.col("n")).alias("n"), "category"))
    return (
        profile.where(F.col("category").isNotNull())
        .groupBy("column_name")
        .agg(best.alias("best"))
        .select("column_name", F.col("best.category").alias("mode"))
    )


def impute_modes(rows: DataFrame, modes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill NULLs with the column's mode."""
    fills = {c: modes.where(F.col("column_name") == c).select("mode").scalar() for c in columns}
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), _required(fill, c)) for c, fill in fills.items()})


def _required(value: Column, column: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"column {column} has no value to fill with")).cast("string"))


def extend_dictionary(existing: DataFrame, profile: DataFrame) -> DataFrame:
    """Append the unseen categories of each column in sorted order.

    New codes follow the column's largest; a column without any starts at 0.
    """
    unseen = (
        profile.where(F.col("category").isNotNull())
        .select("column_name", "category")
        .distinct()
        .join(existing, ["column_name", "category"], "left_anti")
        .withColumn("one", F.lit(1))
    )
    numbered = running_totals(unseen, [F.col("category")], {"ordinal": "one"}, within=["column_name"])
    largest = existing.groupBy("column_name").agg(F.max("code").alias("largest"))
    grown = numbered.join(largest, "column_name", "left").select(
        "column_name",
        "category",
        (F.coalesce("largest", F.lit(-1)) + F.col("ordinal")).cast("int").alias("code"),
    )
    return existing.select("column_name", "category", "code").unionByName(grown)


@dataclass(frozen=True)
class Encoder:
    """A grown dictionary in lookup form: the category NULL of each column has
    the code of the column's mode."""

    lookup: DataFrame

    @property
    def dictionary(self) -> DataFrame:
        return self.lookup.where(F.col("category").isNotNull())


def fit_encoder(profile: DataFrame, existing: DataFrame) -> Encoder:
    """Encoder for the columns of a category profile.

    The profile is read more than once; one that comes straight from the rows
    should be written first (``written_profile``).
    """
    dictionary = extend_dictionary(existing, profile)
    modes = column_modes(profile).select("column_name", F.col("mode").alias("category"), F.lit(True).alias("_mode"))
    marked = dictionary.join(modes, ["column_name", "category"], "left")
    # The row of a mode appears twice: under its category and under NULL.
    names = F.when(F.col("_mode"), F.array("category", F.lit(None).cast("string"))).otherwise(F.array("category"))
    lookup = marked.select("column_name", F.explode(names).alias("category"), "code")
    return Encoder(materialize(lookup, "lookup"))


def encode(rows: DataFrame, encoder: Encoder, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Replace each column by ``<column>_encoded``, NULL as its mode.

    One join per column on the written lookup. Its file size is known, so the
    optimizer broadcasts it while it is below the threshold and otherwise
    shuffles, with adaptive splitting of frequent categories.
    """
    for column in columns:
        codes = encoder.lookup.where(F.col("column_name") == column).select(
            F.col("category").alias("_category"), F.col("code").alias("_code")
        )
        missing = F.raise_error(F.concat(F.lit(f"no code for {column} "), F.coalesce(column, F.lit("NULL"))))
        rows = (
            rows.join(codes, F.col(column).cast("string").eqNullSafe(F.col("_category")), "left")
            .withColumn(f"{column}_encoded", F.coalesce("_code", missing.cast("int")))
            .drop(column, "_category", "_code")
        )
    return rows


def encode_column(rows: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """Add the code of one column; NULL where the dictionary has no entry."""
    codes = dictionary.where(F.col("column_name") == column).select(
        F.col("category").alias(column), F.col("code").alias(f"{column}_encoded")
    )
    return rows.join(codes, column, "left")


def decode(rows: DataFrame, dictionary: DataFrame, column: str, code_column: str, name: str) -> DataFrame:
    """Add the category of a code, ``Unknown ID <code>`` where there is none."""
    names = dictionary.where(F.col("column_name") == column).select(
        F.col("code").alias(code_column), F.col("category").alias(name)
    )
    unknown = F.concat(F.lit("Unknown ID "), F.col(code_column).cast("string"))
    return rows.join(names, code_column, "left").withColumn(name, F.coalesce(name, unknown))


def code_of(dictionary: DataFrame, column: str, category: str) -> Column:
    """The code of one category, as a scalar for use in any expression."""
    wanted = (F.col("column_name") == column) & (F.col("category") == category)
    return dictionary.where(wanted).select("code").scalar()
