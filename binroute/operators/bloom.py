"""A Bloom filter of built-in expressions, to drop rows before they are shuffled.

An exact join must follow: the filter lets a few rows pass that it should not.
The filter is a table of words that one scalar subquery hands to the scan, so
its size is bounded; more keys than it can tell apart get no filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binroute.sources.scratch import materialize

#: At most 2 MB of bits, and at least eight of them for each key.
MOST_BITS, BITS_PER_KEY, HASHES = 1 << 24, 8, 2


def _positions(value: Column, bits: int) -> list[Column]:
    return [F.xxhash64(value, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def size_for(keys: int) -> int | None:
    """Bits (a power of two) for so many keys; None beyond the bound."""
    bits = 64
    while bits < BITS_PER_KEY * keys:
        bits *= 2
    return bits if bits <= MOST_BITS else None


def only_possible(rows: DataFrame, column: str, keys: DataFrame, n_keys: int | None = None) -> DataFrame:
    """The rows whose ``column`` may be among ``keys`` (a table of one column, read twice).

    None of the wanted rows is lost; of the others about one in twenty stays. A
    NULL is no key. With more keys than fit, all rows stay.
    """
    name = keys.columns[0]
    bits = size_for(keys.count() if n_keys is None else n_keys)
    if bits is None:
        return rows
    position = keys.where(F.col(name).isNotNull()).select(F.explode(F.array(*_positions(F.col(name), bits))).alias("position"))
    words = position.groupBy(F.shiftright("position", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("position").bitwiseAND(F.lit(63)).cast("int"))).alias("set")
    )
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(words, "word", "left")
    # At most 2^18 words; written, so that the subquery is one short scan.
    ordered = F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
    filled = materialize(every.agg(ordered.alias("words")).select(F.transform("words", lambda w: w["set"]).alias("words")), "bloom")
    table = filled.scalar()
    tests = [
        F.call_function("shiftright", F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        for p in _positions(F.col(column), bits)
    ]
    passed = F.col(column).isNotNull()
    for test in tests:
        passed = passed & test
    return rows.where(passed)
