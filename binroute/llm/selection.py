"""Exact selection of the k largest values without sorting or gathering rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCALE, _SHIFT, _DIGIT = 1_000_000, 1 << 47, 16


def as_rank(value) -> F.Column:
    """A score as a non-negative whole number below 2^48, in millionths."""
    bounded = F.least(F.greatest(F.round(value * _SCALE), F.lit(float(-_SHIFT))), F.lit(float(_SHIFT - 1)))
    return bounded.cast("long") + F.lit(_SHIFT)


def threshold(rows: DataFrame, rank: str, k: int) -> int:
    """The k-th largest ``rank``; with fewer than k rows 0, and with k < 1 more than any.

    Three grouped counts over 16 bits each; the driver sees at most 65536 counts
    a time, whatever the number of rows.
    """
    if k < 1:
        return _SHIFT * 2
    found, left = 0, k
    for shift in (32, 16, 0):
        inside = rows.where(F.shiftright(rank, shift + _DIGIT) == found) if shift < 32 else rows
        digit = F.shiftright(rank, shift).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        counts = inside.groupBy(digit.alias("digit")).count().collect()
        for digit, n in sorted(((r["digit"], r["count"]) for r in counts), reverse=True):
            if n >= left:
                found = found << _DIGIT | digit
                break
            left -= n
        else:
            return 0
    return found
