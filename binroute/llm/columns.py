"""Arrow columns of text as flat byte arrays, and hashes of the words in them.

A *word* is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; a null
text is an empty one. Work is done on slices of a batch, so that memory follows
the slice (or a single longer text) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def field(df, name: str, alias: str | None = None):
    """The schema field of a column, for the schema of a result."""
    from pyspark.sql import types as T

    return T.StructField(alias or name, df.schema[name].dataType, True)


def set_aside(rows, used: list[str]):
    """``rows`` with the columns ``used`` and one struct of all others, and a function that restores the columns.

    What an operator adds meanwhile then clashes with none of the caller's columns.
    The function takes the operator's result, and further columns to put at the end.
    """
    from pyspark.sql import functions as F

    names = rows.columns
    others = [c for c in names if c not in used]
    name = "others_of_the_caller"
    while name in used:
        name += "_"
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(True)
    narrow = rows.select(*[F.col(f"`{c}`") for c in used], packed.alias(name))

    def back(result, *more):
        return result.select(*[F.col(name).getField(c).alias(c) if c in others else F.col(f"`{c}`") for c in names], *more)

    return narrow, back


def texts(column: pa.Array) -> pa.Array:
    """A text column without nulls; nothing is copied if it has none."""
    return pc.fill_null(column, "") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without nulls."""
    _, where, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(where, wide, len(column) + 1 + column.offset)[column.offset :] if where else np.zeros(1, np.int64)
    bounds = bounds.astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text stands alone."""
    if not len(column):
        return
    _, bounds = flat(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, SLICE_BYTES + 1)
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: a polynomial in the bytes, divided by the run's place."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Runs:
    """Tokens of a slice; ``first[i]`` to ``first[i + 1]`` are those of row i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


#: Byte classes: 0 separates; a run of any other class is a token.
WORDS = (~_SPACE).astype(np.uint8)
WORDS_AND_MARKS = np.where(_SPACE, 0, 2).astype(np.uint8)
WORDS_AND_MARKS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def runs(column: pa.Array, classes: np.ndarray = WORDS) -> Runs:
    data, bounds = flat(column)
    kind = classes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge[:-1] & (kind != 0))
    ends = np.flatnonzero(edge[1:] & (kind != 0)) + 1
    return Runs(starts, ends, run_hashes(data, starts, ends), np.searchsorted(starts, bounds))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each row's values; rows without values give 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    some = first[1:] > first[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0)
    return out


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every window of ``size`` words, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for at in range(size):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[at : at + n]
    return mix(out)


def text_hashes(column: pa.Array) -> list[bytes]:
    """16-byte digests of whole texts; equal texts have equal digests."""
    import xxhash

    return [xxhash.xxh3_128_digest(b) for b in column.cast(pa.binary()).to_pylist()]
