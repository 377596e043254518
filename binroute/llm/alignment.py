"""Edit distance of word sequences within a band, on bit vectors."""

from __future__ import annotations

import numpy as np


def within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None.

    Only cells whose row and column differ by at most ``most`` are looked at. A
    column's band is one whole number: its bits are the differences between
    neighbouring rows, so a column costs a few operations on ``2 * most`` bits.
    """
    if abs(len(a) - len(b)) > most:
        return None
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    if short:
        unlike = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
        tail = int(unlike[0]) if len(unlike) else short
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a) if len(a) <= most else None
    most = min(most, len(a))
    places: dict[int, int] = {}
    rows = a.tolist()
    for row, word in enumerate(rows):
        places[word] = places.get(word, 0) | 1 << row
    width = 2 * most + 2
    full = (1 << width) - 1
    top = 1 << width - 1
    rising, falling = full ^ ((1 << width - most - 1) - 1), 0
    distance, last = most, len(a) - most  # the tracked cell runs down the band's edge, then along the last row
    edge = top >> 1
    spare = 2 * most + len(b) - len(a)
    for column, word in enumerate(b.tolist()):
        shift = column - most - 1
        match = places.get(word, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        same = ((((match & rising) + rising) ^ rising) | match | falling) & full
        up = falling | (full ^ (same | rising))
        down = same & rising
        if column < last:
            distance += not same & top
        else:
            distance += bool(up & edge) - bool(down & edge)
            edge >>= 1
        if distance > spare:
            return None
        half = same >> 1
        rising = down | (full ^ (half | up))
        falling = half & up
    return distance if distance <= most else None


def most_edits(n: int, m: int, similarity: float) -> int:
    """The largest distance at which ``1 - distance / longer`` is at least ``similarity``."""
    return int(max(n, m) * (1 - similarity) + 1e-9)
