import math

import numpy as np
from compare import compare, connect
from llm_helpers import SF

from binroute.llm import hard_negatives, registry
from binroute.llm.hard_negatives import _NEGATIVE, _POSITIVE, packed, stream, unpacked

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score long, lane int, wanted string, key string"
EXTRA = (1, 2, 3, "w", "k")


def brute(rows, anchor, positives=5, negatives=10):
    """Plain loops over all pairs."""
    fit = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
           if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, label in fit:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, w, other in fit if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(-s, k) for s, k, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, j, rank, k, -p, s) for rank, (s, k) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine(df, df.where("vec_id % 3 = 0"), **options).collect())


def test_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LANE_ROWS", 64)  # several lanes
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2, 3, 4) / 8).tolist(), int(rng.integers(0, 3))) for i in range(300)]  # many ties
    found = mined(spark, rows)
    assert found and found == brute(rows, lambda i: i % 3 == 0)


def test_odd_rows(spark):
    rows = [
        (0, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.25, 0.25], 2), (-4, [0.25, 0.25], 2), (4, [0.0, 0.0], 2),
        (5, None, 1), (6, [0.5, None], 1), (7, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2), (9, [0.5, 0.5], None),
        (None, [0.25, 0.25], 2), (12, [], 3), (15, [], 3), (16, [-1.0], 4), (10, [0.25, 0.125, 9.0], 2), (3, [1.0, 1.0], 5),
    ]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    assert {r[0] for r in mined(spark, rows)} == {0, 12, 15}  # the empty vectors score 0 with all


def test_repeated_rows_and_empty_table(spark):
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.25, 0.25], 2), (2, [0.25, 0.25], 2)]
    assert mined(spark, rows) == [(0, 1, 1, 2, 24576, 16384), (0, 1, 2, 2, 24576, 16384)]
    assert mined(spark, rows[:0]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e6, 1.0], 1), (1, [3.0e6, 3.0], 1), (2, [2.0e6, 5.0], 2), (3, [2.5e6, 0.0], 1), (4, [1.0e6, 1.0], 2), (5, [-1e38, 0.0], 1)]
    found = mined(spark, rows[:5])
    assert found and found == brute(rows[:5], lambda i: i % 3 == 0)
    assert mined(spark, rows) is not None  # saturates


def test_keys_sort_as_asked():
    rows = [(a, s, k, i) for a in (-5, 0, 7) for s in (-(1 << 62), -1, 0, 9) for k in (_POSITIVE, _NEGATIVE) for i in (-1, 0, 3)]
    assert [unpacked(k) for k in sorted(packed(*r) for r in rows)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    keys = sorted([packed(1, 0, _POSITIVE, 9), packed(1, 0, _NEGATIVE, 2), packed(1, -5, _POSITIVE, 3), packed(1, -2, _NEGATIVE, 4)])
    assert list(stream(keys, 5, 10, 30, 90)) == [(1, 9, 1, 2, 0, 0)]  # a window at 0 holds a 0; one below 0 is empty


def test_query_equals_its_sql(spark):
    assert compare(registry.queries()["op12_hard_negatives"](spark, SF), connect(SF), registry.oracle_sql()["op12_hard_negatives"]) == []
