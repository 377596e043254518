"""Hard negatives of anchor vectors by a secondary sort.

A vector's components become whole numbers, so that scores are exact integers.
Vectors are packed into *bricks* and dealt to lanes of about ``LANE_ROWS`` rows;
every lane meets all anchors, a few at a time, so no side is broadcast and
memory follows the lane. A lane keeps of an anchor's scores only those that can
still be among the first: its best positives, then, once the anchors' positives
are known, the best negatives of each positive's window. That is exact, as the
first k of all rows are among the first k of each lane.

What is left goes through one secondary sort: ``(anchor, descending score, kind,
id)`` packed into bytes, dealt by anchor and sorted within partitions. One pass
over the sorted keys opens a window at each positive, emits the negatives that
fall into it and closes it; it holds the open windows of one anchor and no rows.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binroute.sources.scratch import materialize

BRICK, LANE_ROWS, AT_ONCE = 64, 16384, 64
SCALE = 256
_MOST = 1 << 53  # quantised components saturate here
_SIGN = 1 << 63
_KEY = struct.Struct(">QQBQ")
_POSITIVE, _NEGATIVE = 0, 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, vector)`` of the rows that take part: nothing null, every component finite."""
    finite = F.forall(vector_col, lambda x: F.abs(x.cast("double")) < F.lit(math.inf))
    return rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    )


def _whole(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values.astype(np.float64)), -_MOST, _MOST).astype(np.int64)


def _bricks(rows: DataFrame) -> DataFrame:
    """Rows ``(id, label, vector, wanted)`` packed by up to ``BRICK``; shorter vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seat = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, len(batch), BRICK):
                part = batch.slice(start, BRICK)
                lengths = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                width = int(lengths.max())
                whole = np.zeros((len(part), width), np.int64)
                whole[np.arange(width) < lengths[:, None]] = _whole(part.column(2).flatten().to_numpy(zero_copy_only=False))
                most = int(np.abs(whole).max(initial=0))
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
                ids, labels = (part.column(i).to_numpy().astype("<i8").tobytes() for i in (0, 1))
                seat += 1
                yield pa.RecordBatch.from_pydict(
                    {"seat": pa.array([seat]), "n": pa.array([len(part)], pa.int32()), "ids": pa.array([ids], pa.binary()), "labels": pa.array([labels], pa.binary()),
                     "kind": pa.array([kind]), "vectors": pa.array([whole.astype(kind).tobytes()], pa.binary()),
                     "wanted": pa.array([part.column(3).to_pylist()], pa.list_(pa.list_(pa.int64())))}
                )

    schema = "seat long, n int, ids binary, labels binary, kind string, vectors binary, wanted array<array<long>>"
    return rows.select("id", "label", "vector", "wanted").mapInArrow(run, schema)


class _Rows:
    """Vectors of several bricks, in the order of their ids."""

    def __init__(self, bricks: list[dict]):
        self.ids = np.concatenate([np.frombuffer(b["ids"], "<i8") for b in bricks])
        self.labels = np.concatenate([np.frombuffer(b["labels"], "<i8") for b in bricks])
        self.wanted = [w for b in bricks for w in b["wanted"]]
        parts = [np.frombuffer(b["vectors"], b["kind"]).reshape(b["n"], -1) for b in bricks]
        self.vectors = np.zeros((len(self.ids), max(p.shape[1] for p in parts)), np.int64)
        at = 0
        for p in parts:
            self.vectors[at : at + len(p), : p.shape[1]] = p
            at += len(p)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.labels, self.vectors = self.ids[order], self.labels[order], self.vectors[order]
        self.wanted = [self.wanted[i] for i in order]
        self.most = int(np.abs(self.vectors).max(initial=0))
        self._as_double: np.ndarray | None = None

    @property
    def doubles(self) -> np.ndarray:
        if self._as_double is None:
            self._as_double = self.vectors.astype(np.float64)
        return self._as_double

    def scores(self, others: _Rows) -> np.ndarray:
        """Exact inner products; in doubles only where no sum can pass 2^53. Sums beyond a long saturate."""
        width = min(self.vectors.shape[1], others.vectors.shape[1])
        bound = self.most * others.most * width
        if bound < 1 << 53:
            return (self.doubles[:, :width] @ others.doubles[:, :width].T).astype(np.int64)
        ours, theirs = self.vectors[:, :width], others.vectors[:, :width]
        if bound < _SIGN:
            return ours @ theirs.T
        exact = ours.astype(object) @ theirs.astype(object).T
        return np.clip(exact, -_SIGN, _SIGN - 1).astype(np.int64)


def _first(scores: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` places of highest score; of equal scores the first places."""
    if len(places) <= count:
        return places
    some = scores[places]
    bar = np.partition(some, len(some) - count)[len(some) - count]
    above = places[some > bar]
    return np.concatenate([above, places[some == bar][: count - len(above)]])


def _met(bricks: DataFrame, anchors: DataFrame, lanes: int, choose, schema: str) -> DataFrame:
    """Every lane of rows meets every anchor; ``choose(anchors, rows, scores)`` gives a batch of what is kept."""
    names = ["n", "ids", "labels", "kind", "vectors", "wanted"]
    rows = bricks.select(F.pmod(F.xxhash64("seat"), F.lit(lanes)).cast("int").alias("lane"), F.lit(0).alias("side"), *names)
    each = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(1).alias("side"), *names)
    dealt = rows.unionByName(each).repartition(min(4 * lanes, 1 << 15), "lane").sortWithinPartitions("lane", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, here, waiting, matrix = None, [], [], None

        def meet():
            if waiting and here:
                own = _Rows(waiting)
                yield choose(own, matrix, own.scores(matrix))

        for batch in batches:
            for brick in batch.to_pylist():
                if brick["lane"] != lane:
                    yield from meet()
                    lane, here, waiting, matrix = brick["lane"], [], [], None
                if brick["side"] == 0:
                    here.append(brick)
                    continue
                if matrix is None and here:
                    matrix = _Rows(here)
                waiting.append(brick)
                if sum(b["n"] for b in waiting) >= AT_ONCE:
                    yield from meet()
                    waiting = []
        yield from meet()

    return dealt.mapInArrow(run, schema)


def _best_positives(count: int):
    def choose(anchors: _Rows, rows: _Rows, scores: np.ndarray) -> pa.RecordBatch:
        own, found, values = [], [], []
        for i, (anchor, label) in enumerate(zip(anchors.ids, anchors.labels, strict=True)):
            places = _first(scores[i], np.flatnonzero((rows.labels == label) & (rows.ids != anchor)), count)
            own.append(np.full(len(places), anchor))
            found.append(rows.ids[places])
            values.append(scores[i][places])
        columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (own, found, values)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "score"])

    return choose


def packed(anchor: int, score: int, kind: int, row: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, positives first, then id."""
    return _KEY.pack(anchor + _SIGN, _SIGN - 1 - score, kind, row + _SIGN)


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = _KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, kind, row - _SIGN


def _keys_of_negatives(count: int, low: int, high: int):
    def choose(anchors: _Rows, rows: _Rows, scores: np.ndarray) -> pa.RecordBatch:
        keys = []
        for i, (anchor, label) in enumerate(zip(anchors.ids.tolist(), anchors.labels, strict=True)):
            other = np.flatnonzero(rows.labels != label)
            mine = scores[i][other]
            kept = set()
            for positive in set(anchors.wanted[i]):
                if positive < 0:
                    continue  # its window is empty
                # low * positive <= 100 * score <= high * positive, without the products
                inside = other[(mine >= -(-low * positive // 100)) & (mine <= high * positive // 100)]
                kept.update(_first(scores[i], inside, count).tolist())
            keys += [packed(anchor, int(scores[i][p]), _NEGATIVE, int(rows.ids[p])) for p in kept]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    return choose


def stream(keys: Iterable[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """The result rows of sorted keys, holding only the open windows of one anchor."""
    now, seen, windows = None, 0, []
    for key in keys:
        anchor, score, kind, row = unpacked(key)
        if anchor != now:
            now, seen, windows = anchor, 0, []
        if kind == _POSITIVE:
            if seen < positives:
                seen += 1
                windows.append([row, score, 0])
            continue
        for window in windows:
            positive, top, found = window
            if low * top <= 100 * score <= high * top:
                window[2] = found + 1
                yield now, positive, found + 1, row, top, score
        windows = [w for w in windows if w[2] < negatives and 100 * score >= low * w[1]]


def mine(
    rows: DataFrame, anchors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` are the queries, with the columns of ``rows``. An anchor's
    positives are its first ``positives`` other rows of equal label, by score
    (descending) and id; the negatives of a positive are the first ``negatives``
    rows of another label whose score is ``low`` to ``high`` percent of its score.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part. Components become ``floor(256 * x)`` and saturate at
    2^53; scores saturate at the range of a long. Vectors of unequal length are
    compared as if the shorter ended in zeros, so an empty one scores 0. Equal
    scores are ordered by id. Of anchors that share an id the least (label, vector)
    counts; other rows count as often as they stand, but never for their own id. A
    positive with no fit negative gives no row, and empty tables give none. Other
    columns are not read.
    """
    spark = rows.sparkSession
    none = F.array().cast("array<long>")
    bricks = materialize(_bricks(usable(rows, id_col, vector_col, label_col).withColumn("wanted", none)), "bricks")
    lanes = max(1, math.ceil((bricks.agg(F.sum("n")).first()[0] or 0) / LANE_ROWS))
    single = usable(anchors, id_col, vector_col, label_col).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least"))
    single = materialize(single.select("id", "least.label", "least.vector"), "anchors")
    best = _met(bricks, _bricks(single.withColumn("wanted", none)), lanes, _best_positives(positives), "anchor long, id long, score long")
    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = materialize(best.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= positives), "positives")
    wanted = best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("wanted"))  # at most ``positives`` each
    asking = _bricks(single.join(wanted, "id"))
    found = _met(bricks, asking, lanes, _keys_of_negatives(negatives, low, high), "key binary")
    starts = best.rdd.map(lambda r: (packed(r["anchor"], r["score"], _POSITIVE, r["id"]), None))
    pairs = found.rdd.map(lambda r: (bytes(r["key"]), None)).union(starts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    result = ordered.mapPartitions(lambda keys: stream((k for k, _ in keys), positives, negatives, low, high))
    return spark.createDataFrame(result, RESULT, verifySchema=False)
