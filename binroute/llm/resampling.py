"""Quality by importance resampling.

Two hashed n-gram models are counted, one of target text and one of all raw
text. A document's log weight is the sum of its n-grams' log ratios; adding
Gumbel noise and keeping the k largest sums samples k documents without
replacement in proportion to the weights.

Features are single tokens (runs of letters and digits, or of marks) and pairs of
neighbours. A pair of equal tokens is one feature, whatever the token, and so is
one whose second token equals the token before the first: stuttering is visible
however rare the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binroute.sources.scratch import materialize

from .columns import WORDS_AND_MARKS, mix, row_sums, runs, slices, texts
from .selection import as_rank, threshold

BITS = 14
#: Bound on the labelled rows used; the choice is by hash of the id.
LABELLED = 20_000
_SAME, _AGAIN = np.uint64(0x51ED270B27B4B3A5), np.uint64(0x2545F4914F6CDD1D)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each row, row after row, and where rows begin."""
    found = runs(column, WORDS_AND_MARKS)
    h = found.hashes
    pair = mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])
    pair[1:][h[:-2] == h[2:]] = _AGAIN
    pair[h[:-1] == h[1:]] = _SAME
    both = np.empty(2 * len(h), np.uint64)
    both[0::2] = h
    both[1:-1:2] = pair
    keep = np.ones(len(both), bool)
    lasts = found.first[1:][found.first[1:] > found.first[:-1]] - 1
    keep[2 * lasts + 1] = False  # no pair crosses the end of a row
    counts = np.maximum(2 * (found.first[1:] - found.first[:-1]) - 1, 0)
    return (mix(both[keep]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def count_features(docs: DataFrame, target: Column, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``(bucket, n_raw, n_target)`` over all rows; ``target`` marks rows of the target."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, wanted = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            column, marks = texts(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for start, stop in slices(column):
                buckets, first = features(column[start:stop], bits)
                raw += np.bincount(buckets, minlength=size)
                rows = np.repeat(marks[start:stop], np.diff(first))
                wanted += np.bincount(buckets[rows], minlength=size)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(wanted[some])], names=["bucket", "n_raw", "n_target"])

    counted = docs.select(text_col, F.coalesce(target, F.lit(False)).alias("__target"))
    return (
        counted.mapInArrow(run, "bucket long, n_raw long, n_target long")
        .groupBy("bucket")
        .agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))
    )


def log_ratios(counts: DataFrame, bits: int = BITS, smoothing: float = 20.0) -> np.ndarray:
    """Log ratio of target to raw per bucket; all 0 without target text.

    Both sides get ``smoothing`` counts at the target's scale, so that a bucket the
    target would hardly have reached says little. The driver holds ``2^bits`` counts.
    """
    raw, wanted = np.zeros(1 << bits), np.zeros(1 << bits)
    for row in counts.collect():
        raw[row["bucket"]] = row["n_raw"]
        wanted[row["bucket"]] = row["n_target"]
    if not wanted.any():
        return np.zeros(1 << bits)
    return np.log(wanted + smoothing) - np.log(raw * (wanted.sum() / raw.sum()) + smoothing)


def log_weight(ratios: np.ndarray, text: Column, bits: int = BITS) -> Column:
    """The log weight of a text; 0 for a text without tokens, null or empty ones included."""

    @F.arrow_udf("double")
    def weigh(column: pa.Array) -> pa.Array:
        column = texts(column)
        out = [np.zeros(0)]
        for start, stop in slices(column):
            buckets, first = features(column[start:stop], bits)
            out.append(row_sums(ratios[buckets], first))
        return pa.array(np.round(np.concatenate(out), 6))

    return weigh(text)


def gumbel(identity: Column, seed: int) -> Column:
    """Standard Gumbel noise drawn by hash; equal identities draw the same."""
    uniform = (F.pmod(F.xxhash64(identity, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def best_cut(scores: list[tuple[float, bool]]) -> float:
    """The weight that parts good from bad labels best, midway in the widest gap among equals.

    Errors count by class share. Without both classes nothing can be parted and
    the cut is below all.
    """
    good = sorted(s for s, ok in scores if ok)
    bad = sorted(s for s, ok in scores if not ok)
    if not good or not bad:
        return float("-inf")
    edges = np.array(sorted({*good, *bad}))
    lost = np.searchsorted(good, edges, "left") / len(good)
    passed = 1 - np.searchsorted(bad, edges, "left") / len(bad)
    error = lost + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    gaps = edges[best] - np.where(best > 0, edges[best - 1], edges[best])
    at = best[int(np.argmax(gaps))]
    return float((edges[at] + edges[at - 1]) / 2) if at else float(edges[at])


@dataclass
class Resampler:
    """A fitted selection: ratios, noise seed and the rank that a kept document reaches."""

    ratios: np.ndarray
    seed: int
    cut: float
    k: int
    least_rank: int
    id_col: str = "doc_id"
    text_col: str = "text"

    def key(self) -> Column:
        return log_weight(self.ratios, F.col(self.text_col)) + gumbel(F.col(self.id_col), self.seed)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The chosen rows of ``docs``, all columns as they are."""
        return docs.where(as_rank(self.key()) >= self.least_rank)


def labelled_sample(labels: DataFrame, good: Column, id_col: str = "doc_id", bound: int = LABELLED) -> DataFrame:
    """At most ``bound`` labelled ids, chosen by hash, with ``__good``; half of them ``__held`` out of the fit."""
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(good).alias("__good"))
    place = F.xxhash64("__id")
    return one.orderBy(place, "__id").limit(bound).withColumn("__held", F.shiftrightunsigned(place, 7) % 2 == 1)


def fit(
    docs: DataFrame, labels: DataFrame, good: Column, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
    bound: int = LABELLED,
) -> tuple[Resampler, DataFrame]:
    """Fit on all documents and return the selection with ``(id, log_weight, rank)`` of every row.

    Target text is that of the good ones in one half of at most ``bound`` labelled
    rows; raw text is that of all rows. k is the number of rows whose weight lies
    above the cut that parts good and bad labels of the other half best: as many
    as look like the target.
    Rows that tie with the k-th are all kept. Null ids and texts, repeated rows and
    empty tables are allowed; without usable labels every row is kept.
    """
    sample = F.broadcast(labelled_sample(labels, good, id_col, bound))  # at most ``bound`` ids
    marked = docs.select(F.col(id_col), F.col(text_col)).join(sample, F.col(id_col) == F.col("__id"), "left")
    ratios = log_ratios(count_features(marked, F.col("__good") & ~F.col("__held"), text_col))
    weighed = marked.select(F.col(id_col), "__good", "__held", log_weight(ratios, F.col(text_col)).alias("log_weight"))
    scored = materialize(
        weighed.withColumn("rank", as_rank(F.col("log_weight") + gumbel(F.col(id_col), seed))), "importance"
    )
    one = F.min_by("log_weight", F.xxhash64("log_weight"))  # of documents with one id, whatever their order
    known = scored.where("__held").groupBy(id_col).agg(one.alias("weight"), F.max("__good").alias("good")).collect()  # at most ``bound``
    cut = best_cut([(r["weight"], r["good"]) for r in known])
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    least = threshold(scored, "rank", k)
    return Resampler(ratios, seed, cut, k, least, id_col, text_col), scored.drop("__good", "__held")


def resample(docs: DataFrame, labels: DataFrame, good: Column, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, log_weight, kept)`` for every row of ``docs``."""
    fitted, scored = fit(docs, labels, good, seed, id_col, text_col)
    return scored.select(id_col, "log_weight", (F.col("rank") >= fitted.least_rank).alias("kept"))
