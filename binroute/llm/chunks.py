"""Fingerprints by content-defined chunking.

A gear hash of the last 32 bytes decides where chunks end, so an insertion moves
boundaries only near it. Chunking is normalised: below the usual size a stricter
mask has to match, above it a looser one, which draws sizes towards the usual.
A fingerprint is the set of chunk digests with their lengths; containment weighs
shared digests by length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, mix, texts

SMALLEST, USUAL, LARGEST = 16, 64, 256
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def boundaries(data: np.ndarray, smallest: int = SMALLEST, usual: int = USUAL, largest: int = LARGEST) -> list[int]:
    """Ends of the chunks of a text's bytes; none for no bytes."""
    n = len(data)
    gear = _GEAR[data]
    for width in (1, 2, 4, 8, 16):  # after each step a value covers twice as many bytes
        older = np.zeros_like(gear)
        older[width:] = gear[:-width] << np.uint32(width) if n > width else older[width:]
        gear = gear + older
    bits = usual.bit_length() - 1
    strict = np.flatnonzero(gear >> np.uint32(32 - bits - 2) == 0) + 1
    loose = np.flatnonzero(gear >> np.uint32(32 - bits + 2) == 0) + 1
    ends, start = [], 0
    strict_at, loose_at = strict.tolist(), loose.tolist()
    i = j = 0
    while n - start > smallest:
        low, middle, high = start + smallest, start + usual, min(start + largest, n)
        while i < len(strict_at) and strict_at[i] < low:
            i += 1
        end = high
        if i < len(strict_at) and strict_at[i] < min(middle, high):
            end = strict_at[i]
        else:
            while j < len(loose_at) and loose_at[j] < middle:
                j += 1
            if j < len(loose_at) and loose_at[j] < high:
                end = loose_at[j]
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunk_set(raw: bytes) -> dict[int, int]:
    """Length by 64-bit digest of the distinct chunks."""
    import xxhash

    view, out, start = memoryview(raw), {}, 0
    for end in boundaries(np.frombuffer(raw, np.uint8)):
        out[xxhash.xxh3_64_intdigest(view[start:end])] = end - start
        start = end
    return out


def render(chunks: dict[int, int]) -> str:
    """A fingerprint as text: digest and length of each chunk, sorted; empty for an empty text."""
    return " ".join(f"{digest:016x}:{size:x}" for digest, size in sorted(chunks.items()))


def parse(fingerprint: str) -> dict[int, int]:
    return {int(a, 16): int(b, 16) for a, b in (x.split(":") for x in fingerprint.split())}


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """Share of the bytes in ``own``'s distinct chunks that ``other`` has; 1 for two empty sets."""
    total = sum(own.values())
    if not total:
        return float(not other)
    return sum(size for digest, size in own.items() if digest in other) / total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, fingerprint)`` per row; a null text counts as empty."""
    schema = T.StructType([field(docs, id_col), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(1)).to_pylist()
            prints = [render(chunk_set(text.encode())) for text in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in rows], pa.int64()), pa.array(prints, pa.string())], names=schema.names
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def with_next(docs: DataFrame, slices: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in slices of neighbouring ids that each end with a copy of the next slice's first.

    Columns ``slice``, ``tail`` (true for the copy), ``id`` and ``text``; the first
    document also ends the last slice. Slices are cut at quantiles of the ids. The
    driver sees one id per slice and no text. Ids must be whole numbers; null ids
    come first. Rows of equal id fall into one slice.
    """
    lowest = -(1 << 63)
    known = F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("known")
    ids = docs.select(known)
    cuts = ids.where(F.col("known") > lowest).stat.approxQuantile("known", [i / slices for i in range(1, slices)], 0.1 / slices) if slices > 1 else []
    place = Bucketizer(splits=[-inf, *sorted({float(lowest), *cuts}), inf], inputCol="at", outputCol="slice").transform
    firsts = place(ids.withColumn("at", F.col("known").cast("double"))).groupBy("slice").agg(F.min("known").alias("first"))
    found = firsts.orderBy("slice").collect()
    heads = [(row["first"], found[at - 1]["slice"]) for at, row in enumerate(found)]
    before = docs.sparkSession.createDataFrame(heads, "known long, slice double")
    own = docs.select(known, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    placed = place(own.withColumn("at", F.col("known").cast("double")))
    tails = own.join(F.broadcast(before), "known")  # one row per slice
    return placed.select("slice", F.lit(False).alias("tail"), "id", "text").unionByName(
        tails.select("slice", F.lit(True).alias("tail"), "id", "text")
    )


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text has its last ``n_chars // 2`` code points replaced by as many
    of the next document's first (all, if it has fewer); the next document of the
    last is the first. Columns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. Null text: empty. No rows: none.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = with_next(docs, 8 * partitions, id_col, text_col)
    ordered = placed.repartition(partitions, "slice").sortWithinPartitions("slice", "tail", F.col("id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts(batch.column(3)).to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None
        for part, tail, doc, text in rows(batches):
            chunks = chunk_set(text.encode())
            if held is not None and held[0] == part:
                _, old_doc, old_text, old_chunks = held
                half = len(old_text) // 2
                edited = (old_text[: len(old_text) - half] + text[:half]).encode()
                edited_chunks = chunk_set(edited)
                out.append((
                    old_doc, len(old_text), hashlib.sha256(edited).hexdigest(), render(old_chunks), render(edited_chunks),
                    containment(old_chunks, edited_chunks), containment(old_chunks, chunks),
                ))
            held = None if tail else (part, doc, text, chunks)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                       ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return ordered.mapInArrow(run, schema)
