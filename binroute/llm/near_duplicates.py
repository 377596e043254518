"""Near-duplicate documents by order min-hash and banded alignment.

A text's k-mers are its windows of three words, the n-th occurrence of a window
counting as another k-mer. For each of ``TABLES`` hash functions the ``KEPT`` k-mers
with the least hashes are taken and joined *in text order*: two texts agree if
they share these k-mers in the same order, which follows edit similarity and not
only common content. Texts that agree in a table are candidates; a banded
alignment of their words decides.

Equal texts form one node from the start. Members of a bucket meet as
``binroute.llm.buckets`` says: all with all in small buckets, with other ends in
rounds in crowded ones, and at last every pair of different classes left there. Pairs must
agree in length and in a parity bitmap of their words before they are aligned: texts at
an edit distance of d differ in at most 2 d words. With a share J of common k-mers
a pair agrees in a table with probability of about J^2. Scattered changes of a fifth
of the words leave J = 0.34, and then at least one of 40 tables agrees in 99 % of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binroute.sources.scratch import materialize

from . import buckets
from .alignment import most_edits, within
from .columns import mix, runs, set_aside, shingles, slices, text_hashes, texts
from .components import components

WINDOW, TABLES, KEPT, SIMILARITY = 3, 40, 2, 0.8
#: Rounds of ends in crowded buckets; ids of wanted texts that are sent to the scan.
ROUNDS, FEW_WANTED = 1, 200_000
_CELLS = 1 << 20
_BITS = [f"s{i}" for i in range(8)]
#: Bits of the wide bitmap by which members of mixed crowded buckets are told apart.
WIDE = 4096


def _odd(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mers with their occurrence number mixed in."""
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    fresh = np.ones(len(kmers), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    if fresh.all():
        return kmers
    at = np.arange(len(kmers))
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = kmers.copy()
    out[order] = np.where(nth, mix(ordered + nth.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)), ordered)
    return out


def signature(words: np.ndarray, tables: int = TABLES, kept: int = KEPT, window: int = WINDOW) -> np.ndarray:
    """One value per table; fewer words than a window make one k-mer, no words none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    kmers = labelled(shingles(words, min(window, len(words))))
    odd = _odd(tables)
    out = np.zeros(tables, np.uint64)
    step = max(1, _CELLS // len(kmers))
    for start in range(0, tables, step):
        hashed = kmers[None, :] * odd[start : start + step, None]
        if len(kmers) > kept:
            places = np.sort(np.argpartition(hashed, kept - 1, axis=1)[:, :kept], axis=1)
        else:
            places = np.broadcast_to(np.arange(len(kmers)), hashed.shape)
        value = np.zeros(len(hashed), np.uint64)
        for column in range(places.shape[1]):
            value = value * np.uint64(0xC2B2AE3D27D4EB4F) + kmers[places[:, column]]
        out[start : start + step] = mix(value + np.arange(start, start + len(hashed), dtype=np.uint64) * odd[0])
    return out


def word_bits(words: np.ndarray, bits: int = 512) -> np.ndarray:
    """So many bits: how many words fall on each, modulo 2."""
    odd = np.bincount((words & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, n_words, signature, s0 .. s7)`` per row; one digest per different text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column(1))
            for start, stop in slices(column):
                part = column[start:stop]
                found = runs(part)
                counts = np.diff(found.first)
                own = [found.hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
                bits = np.array([word_bits(words) for words in own]).reshape(-1, len(_BITS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], pa.array(text_hashes(part), pa.binary()), pa.array(counts.astype(np.int32)),
                     pa.array([signature(words).view(np.int64) for words in own], pa.list_(pa.int64())), *[pa.array(bits[:, i]) for i in range(len(_BITS))]],
                    names=["doc_id", "digest", "n_words", "signature", *_BITS],
                )

    schema = f"doc_id {kind}, digest binary, n_words int, signature array<long>, " + ", ".join(f"{s} long" for s in _BITS)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _sequences(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(digest, words)`` of the texts in some pairs ``(a, b)``, words as 32-bit hashes, from one row of each text."""
    kind = docs.schema[id_col].dataType.simpleString()
    ends = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    wanted = materialize(nodes.join(ends, "digest", "left_semi").select(F.col("rep").alias("wanted_id"), F.col("digest").alias("wanted")), "wanted")
    ids = wanted.select("wanted_id").distinct()
    # A few ids of known number are sent to the scan; more meet the texts in a shuffle.
    ids = F.broadcast(ids) if wanted.count() <= FEW_WANTED else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column(1))
            for start, stop in slices(column):
                part = column[start:stop]
                found = runs(part)
                small = (found.hashes >> np.uint64(32)).astype("<u4")
                rows = [small[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], pa.array(text_hashes(part), pa.binary()), pa.array(rows, pa.binary())],
                    names=["doc_id", "digest", "words"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    words = rows.mapInArrow(run, f"doc_id {kind}, digest binary, words binary")
    mine = words.join(wanted, (F.col("digest") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    return materialize(mine.select("digest", "words").dropDuplicates(["digest"]), "words")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts share in any order; the longer has at least the others as edits."""
    (ours, n), (theirs, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(ours, theirs, assume_unique=True, return_indices=True)
    return int(np.minimum(n[x], m[y]).sum())


def _aligned(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b, words_a, words_b)`` whose alignment is similar enough, as ``(a, b)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for row in range(len(batch)):
                a, b = np.frombuffer(left[row].as_py(), "<u4"), np.frombuffer(right[row].as_py(), "<u4")
                most = most_edits(len(a), len(b), similarity)
                good.append(_common(a, b) >= max(len(a), len(b)) - most and within(a, b, most) is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "words_a", "words_b").mapInArrow(run, "a binary, b binary")


def _alike(similarity: float) -> F.Column:
    longer, shorter = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    return longer - shorter <= F.floor(longer * (1 - similarity) + 1e-9)


def _may_align(similarity: float) -> F.Column:
    """Whether texts a and b agree in length and words as far as every pair within the edit distance does."""
    longer, shorter = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    most = F.floor(longer * (1 - similarity) + 1e-9)
    unlike = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in _BITS), F.lit(0))
    # A replaced word makes two differ, an inserted or deleted one makes one differ and the lengths too.
    return _alike(similarity) & (unlike <= 2 * most - (longer - shorter))


def _wide(words: DataFrame) -> DataFrame:
    """``(digest, wide)``: a wide parity bitmap of the words of texts, the n-th of a word counting as another word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [word_bits(labelled(np.frombuffer(row.as_py(), "<u4").astype(np.uint64)), WIDE) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["digest", "wide"])

    return words.select("digest", "words").mapInArrow(run, "digest binary, wide array<long>")


def _may_align_wide(similarity: float) -> F.Column:
    """As ``_may_align``, on the wide bitmap too; long texts that share most words differ in too many of its bits."""
    longer, shorter = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    most = F.floor(longer * (1 - similarity) + 1e-9)
    unlike = F.aggregate(F.zip_with("wide_a", "wide_b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, x: total + x)
    return _may_align(similarity) & (unlike <= 2 * most - (longer - shorter))


def _checked(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Digests ``(a, b)`` of pairs of names that may align."""
    a, b = (nodes.select(*[F.col(c).alias(f"{c}_{end}") for c in ("name", "digest", "n", *_BITS)]) for end in "ab")
    met = pairs.join(a, "name_a").join(b, "name_b").where(_may_align(similarity))
    return met.select(F.greatest("digest_a", "digest_b").alias("a"), F.least("digest_a", "digest_b").alias("b")).where("a <> b").distinct()


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs that align."""
    a = words.select(F.col("digest").alias("a"), F.col("words").alias("words_a"))
    b = words.select(F.col("digest").alias("b"), F.col("words").alias("words_b"))
    return materialize(_aligned(pairs.join(a, "a").join(b, "b"), similarity), "links")


def _joined(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, class)`` after more links."""
    if classes is not None:
        links = classes.where("node <> class").select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(links)
    return materialize(components(links), "classes")


def joined(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(node, class)`` of the texts, by digest, that a link joins with others.

    ``nodes`` has one row per different text: ``digest, name, rep, n, signature, s0 .. s7``, with n words.
    Only texts in pairs that may align are read again.
    """
    seats = nodes.select("name", "n", F.posexplode("signature").alias("table", "value"))
    shared = buckets.shared(seats.select("name", "n", F.xxhash64("table", "value").alias("key")))

    def verified(names: DataFrame, words: DataFrame | None = None) -> DataFrame:
        pairs = materialize(_checked(names, nodes, similarity), "pairs")
        return _verified(pairs, words or _sequences(docs, nodes, pairs, id_col, text_col), similarity)

    near = buckets.near_pairs(shared, _alike(similarity), nodes=nodes, facts=_BITS, fit=_may_align(similarity))
    classes = _joined(None, verified(near))
    crowded = buckets.classed(shared, nodes, classes)
    for salt in range(ROUNDS):
        classes = _joined(classes, verified(buckets.end_pairs(crowded, _alike(similarity), salt)))
        crowded = buckets.classed(shared, nodes, classes)
    left = materialize(nodes.join(buckets.mixed(crowded), "name", "left_semi").select("name", "digest", "n", *_BITS), "mixed")
    words = _sequences(docs, nodes, left.select(F.col("digest").alias("a"), F.col("digest").alias("b")), id_col, text_col)
    told = left.join(_wide(words), "digest").drop("digest")
    return _joined(classes, verified(buckets.every_pair(crowded, told, ["n", *_BITS, "wide"], _may_align_wide(similarity)), words))


def _classed(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows, and ``(digest, class_id, class_size, kept)`` of the texts; one text per class is kept."""
    sketched = materialize(sketches(docs, id_col, text_col), "sketches")
    nodes = materialize(
        sketched.groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n"), *[F.first(c).alias(c) for c in ("signature", *_BITS)])
        .withColumn("name", F.xxhash64("digest")),
        "texts",
    )
    classes = joined(docs, nodes, similarity, id_col, text_col).withColumnsRenamed({"node": "digest", "class": "root"})
    rooted = nodes.select("digest", "rep", "copies").join(classes, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest"))
    named = rooted.groupBy("root").agg(least.alias("least"), F.sum("copies").alias("class_size"))
    by_text = rooted.select("digest", "root").join(named, "root")
    chosen = by_text.select("digest", F.col("least.rep").alias("class_id"), "class_size", (F.col("digest") == F.col("least.digest")).alias("kept"))
    return sketched, materialize(chosen, "classes")


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, class_size)`` for every row of ``docs``.

    A class is a set of texts connected by links, and all rows with these texts;
    its id is its least document id (null if all are null). Null and empty texts
    are equal, and equal texts share a class, whatever their length. Rows of equal
    id are told apart by text. No rows: no rows.
    """
    sketched, by_text = _classed(docs, similarity, id_col, text_col)
    return sketched.select("doc_id", "digest").join(by_text, "digest").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: that of its least id, the text with the least digest among several of that id.

    Columns stay as they are, whatever their names; of equal rows one stays. Null and
    empty texts are one class. No rows: no rows.
    """
    sketched, by_text = _classed(docs, similarity, id_col, text_col)
    kept = sketched.join(by_text.where("kept").select(F.col("digest").alias("__digest"), "class_id"), F.col("digest") == F.col("__digest"))
    kept = kept.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("doc_id").alias("__id"), "__digest").agg(F.count(F.lit(1)).alias("__rows"))
    kept = materialize(kept, "kept")
    rows, back = set_aside(docs, [id_col, text_col])
    marked = rows.withColumn("__text", digest(F.col(text_col)))
    chosen = marked.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")))
    if not kept.where("__rows > 1").isEmpty():
        chosen = chosen.dropDuplicates(["__id", "__digest"])
    return back(chosen)


@F.arrow_udf(T.BinaryType())
def digest(column: pa.Array) -> pa.Array:
    return pa.array(text_hashes(texts(column)), pa.binary())
