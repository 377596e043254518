"""Jaccard join of word n-gram sets, size-aware: subsets for small sets, lists for large ones.

A set is the distinct hashes of a text's n-grams (64 bits); equal sets are one
node. All sets order their tokens alike: frequent tokens last, by count, the
others by hash. Sets that overlap enough share their first common tokens within
short *prefixes*, so that

* two small sets meet in the bucket of a common subset of ``SUBSET`` prefix tokens;
* a large set scans the inverted lists of its prefix tokens, which hold all sets
  that can be similar to a large one.

The boundary between small and large is the size at which enumerating all
subsets costs more than scanning the lists, by the sizes of all sets and by the
mean length of the lists (``boundary``). Neither side loses a pair.

Links are wanted for their connected classes; ``binroute.llm.buckets`` says which
members of a bucket meet for that. Pairs must agree in length and in two parity
bitmaps, whose differing bits are a lower bound of the symmetric difference: a
short one within the joins, then one that grows with the set, so that long sets
are told apart as well. What is left is verified on the sets. While candidates are
searched, sets go by 64-bit names. Two sets of one name are both looked at; only if
they stood in one bucket could a pair be missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binroute.sources.scratch import materialize

from . import buckets
from .columns import flat, mix, runs, shingles, slices, texts
from .components import components

WORDS, PERCENT, SUBSET = 4, 85, 2
#: Tokens in more than this share of the rows are ordered last; at most so many are told to the tasks (3 MB).
FREQUENT, MOST_FREQUENT = 1 / 2000, 1 << 18
#: One of so many tokens is counted for the mean length of lists; a partner costs so many rows; largest small set.
SAMPLED, PARTNER_COST, MOST_SMALL = 64, 4, 512
#: Rounds of ends in crowded buckets after the first; ids of wanted texts that are sent to the scan; tokens counted at once.
_ROUNDS, _FEW_WANTED, _WINDOW = 1, 200_000, 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SKETCH = ["s0", "s1", "s2", "s3"]


def lowered(column: pa.Array) -> pa.Array:
    """A text column without nulls, A-Z in lower case."""
    data, bounds = flat(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data]))


def token_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text is one n-gram, one without words none."""
    found = runs(lowered(column))
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        yield np.unique(shingles(found.hashes[a:b], min(words, b - a))) if b > a else np.zeros(0, np.uint64)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The fewest tokens that a set of n shares with any set it is linked to."""
    return -(-percent * n // 100)


def prefix(n: int, shared: int, percent: int = PERCENT) -> int:
    """So many first tokens hold the first ``shared`` common ones of any linked pair."""
    return min(n, n - least_overlap(n, percent) + shared)


def smallest(percent: int = PERCENT) -> int:
    """Smaller sets are linked to equal sets only."""
    return next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))


def boundary(sizes: dict[int, int], partners: float, percent: int = PERCENT) -> int:
    """The size from which sets are large, at the least cost.

    ``sizes`` counts the sets of each size, ``partners`` is the mean number of others in a list.
    Enumerating costs a row per subset, scanning a row per list and ``PARTNER_COST`` per partner.
    """
    lists = {n: sizes[n] * prefix(n, 1, percent) * (1 + PARTNER_COST * partners) for n in sizes}
    subsets = {n: sizes[n] * math.comb(prefix(n, SUBSET, percent), SUBSET) for n in sizes}

    def cost(bound: int) -> float:
        small = sum(c for n, c in subsets.items() if n < bound)
        return small + sum(c for n, c in lists.items() if n >= least_overlap(bound, percent))

    return min(range(smallest(percent), MOST_SMALL + 1), key=cost)


def _statistics(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """``(kind, value, n)``: 0 sets of a size, 1 a sampled token, 2 a token that is frequent in some window of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for kind, values, least in (
                (0, np.array([len(x) for x in held], np.uint64), 1),
                (1, np.concatenate([x[x % np.uint64(SAMPLED) == 0] for x in held]), 1),
                (2, np.concatenate(held), max(3, math.ceil(FREQUENT * len(held)))),
            ):
                found, n = np.unique(values, return_counts=True)
                found, n = found[n >= least], n[n >= least]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], names=["kind", "value", "n"])

        for batch in batches:
            column = texts(batch.column(0))
            for start, stop in slices(column):
                for tokens in token_sets(column[start:stop], words):
                    held.append(tokens)
                    size += len(tokens)
                    if size >= _WINDOW:
                        yield from counted()
                        held, size = [], 0
        if held:
            yield from counted()

    return docs.select(text_col).mapInArrow(run, "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=256)
def _choose(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def keys_of(tokens: np.ndarray, bound: int, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Buckets of a set: even keys for subsets (small sets), odd ones for inverted lists."""
    n = len(tokens)
    if n < smallest(percent):
        return np.zeros(0, np.int64)
    length = prefix(n, SUBSET, percent)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
        first = tokens[~late][:length]
        if len(first) < length:
            last = tokens[late][np.argsort(rank[at[late]], kind="stable")]
            first = np.concatenate([first, last[: length - len(first)]])
    else:
        first = tokens[:length]
    out = []
    one = np.uint64(1)
    if n < bound:
        i, j = _choose(length)
        out.append(mix(first[i] * np.uint64(0xC2B2AE3D27D4EB4F) + first[j]) & ~one)
    if n >= least_overlap(bound, percent):
        out.append(mix(first[: prefix(n, 1, percent)]) | one)
    return np.unique(np.concatenate(out)).view(np.int64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """256 bits: how many tokens fall on each, modulo 2. Two sets differ in as many tokens at least as in bits."""
    odd = np.bincount((tokens & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def wide(tokens: np.ndarray) -> bytes:
    """As ``sketch``, with as many bits as the set has tokens, rounded up to a power of two."""
    bits = 1 << max(6, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def unlike_bits(a: bytes, b: bytes) -> int:
    """Differing bits of two wide bitmaps; the longer one is folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _described(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, bound: int, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """``(doc_id, digest, n, keys, wide, s0 .. s3)`` of every row; no digest without words."""
    import xxhash

    told = docs.sparkSession.sparkContext.broadcast((frequent, rank))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, order = told.value
        for batch in batches:
            column = texts(batch.column(1))
            for start, stop in slices(column):
                sets = list(token_sets(column[start:stop], words))
                bits = np.array([sketch(x) for x in sets]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                     pa.array([len(x) for x in sets], pa.int64()), pa.array([keys_of(x, bound, late, order, percent) for x in sets], pa.list_(pa.int64())),
                     pa.array([wide(x) for x in sets], pa.binary()), *[pa.array(bits[:, i]) for i in range(4)]],
                    names=["doc_id", "digest", "n", "keys", "wide", *_SKETCH],
                )

    schema = f"doc_id {kind}, digest binary, n long, keys array<long>, wide binary, " + ", ".join(f"{s} long" for s in _SKETCH)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _alike(percent: int) -> F.Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _may_link(percent: int) -> F.Column:
    """Whether sets a and b agree in length and bitmap."""
    both = F.col("n_a") + F.col("n_b")
    overlap = F.floor((percent * both + (99 + percent)) / (100 + percent))
    unlike = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in _SKETCH), F.lit(0))
    return _alike(percent) & (unlike <= both - 2 * overlap)


def _checked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Digests ``(a, b)`` of pairs of names that may be linked by both of their bitmaps."""
    facts = ("name", "digest", "n", "wide", *_SKETCH)
    one, two = (nodes.select(*[F.col(c).alias(f"{c}_{end}") for c in facts]) for end in "ab")
    met = pairs.join(one, "name_a").join(two, "name_b").where(_may_link(percent) & (F.col("digest_a") != F.col("digest_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                overlap = -(-percent * (n + m) // (100 + percent))
                good.append(unlike_bits(x, y) <= n + m - 2 * overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = met.select("digest_a", "digest_b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(run, "a binary, b binary")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _wanted_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(digest, tokens)`` of the sets in some pairs, from the text of one row each."""
    import xxhash

    ends = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    wanted = materialize(nodes.join(ends, "digest", "left_semi").select(F.col("rep").alias("wanted_id"), F.col("digest").alias("wanted")), "wanted")
    ids = wanted.select("wanted_id").distinct()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column(1))
            for start, stop in slices(column):
                sets = [x.tobytes() for x in token_sets(column[start:stop], words)]
                digests = [xxhash.xxh3_128_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "tokens"])

    # A few ids of known number are sent to the scan; more meet the texts in a shuffle.
    ids = F.broadcast(ids) if wanted.count() <= _FEW_WANTED else ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = rows.mapInArrow(run, f"doc_id {kind}, digest binary, tokens binary")
    mine = sets.join(wanted, (F.col("digest") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    return materialize(mine.select("digest", "tokens").dropDuplicates(["digest"]), "sets")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("digest").alias("a"), F.col("tokens").alias("tokens_a"))
    two = sets.select(F.col("digest").alias("b"), F.col("tokens").alias("tokens_b"))
    return materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a binary, b binary"), "links")


def _joined(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, class)`` after more links."""
    if classes is not None:
        links = classes.where("node <> class").select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(links)
    return materialize(components(links), "classes")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    Two rows are linked if the share of their common n-grams is at least
    ``percent`` of all their n-grams. A component is what links connect; its id is its
    least document id, nulls aside (null if it has no other). A null text is an
    empty one; a row without words is linked with nothing and its component is its
    own id. Copies, repeated rows and texts with equal sets share a component, rows
    of equal id are told apart by their sets. Ties need no order. No rows: no rows.
    Other columns are not read.
    """
    if SUBSET > least_overlap(smallest(percent), percent):
        raise ValueError(f"sets alike at {percent} % may share fewer than {SUBSET} tokens")
    statistics = materialize(_statistics(docs, text_col, words), "statistics")
    n_rows = statistics.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    bar = max(2.0, FREQUENT * n_rows)
    late = statistics.where((F.col("kind") == 2) & (F.col("n") >= bar)).orderBy(F.desc("n"), "value").limit(MOST_FREQUENT)
    late = late.select("value", "n").toArrow()
    frequent, count = late["value"].to_numpy().view(np.uint64), late["n"].to_numpy()
    by_value = np.argsort(frequent)
    frequent, rank = frequent[by_value], count[by_value]
    small = statistics.where((F.col("kind") == 0) & F.col("value").between(smallest(percent), 2 * MOST_SMALL))
    sizes = {r["value"]: r["n"] for r in small.select("value", "n").collect()}  # at most 2 * MOST_SMALL rows
    lists = statistics.where((F.col("kind") == 1) & (F.col("n") < bar)).agg(F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).first()[0]
    bound = boundary(sizes, lists or 0.0, percent)

    rows = materialize(_described(docs, id_col, text_col, words, percent, bound, frequent, rank), "rows")
    some, name = rows.where("n > 0"), F.xxhash64("digest")
    facts = [F.first(c).alias(c) for c in ("n", "wide", *_SKETCH)]
    nodes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), *facts).withColumn("name", name), "nodes")
    shared = buckets.shared(some.select(name.alias("name"), "n", F.explode("keys").alias("key")))

    def verified(names: DataFrame) -> DataFrame:
        pairs = materialize(_checked(names, nodes, percent), "pairs")
        return _links(pairs, _wanted_sets(docs, nodes, pairs, id_col, text_col, words), percent)

    classes = _joined(None, verified(buckets.near_pairs(shared, _alike(percent))))
    crowded = buckets.classed(shared, nodes, classes)
    for salt in range(_ROUNDS):
        classes = _joined(classes, verified(buckets.end_pairs(crowded, _alike(percent), salt)))
        crowded = buckets.classed(shared, nodes, classes)
    # Two small sets meet by subsets; that they stand in one inverted list too says nothing.
    useful = (F.col("key").bitwiseAND(F.lit(1)) == 0) | (F.greatest("n_a", "n_b") >= bound)
    joined = _joined(classes, verified(buckets.every_pair(crowded, nodes, ["n", *_SKETCH], useful & _may_link(percent))))

    rooted = nodes.select("digest", "rep").join(joined.withColumnRenamed("node", "digest"), "digest", "left").withColumn("class", F.coalesce("class", "digest"))
    least = rooted.groupBy("class").agg(F.min("rep").alias("component_id"))
    chosen = materialize(rooted.select("digest", "class").join(least, "class").select("digest", "component_id"), "components")
    result = rows.select("doc_id", "digest", F.col("n").alias("n_shingles")).join(chosen, "digest", "left")
    return result.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
