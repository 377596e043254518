"""Byte-level BPE: encode with a rank queue over a hierarchical bitmap, and decode.

Every adjacent pair of a pre-token that the vocabulary can merge waits in the
bucket of its rank. Three levels of 64-bit words say which buckets hold
something, so the lowest rank is three find-first-set steps away, whatever the
length of the pre-token. Buckets hold positions in a linked list of parts; an
entry whose pair has changed since is stale and skipped. A pre-token of n bytes
takes time in proportion to n (and the sort of its buckets), not to its square.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import field, slices, texts

#: Pre-tokens kept with their ids, in each of two generations, and the longest kept.
CACHED, CACHED_BYTES = 400_000, 64
#: Pre-tokens merged in one buffer: few enough to stay in the processor's cache.
TOGETHER = 2000
#: Bytes of text encoded at a time.
TEXT_BYTES = 1 << 20


class RankQueue:
    """Positions by rank; the lowest rank that holds any is found by bit tricks."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks + 1)]
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.high = [0] * (ranks // 262144 + 1)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.high[rank >> 18] |= 1 << (rank >> 12 & 63)
        bucket.append(position)

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank and all its positions from left to right."""
        for at, word in enumerate(self.high):
            if word:
                at = at << 6 | (word & -word).bit_length() - 1
                break
        else:
            return None
        word = self.mid[at]
        at = at << 6 | (word & -word).bit_length() - 1
        word = self.low[at]
        rank = at << 6 | (word & -word).bit_length() - 1
        self.low[at] &= ~(1 << (rank & 63))
        if not self.low[at]:
            self.mid[rank >> 12] &= ~(1 << (at & 63))
            if not self.mid[rank >> 12]:
                self.high[rank >> 18] &= ~(1 << (rank >> 12 & 63))
        positions, self.buckets[rank] = self.buckets[rank], []
        positions.sort()
        return rank, positions


class Encoder:
    """Merges of pre-tokens by rank, leftmost first within a rank.

    Many pre-tokens lie one after the other in one buffer and share the queue; no
    pair crosses the edge between two.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)])
        self.pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.whole = {token: np.uint32(rank).astype("<u4").tobytes() for token, rank in ranks.items()}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, four bytes each."""
        if not pieces:
            return []
        rank_of, queue, buckets = self.ranks.get, self.queue, self.queue.buckets
        push, take = queue.push, queue.take
        data = b"".join(pieces)
        n = len(data)
        ends = np.cumsum([len(piece) for piece in pieces])
        edges = np.zeros(n + 1, bool)  # true where a pre-token begins or the data ends
        edges[0] = edges[ends] = True
        edge = edges.tobytes()
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        pairs = np.append(self.pairs[raw[:-1] << 8 | raw[1:]], -1)
        pairs[:-1][edges[1:-1]] = -1
        wanted = pairs.tolist()
        some = np.flatnonzero(pairs >= 0)
        some = some[np.argsort(pairs[some], kind="stable")]
        cuts = np.flatnonzero(np.diff(pairs[some])) + 1
        for group in np.split(some, cuts) if len(some) else ():
            push(wanted[group[0]], int(group[0]))
            buckets[wanted[group[0]]] += group[1:].tolist()
        ids = self.bytes[raw].tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (lowest := take()) is not None:
            rank, positions = lowest
            for turn, at in enumerate(positions):
                if wanted[at] != rank:
                    continue  # stale: the pair has changed
                gone = after[at]
                end = after[at] = after[gone]
                wanted[gone] = wanted[at] = ids[gone] = -1
                ids[at] = rank
                sooner = False
                if not edge[end]:
                    before[end] = at
                    new = rank_of(data[at : after[end]])
                    if new is not None:
                        wanted[at] = new
                        if buckets[new]:
                            buckets[new].append(at)
                        else:
                            push(new, at)
                            sooner = new < rank
                if not edge[at]:
                    left = before[at]
                    new = rank_of(data[left:end])
                    if new is None:
                        wanted[left] = -1
                    else:
                        wanted[left] = new
                        if buckets[new]:
                            buckets[new].append(left)
                        else:
                            push(new, left)
                            sooner = sooner or new < rank
                if sooner:  # only vocabularies out of training order get here
                    for rest in positions[turn + 1 :]:
                        push(rank, rest)
                    break
        parts = np.array(ids)
        stops = (4 * np.cumsum(parts >= 0)[ends - 1]).tolist()
        packed = parts[parts >= 0].astype("<u4").tobytes()
        whole = self.whole.get  # a pre-token in the vocabulary is one id, whatever its merges
        return [whole(piece) or packed[start:stop] for piece, start, stop in zip(pieces, [0, *stops], stops)]  # noqa: B905

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text; pre-tokens seen of late are looked up."""
        split = [self.split(row) for row in rows]
        known = self.recent
        unknown = set(chain.from_iterable(split)).difference(known)
        again = unknown.intersection(self.older)
        known.update((piece, self.older[piece]) for piece in again)
        unknown = [*unknown.difference(again)]
        for at in range(0, len(unknown), TOGETHER):
            some = unknown[at : at + TOGETHER]
            known.update(zip(some, self.merge([piece.encode() for piece in some]), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        for piece in unknown:
            if len(piece) > CACHED_BYTES:
                del known[piece]
        if len(known) > CACHED:
            self.older, self.recent = known, {}
        return out


def read_ranks(path: str) -> bytes:
    """Bytes of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def _ranks(content: bytes) -> dict[bytes, int]:
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


@lru_cache(maxsize=4)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(_ranks(content), pattern)


@lru_cache(maxsize=4)
def _tokens(content: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(content).items()}


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)`` per row; ``ids`` are little-endian unsigned 32-bit integers.

    A null or empty text has no ids; repeated rows and null ids stay as they are;
    other columns of ``docs`` are not read. The vocabulary is read once by the
    driver and is bounded by its file.
    """
    content = read_ranks(ranks_path)
    schema = T.StructType([field(docs, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content, pattern)
        gc.disable()  # nothing here makes cycles, and looking for them costs a fifth of the time
        try:
            for batch in batches:
                column = texts(batch.column(1))
                for start, stop in slices(column, TEXT_BYTES):
                    ids = encoder.encode(column[start:stop].to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[start:stop], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        names=[id_col, "n_tokens", "ids"],
                    )
        finally:
            gc.enable()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``; null ids give null."""
    content = read_ranks(ranks_path)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(content).__getitem__
        for batch in batches:
            rows = batch.column(place).to_pylist()
            out = [None if ids is None else b"".join(map(token, np.frombuffer(ids, "<u4").tolist())) for ids in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)
