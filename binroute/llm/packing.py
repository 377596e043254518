"""Packing of documents into training sequences by first-fit decreasing.

Documents become token ids and an end id, cut into pieces of at most one
sequence. Pieces are dealt at random into groups of bounded size; each group
is packed alone. Within a group, pieces go in falling length into the first
sequence with room, which a tournament tree over free capacities finds in
logarithmic time: a node holds the largest room below it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, texts

CAPACITY = 2048
GROUP = 4096


def _byte_of() -> dict[str, int]:
    """Bytes behind the letters of a byte-level vocabulary (a fixed rule of its format)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in kept}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}


@lru_cache(maxsize=1)
def _tokenizer(content: str, pattern: str):
    """The vocabulary of a byte-level ``tokenizers`` file; same ids, less work per text."""
    import tiktoken

    model = json.loads(content)
    byte = _byte_of()
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=1)
def _plain_tokenizer(content: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content)


def _ids(text: str, content: str, pattern: str) -> np.ndarray:
    """Ids of a whole text. Runs of a million blanks are too long for the quicker library's pattern; the other one takes them."""
    try:
        return _tokenizer(content, pattern).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(_plain_tokenizer(content).encode(text, add_special_tokens=False).ids, np.uint32)


def tokenize(
    docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, capacity: int = CAPACITY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces ``(id, start, length, doc_tokens, ids)`` of every document and its end id.

    A null or empty text is the end id alone. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    schema = T.StructType([
        field(docs, id_col), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, lengths, totals, ids = [], [], [], [], []
            for row, text in enumerate(texts(batch.column(1)).to_pylist()):
                own = np.append(_ids(text, content, pattern), [end_id]).astype("<u4")
                for start in range(0, len(own), capacity):
                    piece = own[start : start + capacity]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    totals.append(len(own))
                    ids.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Equal lengths keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for piece in order.tolist():
        need = int(lengths[piece])
        node = 1
        while node < leaves:
            node <<= 1
            if room[node] < need:
                node += 1
        bins[piece], offsets[piece] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node >>= 1
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left > right else right
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(pieces: DataFrame, expected: int, capacity: int = CAPACITY, group: int = GROUP, seed: int = 42) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``expected`` is an estimate of the number of pieces; it sets the number of
    groups, each of about ``group`` pieces. Groups are drawn by hash of the row's
    place, so that neither a hot id nor repeated rows fill one. Empty input gives
    an empty result.
    """
    groups = max(1, ceil(expected / group))
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(names)
        lengths = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(lengths, capacity)
        ids = bins + (key[0].as_py() << 32)
        return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return pieces.withColumn("__group", drawn).groupBy("__group").applyInArrow(run, schema)


def expected_pieces(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY) -> int:
    """One piece a document and one for each ``capacity`` tokens, at four bytes a token."""
    counted = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    return counted["n"] + (counted["b"] or 0) // (4 * capacity)
