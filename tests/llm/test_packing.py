from collections import defaultdict

import numpy as np
import public_tokenizers
from llm_helpers import ODD
from tokenizers import Tokenizer

from binroute.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def packed(docs, group=packing.GROUP):
    pieces = packing.tokenize(docs, PATH, public_tokenizers.PATTERN)
    return packing.pack(pieces, packing.expected_pieces(docs), group=group)


def plain_first_fit(lengths, capacity):
    bins, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
        if at == len(bins):
            bins.append(0)
        where[i] = (at, bins[at])
        bins[at] += lengths[i]
    return [where[i] for i in range(len(lengths))]


def test_tree_equals_plain_first_fit():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == plain_first_fit(lengths.tolist(), 100)


def test_every_id_once_and_no_overlap(texts):
    rows = packed(texts(*ODD, (9, "an <|endoftext|> inside")), group=3).collect()
    tokenizer = Tokenizer.from_file(PATH)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(own) == r["length"] <= packing.CAPACITY
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], own))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    text = dict(ODD) | {9: "an <|endoftext|> inside"}
    for doc in (2, 4, 7, 8, 9):
        expected = tokenizer.encode(text[doc], add_special_tokens=False).ids + [1]
        assert [i for _, own in sorted(pieces[doc, len(expected)]) for i in own] == expected
    assert len({(r["doc_id"], r["start"], r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_long_blank_runs(texts):
    cases = {1: "x" + " " * 2_000_000 + "x", 2: "a b" + "\n" * 1_100_000, 3: " \t" * 600_000 + "end"}
    tokenizer = Tokenizer.from_file(PATH)
    pieces = defaultdict(list)
    for r in packed(texts(*cases.items())).collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for doc, text in cases.items():
        assert [i for _, own in sorted(pieces[doc]) for i in own] == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_empty_table(texts):
    assert packed(texts((1, "x")).where("doc_id > 1")).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packed(docs).select("sequence_id", "length").collect()
    used = sum(r["length"] for r in rows)
    assert used / (packing.CAPACITY * len({r["sequence_id"] for r in rows})) > 0.98
