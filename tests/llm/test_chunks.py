import hashlib
import random

import numpy as np
from llm_helpers import ODD

from binroute.llm import chunks


def plain_boundaries(raw):
    """The gear hash byte by byte and the two masks as written in the definition."""
    ends, start, bits = [], 0, chunks.USUAL.bit_length() - 1
    while start < len(raw):
        end = min(start + chunks.LARGEST, len(raw))
        for at in range(start + chunks.SMALLEST, end):
            h = 0
            for back in range(32):
                if at - 1 - back >= 0:
                    h += int(chunks._GEAR[raw[at - 1 - back]]) << back
            h &= 0xFFFFFFFF
            if h >> (32 - bits - 2 if at - start < chunks.USUAL else 32 - bits + 2) == 0:
                end = at
                break
        ends.append(end)
        start = end
    return ends


def test_boundaries_equal_the_plain_walk():
    rng = random.Random(2)
    for size in (0, 1, 15, 16, 17, 64, 300, 2500):
        raw = bytes(rng.choices(b"etaoin shrdlu,.\n", k=size))
        assert chunks.boundaries(np.frombuffer(raw, np.uint8)) == plain_boundaries(raw)


def test_insertion_moves_few_chunks():
    rng = random.Random(4)
    raw = bytes(rng.choices(range(32, 127), k=20000))
    a, b = chunks.chunk_set(raw), chunks.chunk_set(raw[:9000] + b"something new" + raw[9000:])
    assert chunks.containment(a, b) > 0.95
    assert chunks.parse(chunks.render(a)) == a
    assert chunks.containment(a, a) == 1 and chunks.containment({}, {}) == 1 and chunks.containment({}, a) == 0


def test_edited_texts_follow_the_next_document(texts, spark):
    rows = [(i, t) for i, t in ODD if i is not None and i != 5]
    found = {r["doc_id"]: r for r in chunks.compare_with_edits(texts(*rows)).collect()}
    assert len(found) == len(rows)
    ordered = sorted(rows)
    for at, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = found[doc]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == chunks.render(chunks.chunk_set(text.encode()))
        assert row["edited_fingerprint"] == chunks.render(chunks.chunk_set(edited.encode()))
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert text != edited or row["near_edited"] == 1


def test_repeated_rows_null_ids_and_many_slices(texts, spark):
    assert chunks.compare_with_edits(texts(*ODD)).count() == len(ODD)
    many = spark.range(3000).selectExpr("id * 7 AS doc_id", "repeat(cast(id AS string), 20) AS text")
    rows = sorted(chunks.compare_with_edits(many).collect())
    assert [r["doc_id"] for r in rows] == [7 * i for i in range(3000)]
    for i in (0, 1, 1499, 2999):
        text, after = str(i) * 20, str((i + 1) % 3000) * 20
        half = len(text) // 2
        assert rows[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_one_row_and_none(texts):
    row = chunks.compare_with_edits(texts((3, "alone"))).first()
    assert row["edited_sha256"] == hashlib.sha256(b"aloal").hexdigest() and row["near_next"] == 1
    assert chunks.compare_with_edits(texts((1, "x")).where("doc_id > 1")).count() == 0
    assert chunks.fingerprints(texts(*ODD)).count() == len(ODD)
