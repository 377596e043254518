import math
import re
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, SF

from binroute.llm import buckets, registry, set_join


def shingled(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))} if found else set()


def brute(rows, percent=85):
    """Every pair of rows ``(doc_id, text)``."""
    sets = [shingled(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(doc_id, ids.get(find(i), doc_id))
    return sorted(((d, len(s), ids.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def joined(df):
    return sorted((tuple(r) for r in set_join.linked(df).collect()), key=repr)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = int(rng.integers(0, len(words)))
        kind = rng.integers(0, 3)
        if kind == 0:
            words[at] = f"n{rng.integers(0, 1 << 30)}"
        elif kind == 1 and len(words) > 2:
            del words[at]
        else:
            words.insert(at, f"i{rng.integers(0, 1 << 30)}")
    return words


def corpus(rng, families, members, lengths):
    rows = []
    for _ in range(families):
        base = [f"w{x}" for x in rng.integers(0, 500, rng.choice(lengths))]
        for _ in range(members):
            rows.append((len(rows), " ".join(edited(rng, base, int(rng.integers(0, 1 + len(base) // 20))))))
    return rows


def test_equals_all_pairs(spark, texts):
    rng = np.random.default_rng(2)
    rows = corpus(rng, 30, 8, [6, 9, 10, 12, 20, 40, 90, 300])
    assert len({r[2] for r in brute(rows)}) > 40
    assert joined(texts(*rows)) == brute(rows)


@pytest.mark.parametrize("crowd", [1, 12])
def test_one_family_that_shares_a_template(spark, texts, monkeypatch, crowd):
    for name in ("near_pairs", "classed"):
        monkeypatch.setattr(buckets, name, partial(getattr(buckets, name), crowd=crowd))
    monkeypatch.setattr(buckets, "every_pair", partial(buckets.every_pair, block=16))
    monkeypatch.setattr(set_join, "FREQUENT", 1 / 20)
    rng = np.random.default_rng(4)
    rows = corpus(rng, 1, 150, [150]) + corpus(rng, 1, 150, [40])
    assert joined(texts(*rows)) == brute(rows)


@pytest.mark.parametrize("bound", [6, 15, 400])
def test_any_boundary_gives_the_same(spark, texts, monkeypatch, bound):
    monkeypatch.setattr(set_join, "boundary", lambda *_: bound)
    rows = corpus(np.random.default_rng(bound), 12, 6, [8, 14, 16, 18, 60])
    assert joined(texts(*rows)) == brute(rows)


def test_prefixes_and_subsets_lose_no_pair():
    rng = np.random.default_rng(0)
    none = np.zeros(0, np.uint64)
    for bound in (6, 20, 100):
        for _ in range(1500):
            pool = np.unique(rng.integers(0, 1 << 62, 80).astype(np.uint64))
            late = np.sort(rng.choice(pool, int(rng.integers(0, 40)), replace=False))
            rank = rng.integers(0, 5, len(late))
            rng.shuffle(pool)
            n = int(rng.integers(6, 60))
            a, b = np.sort(pool[:n]), np.sort(pool[int(rng.integers(0, 1 + n // 8)) : n + int(rng.integers(0, 6))])
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 85 * (len(a) + len(b) - shared) and len(a) and len(b) and shared < max(len(a), len(b)):
                keys = [set(set_join.keys_of(x, bound, late, rank).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]
                bits = (set_join.sketch(a) ^ set_join.sketch(b)).view(np.uint8)
                assert np.unpackbits(bits).sum() <= len(a) + len(b) - 2 * shared
                assert set_join.unlike_bits(set_join.wide(a), set_join.wide(b)) <= len(a) + len(b) - 2 * shared
    assert not len(set_join.keys_of(np.arange(5, dtype=np.uint64), 20, none, none))


def test_wide_bitmaps_tell_long_sets_apart():
    rng = np.random.default_rng(1)
    for n in (100, 1000, 1025, 20000):
        a, b = (np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64)) for size in (n, n - n // 20))
        assert set_join.unlike_bits(set_join.wide(a), set_join.wide(b)) > 0.3 * n
        assert set_join.unlike_bits(set_join.wide(a), set_join.wide(a)) == 0


def test_boundary_follows_cost():
    sizes = {n: 100 for n in range(1, 400)}
    assert set_join.boundary(sizes, 0.0) == set_join.smallest() == 6  # nothing to gain from subsets
    assert 6 < set_join.boundary(sizes, 3.0) < set_join.boundary(sizes, 30.0)
    assert set_join.boundary({}, 1.0) == 6


def test_token_sets():
    column = pa.array(["A b\tC d e", "a B c D", "one Two", "", " \n", "É é"])
    sets = list(set_join.token_sets(column))
    assert [len(x) for x in sets] == [2, 1, 1, 0, 0, 1] and sets[1][0] in sets[0]


def test_odd_rows(spark, texts):
    near = "a b c d e f g h i j k l m n o p q r s t"
    rows = [*ODD, (20, near), (21, near.upper()), (22, near + " u"), (19, near + " u v"), (22, "other text"), (None, near + " w"), (None, "lone words")]
    assert joined(texts(*rows)) == brute(rows)
    assert joined(texts(*rows).where("false")) == []


def test_query_equals_all_pairs_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted((tuple(r) for r in registry.queries()["op13_ngram_join"](spark, SF).collect()), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found == brute(rows) and math.prod(len(r) == 3 for r in found)
