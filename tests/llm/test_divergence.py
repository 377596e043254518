import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
from compare import compare, connect
from llm_helpers import ODD, SF

from binroute.llm import divergence, registry

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, place int, number int, blocks int, value string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *row, "t", 1, 2, 3, 4, "v", 5) for i, row in enumerate(rows)], SCHEMA)


def brute(rows, min_docs, top=50):
    """Plain loops over ``(text, lang, source)``."""
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), x or "", s or "") for t, x, s in rows]
    out = set()
    for lang in {x for _, x, _ in found}:
        docs = Counter(w for ws, x, _ in found if x == lang for w in set(ws))
        kept = [w for w, n in docs.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for ws, x, s in found:
            if x == lang:
                counts[s].update(w for w in ws if w in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in counts:
            pairs = [(o, sum(abs(share(counts[s], w) - share(counts[o], w)) for w in kept)) for o in counts if o != s]
            terms = [(w, share(counts[s], w) - share(whole, w)) for w in kept if counts[s][w] and share(counts[s], w) > share(whole, w)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)}
    return out


def audited(spark, rows, **options):
    found = [tuple(r) for r in divergence.audit(frame(spark, rows), **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_terms():
    column = pa.array(["Ab-CD'é漢x", "", "yz", "z 1a_b\U0001f600", "[^`{}~\x7f@]"])
    found, rows = divergence.terms_of(column)
    assert found.to_pylist() == ["ab", "cd", "é漢x", "yz", "z", "a", "b\U0001f600"] and rows.tolist() == [0, 0, 0, 2, 3, 3, 3]
    assert divergence.terms_of(column[2:4])[0].to_pylist() == ["yz", "z", "a", "b\U0001f600"]
    assert len(divergence.terms_of(pa.array([], pa.string()))[0]) == 0


def test_equal_subtrees_are_one_node():
    counts = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [0, 0, 0, 0, 1, 2, 1, 2], [1, 2, 1, 2, 0, 0, 0, 0]])
    forest = divergence.Forest(counts)
    assert forest.roots[0] == forest.roots[2] != forest.roots[1]
    assert [len(level[0]) for level in forest.levels] == [2, 2, 2]  # 12 x 2, 6 x 4 and 3 x 8 places
    for a, b in product(range(3), repeat=2):
        x, y, times = forest.meet(a, b)
        assert Counter(dict(zip(zip(x.tolist(), y.tolist(), strict=True), times.tolist(), strict=True))) == Counter(zip(counts[a].tolist(), counts[b].tolist(), strict=True))
    assert len(forest.meet(0, 2)[0]) == 3


def test_probability_is_exact_for_huge_counts():
    n = np.array([0, 7, 10**15], np.int64)
    assert [int(x) for x in divergence.probability(n, 10**16, 1000)] == [1 + 10**9 * (int(x) + 5) // (10**16 + 5000) for x in n]


def test_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAVES", 4)  # many segments
    monkeypatch.setattr(divergence, "BLOCK", 2)  # and pairs of blocks
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["É", "Ü漢", "ZZ"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))), "xy"[i % 2], f"s{rng.integers(0, 5 + i % 2)}") for i in range(200)]
    rows += rows[:20]
    assert audited(spark, rows, min_docs=5, top=6) == brute(rows, 5, 6)


def test_odd_rows(spark):
    rows = [(text, "a", f"s{i % 3}") for i, (_, text) in enumerate(ODD)] + [("lone text", "b", None), (None, None, "s"), ("x y", None, None), ("", "", "t")]
    assert audited(spark, rows, min_docs=2) == brute(rows, 2)
    none = audited(spark, rows, min_docs=99)  # no term is kept anywhere
    assert none == brute(rows, 99) and {r[4] for r in none} == {0}
    assert audited(spark, rows[:0]) == set()


def test_query_equals_its_sql(spark):
    assert compare(registry.queries()["op11_source_divergence"](spark, SF), connect(SF), registry.oracle_sql()["op11_source_divergence"]) == []
