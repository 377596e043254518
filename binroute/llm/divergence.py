"""How sources of a language differ in their terms, by hash-consed segment trees.

Each group ``(lang, source)`` gives every kept term of its language a smoothed
probability in billionths. Two groups differ by the sum of the absolute
differences over all kept terms.

A group's counts over the language's term ids form a segment tree, cut into
segments of ``LEAVES`` ids so that one task holds little. Trees are hash-consed:
equal subtrees of counts are one node, wherever and in whichever group they
stand. Two trees are then walked together from their roots; equal pairs of nodes
met on the way are folded into one with a multiplicity, so that each is priced
once. Ids follow falling counts, which puts rare terms, whose subtrees are mostly
alike, next to each other.

Every task takes one segment of two blocks of sources: it holds at most
``2 * BLOCK * LEAVES`` counts, however many sources or terms there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binroute.operators.totals import running_totals
from binroute.sources.scratch import materialize

from .columns import flat, texts

LEAVES, BLOCK = 1024, 32
MIN_DOCS, SMOOTHING, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
_FLUSH = 1 << 24
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Terms of a text column without nulls, and the row of each.

    A term is a maximal run of Latin letters and characters beyond ASCII, with A-Z in lower case.
    """
    data, bounds = flat(column)
    letter = np.concatenate([[False], _LETTER[data], [False]])
    edge = letter[1:] != letter[:-1]
    inner = bounds[1:-1]
    touching = inner[letter[inner] & letter[inner + 1]] if len(inner) else inner  # two rows whose letters meet
    begins, ends = np.flatnonzero(edge & letter[1:]), np.flatnonzero(edge & letter[:-1])
    if len(touching):
        touching = np.unique(touching)
        begins, ends = np.sort(np.concatenate([begins, touching])), np.sort(np.concatenate([ends, touching]))
    kept = _LOWER[data[letter[1:-1]]]
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
    return found, np.searchsorted(bounds[1:], begins, "right")


def _counted(rows: pa.Table) -> pa.RecordBatch:
    """Occurrences and documents of each term of each group in some rows ``(lang, source, text)``."""
    groups = pa.StructArray.from_arrays([rows["lang"].combine_chunks(), rows["source"].combine_chunks()], ["lang", "source"])
    names = {}
    of_row = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
    found, row = terms_of(texts(rows["text"].combine_chunks()))
    words, code = len(found.dictionary), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    in_doc, n = np.unique(row * max(words, 1) + code, return_counts=True)
    key = of_row[in_doc // max(words, 1)] * max(words, 1) + in_doc % max(words, 1)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    group, term = key[first] // max(words, 1), key[first] % max(words, 1)
    langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
    n = np.add.reduceat(n, first) if len(first) else n
    docs = np.diff(np.append(first, len(key)))
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(group)), sources.take(pa.array(group)), found.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)`` of rows ``(lang, source, text)`` without nulls, summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= _FLUSH:
                yield _counted(pa.Table.from_batches(held))
                held = []
        if held:
            yield _counted(pa.Table.from_batches(held))

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(UNIT * (n + 5) / (total + 5 * terms))``, exact at any size."""
    if len(n) and int(n.max()) >= (1 << 62) // UNIT:
        n = n.astype(object)
    return UNIT * (n + SMOOTHING) // (total + SMOOTHING * terms) + 1


class Forest:
    """Segment trees over rows of counts (a power of two wide); equal subtrees are one node.

    ``levels`` lists the children of the nodes from the leaves' parents up, ``roots`` the node of each row.
    """

    def __init__(self, counts: np.ndarray):
        self.leaves, nodes = np.unique(counts, return_inverse=True)
        nodes, size = nodes.reshape(counts.shape), len(self.leaves)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            pairs, above = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs // size, pairs % size))
            nodes, size = above.reshape(len(nodes), -1), len(pairs)
        self.roots = nodes[:, 0]

    def meet(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of leaf counts of rows a and b, and how often each stands.

        Both trees are walked at once; a pair of nodes that is met again joins the
        first, so what is below it is walked, and priced, once.
        """
        left, right, times = self.roots[[a]], self.roots[[b]], np.ones(1, np.int64)
        for at in range(len(self.levels) - 1, -1, -1):
            down = self.levels[at]
            left, right = (np.concatenate([down[0][x], down[1][x]]) for x in (left, right))
            size = len(self.levels[at - 1][0]) if at else len(self.leaves)
            pairs, met = np.unique(left * size + right, return_inverse=True)
            times = np.bincount(met, np.concatenate([times, times]).astype(float), len(pairs)).astype(np.int64)
            left, right = pairs // size, pairs % size
        return self.leaves[left], self.leaves[right], times


_ABSENT = -1


def _segment(rows: pa.Table) -> pa.Table:
    """Distances within one segment between the sources of one or two blocks, in both directions."""
    table = rows.to_pydict()
    facts = [i for i, leaf in enumerate(table["leaf"]) if leaf < 0]
    places = {table["number"][i]: at for at, i in enumerate(facts)}
    width, terms = table["width"][facts[0]], table["terms"][facts[0]]
    counts = np.full((len(facts), 1 << max(width - 1, 0).bit_length()), _ABSENT, np.int64)
    counts[:, :width] = 0
    leaf = np.array(table["leaf"], np.int64)
    some = leaf >= 0
    counts[np.array([places[x] for x in np.array(table["number"])[some].tolist()], np.int64), leaf[some]] = np.array(table["n"], np.int64)[some]
    forest = Forest(counts)
    names, totals = [table["source"][i] for i in facts], [table["n"][i] for i in facts]
    blocks = [table["own"][i] for i in facts]
    two = len(set(blocks)) > 1
    out: dict[str, list] = {"a": [], "b": [], "value": []}
    for a in range(len(facts)):
        for b in range(a):
            if two and blocks[a] == blocks[b]:
                continue  # the block's own task has them
            x, y, times = forest.meet(a, b)
            real = x != _ABSENT
            x, y, times = x[real], y[real], times[real]
            value = int((np.abs(probability(x, totals[a], terms) - probability(y, totals[b], terms)) * times).sum())
            out["a"] += [names[a], names[b]]
            out["b"] += [names[b], names[a]]
            out["value"] += [value, value]
    lang = pa.array([table["lang"][0]] * len(out["a"]), pa.string())
    return pa.table({"lang": lang, "a": pa.array(out["a"], pa.string()), "b": pa.array(out["b"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def _distances(groups: DataFrame, counted: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each ordered pair of sources of a language."""
    last = F.greatest(F.ceil(F.col("terms") / LEAVES).cast("int") - 1, F.lit(0))
    facts = groups.withColumn("segment", F.explode(F.sequence(F.lit(0), last))).select(
        "lang", "segment", "number", "blocks", F.lit(-1).alias("leaf"), F.col("total").alias("n"), "source", "terms",
        F.least(F.lit(LEAVES), F.col("terms") - LEAVES * F.col("segment")).cast("int").alias("width"),
    )
    place = F.col("place") - 1
    named = counted.join(groups.select("lang", "source", "number", "blocks"), ["lang", "source"])
    leaves = named.select(
        "lang", F.floor(place / LEAVES).cast("int").alias("segment"), "number", "blocks", (place % LEAVES).cast("int").alias("leaf"), "n",
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("terms"), F.lit(None).cast("int").alias("width"),
    )
    own = F.floor(F.col("number") / BLOCK).cast("int")
    both = facts.unionByName(leaves).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = both.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")
    priced = dealt.groupBy("lang", "segment", "low", "high").applyInArrow(_segment, "lang string, a string, b string, value long")
    return priced.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))


def _share(n: str, total: str) -> Column:
    """As ``probability``, by the whole-number division of decimals."""
    above = f"cast({n} + {SMOOTHING} as decimal(20,0)) * cast({UNIT} as decimal(10,0))"
    return F.expr(f"{above} div cast({total} + {SMOOTHING} * terms as decimal(20,0)) + 1").cast("long")


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of sources, and the terms that mark a source.

    A null text, language or source counts as an empty one. A language keeps the
    terms of at least ``min_docs`` of its rows; repeated rows count each. Part
    ``pair`` has for each source every other source of the language, at distance 0 if
    the language keeps no terms; a language's only source has none. Part ``term`` has
    the ``top`` terms of a source that are likelier there than in the language. Equal
    values are ranked by item, in the order of its UTF-8 bytes. Texts are read whole.
    No rows: no rows; other columns are not read.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*text)
    every = materialize(rows.groupBy("lang", "source").agg(F.lit(1).alias("one")), "groups")
    counted = materialize(term_counts(rows), "term-counts")
    of_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = of_lang.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n", F.lit(1).alias("one"))
    kept = materialize(running_totals(kept, [F.desc("lang_n"), F.col("term")], {"place": "one"}, within=["lang"]).drop("one"), "kept")
    mine = materialize(counted.drop("docs").join(kept, ["lang", "term"]), "kept-counts")

    lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    total = mine.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = running_totals(every, [F.col("source")], {"number": "one"}, within=["lang"])
    blocks = every.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    groups = numbered.join(blocks, "lang").join(lang, "lang", "left").join(total, ["lang", "source"], "left")
    groups = groups.select("lang", "source", (F.col("number") - 1).cast("int").alias("number"), "blocks", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("terms", "lang_total", "total")])
    groups = materialize(groups, "group-totals")

    shares = mine.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total")})
    terms = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _distances(groups, mine).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)
