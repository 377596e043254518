import numpy as np
import public_tokenizers
import pytest
from llm_helpers import SF
from test_near_duplicates import plain_classes
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from binroute.sources.scratch import materialize


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, in order."""
    from binroute.llm import workers

    workers.prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "passages", "packing"]
    assert all(df.columns == kept[0].columns and df.dtypes == kept[0].dtypes for df in kept[:-1])


def test_filters_keep_clean_documents(kept, spark):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    documents, language, quality = (rows(df) for df in kept[:3])
    assert len(language) >= 0.99 * len(documents)
    good = [d for d in language if marks.get(d) == 1]
    assert sum(d in quality for d in good) >= 0.97 * len(good)
    assert all(quality[d] == documents[d] for d in quality)


def test_one_of_each_class(kept):
    before, after = rows(kept[2]), rows(kept[3])
    expected = plain_classes([(d, r["text"]) for d, r in before.items()])
    assert set(after) == set(expected.values())


def test_passages_are_cut_to_one_copy(kept):
    before, after = rows(kept[3]), rows(kept[4])
    where = {}
    for doc, row in after.items():
        words = row["text"].split()
        assert row["n_chars"] == len(row["text"])
        for at in range(len(words) - 49):
            where.setdefault(tuple(words[at : at + 50]), set()).add(doc)
    assert all(len(docs) == 1 for docs in where.values())
    assert all(after[d] == before[d] or len(after[d]["text"]) < len(before[d]["text"]) for d in after)


def test_packing_holds_every_token(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {d: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in rows(kept[4]).items()}
    found = {}
    for r in kept[5].collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == expected


def test_run_gives_the_same_documents(kept, spark):
    found = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in found.collect()} == {r["doc_id"] for r in kept[5].collect()}


CLASHES = [
    "__id", "__digest", "__rows", "__text", "__own", "__node", "__first", "__cuts", "__declared", "__suffix", "__host", "__fit", "__prior",
    "__host_name", "__sums", "__odds", "__good", "__held", "__group", "scores", "language", "posterior", "kept", "digest", "node", "class", "rank", "a.b",
]


def test_columns_of_any_name_stay(kept, spark):
    """Every internal name as a column of the caller: the same rows come out, with the caller's values."""
    from pyspark.sql import functions as F

    marked = lambda df: df.withColumns({c: F.concat(F.lit(c + "/"), F.col("doc_id").cast("string")) for c in CLASHES})
    for before, after, (name, stage) in zip(kept[:4], kept[1:5], corpus_pipeline.STAGES[:4], strict=True):
        found = materialize(stage(spark, marked(before), SF), "clash")
        assert found.columns == [*before.columns, *CLASHES], name
        assert sorted(map(str, found.collect())) == sorted(map(str, marked(after).collect())), name
    pieces = corpus_pipeline.STAGES[4][1](spark, marked(kept[4]), SF)
    assert pieces.agg(F.sum("length")).first()[0] == kept[5].agg(F.sum("length")).first()[0]


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "empty")
    assert docs.count() == 0 and np.array(docs.columns).size == 7
