import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, SF
from pyspark.sql import functions as F

from binroute.llm import language

EN = "the cat and the dog went to the house in the rain and they were happy with that"
FR = "le chat et le chien sont dans la maison avec une belle fleur pour les enfants de la ville"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, EN if i % 2 else FR, "en" if i % 2 else "fr", "a.example.com" if i % 2 else "b.example.com") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def identified(docs, model=None):
    rows = language.document_evidence(docs)
    return language.identify(rows, model or language.fit(rows))


def test_trigrams_stay_within_rows():
    buckets, first = language.trigrams(pa.array(["abcd", "", "ab", "xABC"]))
    assert first.tolist() == [0, 2, 2, 2, 4]
    assert buckets[0] == buckets[3]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = language.fit(language.document_evidence(docs.where("doc_id % 2 = 0")))
    other = docs.where("doc_id % 2 = 1").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    row = identified(other, half).agg(F.avg((F.col("language") == F.col("truth")).cast("int")).alias("right"), F.avg(F.col("kept").cast("int")).alias("kept")).first()
    assert row["right"] > 0.97 and row["kept"] > 0.99


def test_posteriors_equal_plain_fusion(corpus, spark):
    rows = language.document_evidence(corpus)
    model = language.fit(rows)
    priors = {r["__host_name"]: r["__prior"] for r in model.hosts.collect()}
    asked = spark.createDataFrame([(1, "maison the", "fr", "a.example.com"), (2, "cat", None, "new.org"), (3, None, "xx", None)], corpus.schema)
    scored = model.posterior(language.document_evidence(asked)).orderBy("doc_id").collect()
    for row in scored:
        buckets, _ = language.trigrams(pa.array([row["text"] or ""]))
        sums = np.round(model.table[buckets].astype(float).sum(axis=0) * language.TEMPER, 6)
        sums = sums + np.array(priors.get(row["source"], model.corpus)) + np.array(model.signals["declared"].get(row["lang"], [0.0] * 5))
        odds = np.exp(sums - sums.max())
        assert row["scores"] == pytest.approx((odds / odds.sum()).tolist(), abs=1e-6)


def test_host_priors_are_smoothed_towards_the_domain(corpus):
    model = language.fit(language.document_evidence(corpus))
    priors = {r["__host_name"]: np.exp(r["__prior"]) for r in model.hosts.collect()}
    corpus_share = np.exp(model.corpus)
    domain = (np.array([20, 20, 0, 0, 0]) + 10 * corpus_share) / 50
    assert priors["a.example.com"] == pytest.approx((np.array([20, 0, 0, 0, 0]) + 10 * domain) / 30)
    assert sum(priors["b.example.com"]) == pytest.approx(1)


def test_hosts_of_one_label_are_smoothed_towards_the_corpus(corpus):
    model = language.fit(language.document_evidence(corpus.withColumn("source", F.regexp_extract("source", r"^\w+", 0))))
    priors = {r["__host_name"]: np.exp(r["__prior"]) for r in model.hosts.collect()}
    assert priors["a"] == pytest.approx((np.array([20, 0, 0, 0, 0]) + 10 * np.exp(model.corpus)) / 30)


def test_a_short_text_follows_host_and_declaration(corpus, spark):
    model = language.fit(language.document_evidence(corpus))
    asked = spark.createDataFrame([(1, "xq", "fr", "b.example.com"), (2, "xq", "en", "a.example.com"), (3, "!!", "en", None)], corpus.schema)
    found = {r["doc_id"]: (r["language"], r["kept"]) for r in identified(asked, model).collect()}
    assert found == {1: ("fr", True), 2: ("en", True), 3: ("und", False)}


def test_odd_rows_and_clashing_names(spark):
    rows = [(*row, None, None, "x", 0.5, [1.0]) for row in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, count string, prior double, p array<double>")
    found = identified(docs)
    assert found.columns == [*docs.columns, "language", "posterior", "kept"]
    assert found.count() == len(ODD)
    assert not any(r["kept"] for r in found.where("text IS NULL OR trim(text) = ''").collect())
    assert identified(docs.where("doc_id > 100")).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "https://m.site.example.fr:80/a?b", '<html class=x LANG="fr-CA"><style>p{}</style><p>Le chat&nbsp;dort</p>'), (2, None, None), (3, "mailto:x", "<p>plain")],
        "page_id long, url string, html string",
    )
    rows = {r["page_id"]: r for r in language.page_evidence(pages).collect()}
    one = rows[1]
    assert (one["__declared"], one["__host"], one["__suffix"]) == ("fr", "m.site.example.fr", "fr")
    assert one["__text"].split() == ["Le", "chat", "dort"]
    assert (rows[2]["__text"], rows[2]["__host"], rows[3]["__host"], rows[3]["__declared"]) == ("", None, None, None)
    found = spark.read.parquet(f"{SF}/pages.parquet")
    evidence = language.page_evidence(found)
    assert language.identify(evidence, language.fit(evidence)).where("kept").count() == found.count()


def test_every_suffix_says_something(spark):
    pages = [(100 * v + i, f"https://h{100 * v + i}.example.s{v:03d}", f"<html lang={'en' if v % 2 else 'fr'}><p>{EN if v % 2 else FR}</p>") for v in range(100) for i in range(3)]
    model = language.fit(language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert all(np.argmax(model.signals["suffix"].get(f"s{v:03d}")) == (0 if v % 2 else 1) for v in (0, 1, 50, 98, 99))
    rare = spark.createDataFrame([(1, EN, "en", "a.x")] * 300 + [(2, FR, "fr", "b.x")] * 20, "doc_id long, text string, lang string, source string")
    rows = language.evidence(rare.unionByName(rare.limit(1).withColumn("source", F.lit("once"))), F.col("text"), F.col("lang"), F.col("source"))
    once = model_weights(rows, "once")
    assert np.argmax(once) == 0


def model_weights(rows, value):
    return language.fit(rows).signals["suffix"].get(value)
