import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import ODD, SF
from pyspark.sql import functions as F

from binroute.llm import resampling, selection

def good():
    return F.col("quality") == 1


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality long, text string")


def test_threshold_equals_sorting(spark):
    rng = np.random.default_rng(0)
    values = [*rng.normal(0, 1e4, 300).round(6).tolist(), *[5.0] * 20, -1e9, 1e9]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(selection.as_rank(F.col("v")).alias("rank")).cache()
    ordered = sorted((r["rank"] for r in rows.collect()), reverse=True)
    for k in (1, 2, 7, 100, len(values)):
        assert selection.threshold(rows, "rank", k) == ordered[k - 1]
    assert selection.threshold(rows, "rank", len(values) + 1) == 0
    assert selection.threshold(rows, "rank", 0) > ordered[0]


def test_buckets_of_a_text():
    column = pa.array(["a b, a b", "", "x x", "a b, a b"])
    buckets, first = resampling.features(column)
    assert first.tolist() == [0, 9, 9, 12, 21]
    assert buckets[:9].tolist() == buckets[12:].tolist()
    alone, _ = resampling.features(pa.array(["x x"]))
    assert alone.tolist() == buckets[9:12].tolist()
    other, _ = resampling.features(pa.array(["y y"]))
    assert other[1] == alone[1] and other[0] != alone[0]


def test_counts_and_weights_equal_plain_sums(texts, spark):
    docs = texts((1, "a b a"), (2, "c d"), (3, None), (4, "a b"))
    counted = resampling.count_features(docs, F.col("doc_id") <= 1)
    table = {r["bucket"]: (r["n_raw"], r["n_target"]) for r in counted.collect()}
    raw, wanted = {}, {}
    for doc, text in ((1, "a b a"), (2, "c d"), (4, "a b")):
        for bucket in resampling.features(pa.array([text]))[0].tolist():
            raw[bucket] = raw.get(bucket, 0) + 1
            wanted[bucket] = wanted.get(bucket, 0) + (doc == 1)
    assert table == {b: (raw[b], wanted[b]) for b in raw}
    ratios = resampling.log_ratios(counted)
    found = {r["doc_id"]: r["w"] for r in docs.select("doc_id", resampling.log_weight(ratios, F.col("text")).alias("w")).collect()}
    for doc, text in ((1, "a b a"), (2, "c d"), (3, ""), (4, "a b")):
        assert found[doc] == pytest.approx(sum(ratios[b] for b in resampling.features(pa.array([text]))[0]), abs=1e-6)


def test_held_out_labels(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = resampling.resample(docs, marks, good()).join(marks, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in rows.collect()}
    assert kept[1] > 0.995 and kept[0] < 0.02


def test_odd_rows(texts, spark):
    docs = texts(*ODD)
    rows = resampling.resample(docs, labels(spark, (7, 1, "t"), (8, 0, "t"), (None, 1, "t"), (7, 1, "t")), good()).collect()
    assert len(rows) == len(ODD)
    assert len({(r["log_weight"], r["kept"]) for r in rows if r["doc_id"] == 5}) == 1


def test_nothing_to_learn_from(texts, spark):
    docs = texts((1, "a"), (2, "b"))
    assert [r["kept"] for r in resampling.resample(docs, labels(spark), good()).collect()] == [True, True]
    assert resampling.resample(docs.where("doc_id > 5"), labels(spark, (1, 1, "")), good()).count() == 0


def test_keep_returns_the_documents(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fitted, scored = resampling.fit(docs, marks, good())
    kept = fitted.keep(docs)
    assert kept.columns == docs.columns
    chosen = {r["doc_id"] for r in scored.where(F.col("rank") >= fitted.least_rank).collect()}
    assert {r["doc_id"] for r in kept.collect()} == chosen and len(chosen) >= fitted.k


def test_one_weight_per_held_out_label(spark, monkeypatch):
    seen, cut = [], resampling.best_cut
    monkeypatch.setattr(resampling, "best_cut", lambda scores: seen.append(scores) or cut(scores))
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} u{i} w{j}") for i in range(20) for j in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    held = resampling.labelled_sample(labels, F.col("quality") == 1, bound=20).where("__held").count()
    cuts = [resampling.fit(docs.repartition(n), labels, F.col("quality") == 1, bound=20)[0].cut for n in (1, 7)]
    assert [len(s) for s in seen] == [held, held] and cuts[0] == cuts[1]
