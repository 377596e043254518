"""Files in and out, stored runs, and the scratch folder."""

import pytest
from helpers import tuples

from binroute.operators import encoding, features, learning
from binroute.plans import training as plan
from binroute.sources import readers, schemas, scratch, writers

SEED = {"status": {"approved": 0, "declined": 1, "filtered": 2}, "is_3d": {"f": 2, "t": 3}}


def test_bin_csv(spark, tmp_path):
    (tmp_path / "bins.csv").write_text('note,BIN\na,510123\nb,510123\nc,\nd,"012345"\ne,462263.0\n')
    tokens = readers.read_bin_csv(spark, str(tmp_path / "bins.csv"))
    assert tuples(tokens, "bin") == [(462263,), (510123,), (510123,), (None,), (None,)]
    (tmp_path / "other.csv").write_text("bin\n510123\n")
    with pytest.raises(ValueError, match="no column BIN"):
        readers.read_bin_csv(spark, str(tmp_path / "other.csv"))


def test_training_csv_orders_columns_and_ignores_others(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "status,bin,merchant,extra,card_type,is_3d,currency,processor_name,project_name\n"
        "approved,510123,Café,z,Visa,t,EUR,P1,X \n"
        "declined,462263.0,,z,n/a,f,NULL,P2,\n"
    )
    rows = readers.read_training_csv(spark, str(tmp_path / "t.csv"))
    assert rows.columns == schemas.TRAINING.names
    assert tuples(rows) == [
        (462263, None, None, "declined", "f", None, "P2", None),
        (510123, "Café", "Visa", "approved", "t", "EUR", "P1", "X "),
    ]
    (tmp_path / "short.csv").write_text("bin,status\n1,approved\n")
    with pytest.raises(ValueError, match="merchant"):
        readers.read_training_csv(spark, str(tmp_path / "short.csv"))


HEADER = "bin,merchant,card_type,status,is_3d,currency,processor_name,project_name\n"


def test_training_csv_reads_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        HEADER + '510123,"He said ""hi"", ok",Visa,approved,t,EUR,P1,X\n1,"two\nlines",,declined,f,EUR,"",""\n'
    )
    assert tuples(readers.read_training_csv(spark, str(tmp_path / "q.csv"))) == [
        (1, "two\nlines", None, "declined", "f", "EUR", None, None),
        (510123, 'He said "hi", ok', "Visa", "approved", "t", "EUR", "P1", "X"),
    ]
    (tmp_path / "one.csv").write_text(HEADER + '510123,"a, ""b""",Visa,approved,t,EUR,P1,X\n')
    assert tuples(readers.read_training_csv(spark, str(tmp_path / "one.csv"), one_line=True), "merchant") == [('a, "b"',)]


@pytest.mark.parametrize("row", ["1,m,v,approved,t,EUR,P1,X,too,long", "1,m,v,too short"])
def test_rows_of_another_length_raise(spark, tmp_path, row):
    (tmp_path / "t.csv").write_text(f"{HEADER}1,m,v,approved,t,EUR,P1,X\n{row}\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_training_csv(spark, str(tmp_path / "t.csv")).collect()


def test_a_file_with_another_header_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "1,m,v,approved,t,EUR,P1,X\n")
    (tmp_path / "b.csv").write_text(
        HEADER.replace("merchant,card_type", "card_type,merchant") + "1,v,m,approved,t,EUR,P1,X\n"
    )
    with pytest.raises(Exception, match="header"):
        readers.read_training_csv(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("text", ['{"f": 2, "t": 3', '{"f": 2, "t": "x3"}', '{"f": null}', "[1]", "null", ""])
def test_a_broken_dictionary_raises(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|not an object|no code|malformed"):
        rows = readers.read_dictionary_json(spark, str(tmp_path / "m.json"), "is_3d").collect()
        assert not rows, "an empty file has no row to raise on"
        raise ValueError("not an object")


def test_dictionary_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"f": 2, "t ": 3}')
    assert tuples(readers.read_dictionary_json(spark, str(tmp_path / "m.json"), "is_3d")) == [
        ("is_3d", "f", 2),
        ("is_3d", "t ", 3),
    ]
    assert readers.read_dictionary_json(spark, str(tmp_path / "none.json"), "is_3d").count() == 0


def test_report_csv(spark, tmp_path):
    awkward = spark.createDataFrame([(' a "b", c ', "x\ny"), ("", None)], "p string, q string")
    writers.write_report_csv(awkward.coalesce(1), str(tmp_path / "awkward"))
    assert tuples(readers.read_csv(spark, str(tmp_path / "awkward"), one_line=False)) == [(' a "b", c ', "x\ny"), (None, None)]
    assert '" a ""b"", c "' in next((tmp_path / "awkward").glob("*.csv")).read_text()
    report = spark.createDataFrame([("510123", 12.5)], ["BIN", "Approval Rate (%)"])
    writers.write_report_csv(report, str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert tuples(back, "BIN", "`Approval Rate (%)`") == [("510123", "12.5")]


def test_dictionary_is_written_only_when_it_grew(spark, tmp_path):
    base = str(tmp_path)
    first = encoding.dictionary_frame(spark, {"c": {"a": 0}})
    assert writers.save_dictionary(first, base, "1", None) == "1"
    assert writers.save_dictionary(first, base, "2", "1") == "1"
    more = encoding.dictionary_frame(spark, {"c": {"a": 0, "b": 1}})
    assert writers.save_dictionary(more, base, "3", "1") == "3"
    assert not readers.path_exists(spark, f"{base}/dictionary/run_ts=2")
    assert tuples(writers.load_dictionary(spark, base, "3")) == [("c", "a", 0), ("c", "b", 1)]


def payments(spark, processors=("P1", "P2"), bins=(510123, 462263)):
    rows = [
        (b, "m", "Visa", "approved" if (i + j) % 3 else "declined", "t" if i % 2 else "f", "EUR", p, "x")
        for b in bins
        for j, p in enumerate(processors)
        for i in range(30)
    ]
    return spark.createDataFrame(rows, schemas.TRAINING)


def test_retrain_publish_and_score(spark, tmp_path):
    base = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        writers.load_latest(spark, base)
    seed = encoding.dictionary_frame(spark, SEED)
    done = plan.retrain_and_publish(payments(spark), base, seed, trees=3)
    assert 0.0 <= done.accuracy <= 1.0 and done.holdout.count() == 24
    assert 0.0 <= learning.training_accuracy(done.model, done.cells).first()[0] <= 1.0
    assert done.cells.agg({"n": "sum"}).first()[0] == 96
    assert f"{done.accuracy:.2%}" in done.message
    assert tuples(plan.run_summary(spark, done.accuracy)) == [(0.0, done.accuracy)]
    first = writers.latest_run(spark, base)
    codes = {r.category: r.code for r in writers.load_latest(spark, base).dictionary.collect()}

    plan.retrain_and_publish(payments(spark, ("P0", "P1", "P2")), base, trees=3, stats_from="train")
    assert writers.runs(spark, base).count() == 2 and writers.latest_run(spark, base) > first
    latest = writers.load_latest(spark, base)
    grown = {r.category: r.code for r in latest.dictionary.collect()}
    assert codes.items() <= grown.items() and grown["P0"] == codes["P2"] + 1
    assert latest.stats.all_processors.count() == 3
    assert f"before {done.accuracy:.2%}" in writers.latest(spark, base)[1].message
    # The earlier run is still there as a backup.
    assert writers.load_stats(spark, base, first).all_processors.count() == 2

    bins = spark.createDataFrame([(510123,), (999999,)], "bin long")
    ranked = plan.score_bins(bins, latest, ["P2"], is_3d="t")
    rows = ranked.collect()
    assert sorted((r.BIN, r.Rank) for r in rows) == [(b, k) for b in (510123, 999999) for k in (1, 2, 3)]
    assert all(0 <= r["Predicted Success %"] <= 100 for r in rows)
    assert {r.Processor for r in rows if r["Fallback External"] == "Yes"} == {"P2"}
    # The order is that of the model's own scores.
    flag = encoding.code_of(latest.dictionary, "is_3d", "t")
    scored = learning.score(latest.model, features.candidate_features(bins, latest.stats, flag))
    names = {r.code: r.category for r in latest.dictionary.where("column_name = 'processor_name'").collect()}
    own = sorted((r.bin, -round(r.score * 100, 2), r.processor_name_encoded) for r in scored.collect())
    assert [names[code] for _, _, code in own] == [r.Processor for r in sorted(rows, key=lambda r: (r.BIN, r.Rank))]


def test_two_file_layouts_give_the_same_model(spark, tmp_path):
    rows = payments(spark, ("P1", "P2", "P3"), bins=(510123, 462263, 400001))
    scores = []
    for files in (1, 7):
        path = str(tmp_path / f"rows-{files}")
        rows.repartition(files).write.parquet(path)
        done = plan.retrain(spark.read.parquet(path), encoding.dictionary_frame(spark, SEED), trees=5)
        scored = learning.score(done.model, done.cells)
        scores.append(sorted((r.bin, r.processor_success_rate, r.is_3d_encoded, r.n, r.score) for r in scored.collect()))
        scores.append(sorted(map(tuple, done.holdout.select("label", "score").collect())))
    assert scores[0] == scores[2] and scores[1] == scores[3]


def test_scratch_tables_lie_in_the_folder_of_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = scratch.scratch_dir(spark)
    assert folder == configured.rstrip("/") if configured else spark.sparkContext.getCheckpointDir()
    kept = scratch.materialize(spark.range(3), "kept")
    assert all(f"/binroute/{spark.sparkContext.applicationId}/kept-" in name for name in kept.inputFiles())
    assert all(folder.removeprefix("file:") in name for name in kept.inputFiles())


def test_scratch_tables_can_be_removed(spark, tmp_path):
    kept = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        path = scratch.materialize(spark.range(3), "gone").inputFiles()[0]
        assert str(tmp_path) in path and scratch.remove_scratch(spark)
        assert not readers.path_exists(spark, path)
    finally:
        spark.sparkContext.setCheckpointDir(kept or str(tmp_path))


class OtherSession:
    """A session of a cluster that names no folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default: default)

    class sparkContext:  # noqa: N801
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(OtherSession)
