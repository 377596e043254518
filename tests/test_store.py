"""The commit log, runs published side by side, removal of old runs, and statistics that grow."""

import threading
from datetime import timedelta

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from binroute.operators import encoding
from binroute.plans import refresh
from binroute.plans import training as plan
from binroute.sources import schemas, writers
from binroute.sources.commits import CommitLog, Conflict

SCHEMA = "bin long, " + ", ".join(f"{c} string" for c in schemas.CATEGORICAL) + ", month string"
SEED = {"status": {"approved": 0, "declined": 1, "filtered": 2}, "is_3d": {"f": 2, "t": 3}}


def rows_of(spark, processors, bins=(510123, 462263), times=20, flags="ft", month="2026-01"):
    rows = [
        (b, "m", "Visa", "approved" if (i + j) % 3 else "declined", flags[i % len(flags)], "EUR", p, "x", month)
        for b in bins
        for j, p in enumerate(processors)
        for i in range(times)
    ]
    return spark.createDataFrame(rows, SCHEMA).drop("month")


def seed(spark):
    return encoding.dictionary_frame(spark, SEED)


# --- commit log ------------------------------------------------------------------


def test_a_version_can_be_claimed_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.latest() is None
    first = log.append(None, {"a": 1})
    with pytest.raises(Conflict):
        log.append(None, {"a": 2})
    log.append(first, {"a": "ü"})
    assert log.versions() == [1, 2] and log.latest().content == {"a": "ü"} and log.read(1).content == {"a": 1}
    log.forget([1, 2])
    assert log.versions() == [2]  # the latest stays
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["00000000000000000002.json"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")

    def add(name):
        log = CommitLog(spark, path)
        for i in range(5):
            log.update(lambda now: {"seen": [*(now.content["seen"] if now else []), f"{name}{i}"]})

    threads = [threading.Thread(target=add, args=(n,)) for n in "abcdef"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = CommitLog(spark, path).latest()
    assert last.version == 30 and sorted(last.content["seen"]) == sorted(f"{n}{i}" for n in "abcdef" for i in range(5))
    for version in (1, 7, 29):
        assert len(CommitLog(spark, path).read(version).content["seen"]) == version


def test_log_by_a_path_of_another_scheme(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    log.append(None, {"x": None})
    assert CommitLog(spark, str(tmp_path / "log")).latest().content == {"x": None}


# --- runs side by side -----------------------------------------------------------


def interleave(monkeypatch, inner):
    """Run ``inner`` once within the first retraining, after it has read the store."""
    fit, calls = plan.retrain, []

    def retrain(*args, **options):
        calls.append(1)
        done = fit(*args, **options)
        if len(calls) == 1:
            inner()
        return done

    monkeypatch.setattr(plan, "retrain", retrain)
    return calls


def test_interleaved_retrains_give_unique_codes(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    calls = interleave(monkeypatch, lambda: plan.retrain_and_publish(rows_of(spark, ("P2", "P5")), base, seed(spark), trees=2))
    done = plan.retrain_and_publish(rows_of(spark, ("P1", "P2", "P3")), base, seed(spark), trees=2)
    assert len(calls) == 2  # the outer run was not fitted again
    latest = writers.load_latest(spark, base)
    codes = tuples(latest.dictionary.where("column_name = 'processor_name'"), "category", "code")
    assert codes == [("P1", 2), ("P2", 0), ("P3", 3), ("P5", 1)]
    assert tuples(done.encoder.dictionary) == tuples(latest.dictionary)
    # Statistics and codes of the outer run fit together.
    named = encoding.decode(latest.stats.pairs, latest.dictionary, "processor_name", "processor_name_encoded", "p")
    alone = plan.prepare(rows_of(spark, ("P1", "P2", "P3")), seed(spark))
    own = encoding.decode(alone.stats.pairs, alone.encoder.dictionary, "processor_name", "processor_name_encoded", "p")
    assert tuples(named.drop("processor_name_encoded")) == tuples(own.drop("processor_name_encoded"))
    null_code = done.encoder.lookup.where("column_name = 'processor_name' AND category IS NULL").first()["code"]
    assert null_code in {2, 0, 3}
    assert writers.log(spark, base).versions() == [1, 2]


def test_a_moved_code_of_a_feature_needs_a_new_fit(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    calls = interleave(monkeypatch, lambda: plan.retrain_and_publish(rows_of(spark, ("P1",), flags="fx"), base, seed(spark), trees=2))
    plan.retrain_and_publish(rows_of(spark, ("P1",), flags="fy"), base, seed(spark), trees=2)
    assert len(calls) == 3
    flags = tuples(writers.load_latest(spark, base).dictionary.where("column_name = 'is_3d'"), "category", "code")
    assert flags == [("f", 2), ("t", 3), ("x", 4), ("y", 5)]


def test_a_reader_looks_at_one_commit(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    plan.retrain_and_publish(rows_of(spark, ("P1",)), base, seed(spark), trees=2)
    read, seen = CommitLog.read, []

    def once(self, version):
        seen.append(version)
        commit = read(self, version)
        plan.retrain_and_publish(rows_of(spark, ("P1", "P9")), base, trees=2) if len(seen) == 1 else None
        return commit

    monkeypatch.setattr(CommitLog, "read", once)
    loaded = writers.load_latest(spark, base)  # another run is published in the middle
    first = {r["category"] for r in loaded.dictionary.where("column_name = 'processor_name'").collect()}
    assert first == {"P1"} and loaded.stats.all_processors.count() == 1
    assert writers.load_latest(spark, base).stats.all_processors.count() == 2


# --- removal ---------------------------------------------------------------------


def test_what_a_kept_run_names_survives_removal(spark, tmp_path):
    base = str(tmp_path)
    for _ in range(3):
        plan.retrain_and_publish(rows_of(spark, ("P1", "P2")), base, seed(spark), trees=2)
    ts = [r["run_ts"] for r in writers.runs(spark, base).orderBy("run_ts").collect()]
    writers.save_dictionary(seed(spark), base, "20200101_000000_000000", None)  # of a run that failed
    assert writers.remove_old_runs(spark, base, keep=2) == ["dictionary/run_ts=20200101_000000_000000"]
    with pytest.raises(ValueError):
        writers.remove_old_runs(spark, base, keep=0)
    gone = writers.remove_old_runs(spark, base, keep=1, grace=timedelta(0))
    # All runs use the dictionary of the first, which therefore stays.
    assert sorted(gone) == sorted(f"{kind}/run_ts={t}" for kind in ("stats", "model") for t in ts[:2])
    assert writers.latest(spark, base)[1].dictionary_run == ts[0]
    assert writers.runs(spark, base).count() == 1 and writers.load_latest(spark, base).stats.pairs.count() == 4


# --- statistics that grow --------------------------------------------------------


def whole(spark, rows):
    ready = plan.prepare(rows, seed(spark))
    return named(ready.stats, ready.encoder.dictionary)


def named(stats, dictionary):
    rows = encoding.decode(stats.pairs, dictionary, "processor_name", "processor_name_encoded", "p")
    return tuples(rows.drop("processor_name_encoded"))


def stored(spark, base):
    run = writers.latest(spark, base)[1]
    return named(writers.load_stats(spark, base, run.stats_run), writers.load_dictionary(spark, base, run.dictionary_run))


def monthly(spark):
    """A BIN whose only success comes late, and a processor that becomes frequent late."""
    plain = [(510123, "m", "Visa", "approved", "t", "EUR", "P1", "x", "2026-01")] * 12
    sad = [(462263, "m", None, "declined", "t", "EUR", "P1", "x", "2026-01")] * 5
    rare = [(510123, "m", "Visa", "declined", "f", "USD", "P2", "x", "2026-01")] * 9
    late = [(462263, "n", "Visa", "approved", "t", "EUR", None, "x", "2026-02"), (510123, "m", "Amex", "approved", "t", None, "P2", "y", "2026-02")]
    return spark.createDataFrame(plain + sad + rare, SCHEMA), spark.createDataFrame(late, SCHEMA)


def test_filters_apply_to_the_sums(spark, tmp_path):
    base = str(tmp_path)
    old, new = monthly(spark)
    refresh.refresh_and_publish(old, F.col("month"), base, seed(spark))
    before = stored(spark, base)
    assert before == whole(spark, old) and {r[0] for r in before} == {510123} and {r[-1] for r in before} == {"P1"}
    refresh.refresh_and_publish(new, F.col("month"), base)
    after = stored(spark, base)
    assert after == whole(spark, old.unionByName(new))
    assert {(r[0], r[-1]) for r in after} == {(510123, "P1"), (462263, "P1"), (510123, "P2")}
    assert {m: len(p) for m, p in writers.latest(spark, base)[1].months.items()} == {"2026-01": 1, "2026-02": 1}


def test_only_the_new_rows_are_scanned(spark, tmp_path, capsys):
    base, old, new = str(tmp_path / "store"), *monthly(spark)
    old.unionByName(new).write.partitionBy("month").parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    refresh.refresh_and_publish(rows.where("month = '2026-01'"), F.col("month").cast("string"), base, seed(spark))
    month = rows.where("month = '2026-02'")
    month.explain()
    assert "PartitionFilters: [isnotnull(month" in capsys.readouterr().out
    for file in (tmp_path / "rows" / "month=2026-01").glob("*.parquet"):
        file.write_bytes(b"")  # a scan of the old month would fail
    refresh.refresh_and_publish(month, F.col("month").cast("string"), base)
    assert stored(spark, base) == whole(spark, old.unionByName(new))


def test_late_rows_and_replaced_months(spark, tmp_path):
    base, old, new = str(tmp_path), *monthly(spark)
    for rows in (old, new, new):
        refresh.refresh_and_publish(rows, F.col("month"), base, seed(spark))
    assert stored(spark, base) == whole(spark, old.unionByName(new).unionByName(new))
    refresh.compact(spark, base)
    assert all(len(p) == 1 for p in writers.latest(spark, base)[1].months.values())
    refresh.refresh_and_publish(new, F.col("month"), base, replace=True)
    assert stored(spark, base) == whole(spark, old.unionByName(new))
    # Counts that no kept run reaches go, those of kept months stay.
    writers.remove_old_runs(spark, base, keep=1, grace=timedelta(0))
    refresh.refresh_and_publish(new, F.col("month"), base)
    assert stored(spark, base) == whole(spark, old.unionByName(new).unionByName(new))


def test_refreshes_at_once_both_count(spark, tmp_path, monkeypatch):
    base, old, new = str(tmp_path), *monthly(spark)
    fit, calls = plan.fit_counts, []

    def fit_counts(*args):
        calls.append(1)
        if len(calls) == 1:
            refresh.refresh_and_publish(new, F.col("month"), base, seed(spark))
        return fit(*args)

    monkeypatch.setattr(plan, "fit_counts", fit_counts)
    refresh.refresh_and_publish(old, F.col("month"), base, seed(spark))
    assert len(calls) == 3 and stored(spark, base) == whole(spark, old.unionByName(new))


def test_a_refresh_keeps_the_model_and_a_retrain_the_months(spark, tmp_path):
    base, old, _ = str(tmp_path), *monthly(spark)
    plan.retrain_and_publish(rows_of(spark, ("P1", "P2")), base, seed(spark), trees=2)
    model = writers.latest(spark, base)[1].model_run
    refresh.refresh_and_publish(old, F.col("month"), base)
    run = writers.latest(spark, base)[1]
    assert run.model_run == model != run.run_ts and writers.load_latest(spark, base).stats.pairs.count() == 1
    plan.retrain_and_publish(rows_of(spark, ("P1", "P2")), base, trees=2)
    assert writers.latest(spark, base)[1].months == run.months
