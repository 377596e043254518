"""First moments kept as state: late, earlier, repeated and parallel batches."""

import datetime as dt
import random
import threading
from datetime import timedelta

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from binroute.operators import approval, filters, moments
from binroute.operators import attempts as att
from binroute.sources import schemas
from binroute.sources.moment_store import MomentStore


def at(day, hour=12):
    return dt.datetime(2026, 1, 1, hour) + dt.timedelta(days=day)


def rows_of(seed, n=400):
    """Attempts of three months, with ties, NULLs and payments that span months."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        day = rng.randint(0, 89)
        when = at(day, rng.choice([1, 2])) if rng.random() > 0.05 else None
        rows.append((
            rng.randint(1, 60) if rng.random() > 0.03 else None, rng.choice(["P1", "P2", "P3", None]),
            rng.choice(["approved", "declined", "filtered", None]), rng.choice(["Expired card", "bad", None]), when, at(day).date(),
        ))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.TRANSACTIONS)


def flagged(df):
    return filters.flag_blacklisted(df, filters.blacklist_table(df.sparkSession, ["Expired card"]))


def plain(df):
    return df.withColumn("blacklisted", F.lit(False))


FIRST = ("txid", "processor_name", "status", "created_datetime")
COUNTS = ("txid", "processor_name", "attempts", "total", "total_success")


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_give_the_state_of_all(spark, tmp_path, seed):
    rows = rows_of(seed)
    store = MomentStore(spark, str(tmp_path))
    random.Random(seed).shuffle(rows)
    for start in (0, 250, 330):
        part = rows[start : {0: 250, 250: 330, 330: None}[start]]
        store.merge(moments.first_moments(flagged(frame(spark, part))))
    whole = frame(spark, rows)
    assert tuples(moments.counts(store.read()), *COUNTS) == tuples(att.first_attempt_counts(flagged(whole)), *COUNTS)
    everything = MomentStore(spark, str(tmp_path / "plain"))
    for part in (rows[200:], rows[:200]):
        everything.merge(moments.first_moments(plain(frame(spark, part))))
    assert tuples(moments.per_processor(everything.read()), *FIRST) == tuples(att.first_attempt_per_processor(whole), *FIRST)
    known = whole.where("txid IS NOT NULL AND created_datetime IS NOT NULL")
    assert tuples(moments.first_times(everything.read())) == tuples(att.first_times(known))


def test_a_late_attempt_that_is_earlier_replaces_the_moment(spark, tmp_path):
    store = MomentStore(spark, str(tmp_path))
    day = dt.date(2026, 1, 20)
    store.merge(moments.first_moments(plain(frame(spark, [(1, "P1", "declined", "x", at(19), day), (2, "P1", "approved", "x", at(19), day)]))))
    store.merge(moments.first_moments(plain(frame(spark, [(1, "P2", "approved", "x", at(5), dt.date(2026, 1, 6)), (2, "P3", "approved", "x", at(19), day)]))))
    assert tuples(moments.per_processor(store.read()), "txid", "processor_name", "status") == [
        (1, "P2", "approved"), (2, "P1", "approved"), (2, "P3", "approved"),
    ]
    # An earlier attempt of an earlier month moves the moment there.
    store.merge(moments.first_moments(plain(frame(spark, [(2, "P9", "declined", "x", at(-40), dt.date(2025, 11, 22))]))))
    assert tuples(moments.per_processor(store.read()).where("txid = 2"), "processor_name") == [("P9",)]
    assert tuples(moments.per_processor(store.read("2026-01", "2026-01")).where("txid = 2"), "processor_name") == [("P1",), ("P3",)]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    store = MomentStore(spark, str(tmp_path))
    state = moments.first_moments(plain(frame(spark, rows_of(3, 50))))
    assert store.merge(state, number=0) and not store.merge(state, number=0)
    assert store.merge(state, writer="other", number=0)  # another writer counts on its own
    assert store.log.latest().content["applied"] == {"attempts": 0, "other": 0}
    assert moments.counts(store.read()).agg(F.sum("attempts")).first()[0] == 2 * moments.counts(state).agg(F.sum("attempts")).first()[0]


def test_writers_at_once(spark, tmp_path):
    parts = [rows_of(seed, 60) for seed in range(4)]
    states = [moments.first_moments(flagged(frame(spark, p))) for p in parts]
    threads = [threading.Thread(target=lambda s=s, i=i: MomentStore(spark, str(tmp_path)).merge(s, f"w{i}", 0)) for i, s in enumerate(states)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = MomentStore(spark, str(tmp_path))
    whole = frame(spark, [row for part in parts for row in part])
    assert tuples(moments.counts(store.read()), *COUNTS) == tuples(att.first_attempt_counts(flagged(whole)), *COUNTS)
    before = tuples(store.read().groupBy("month").count())
    store.compact()
    assert all(len(p) == 1 for p in store.parts().values()) and sum(n for _, n in before) >= store.read().count()
    assert tuples(moments.counts(store.read()), *COUNTS) == tuples(att.first_attempt_counts(flagged(whole)), *COUNTS)
    assert len(store.remove_unused(keep=1, grace=timedelta(0))) == 4 and store.remove_unused(grace=timedelta(0)) == []
    assert tuples(moments.counts(store.read()), *COUNTS) == tuples(att.first_attempt_counts(flagged(whole)), *COUNTS)


@pytest.mark.parametrize("start, end", [("2026-01-01", "2026-03-31"), ("2026-01-15", "2026-03-09"), ("2026-02-03", "2026-02-20"), ("2026-01-31", "2026-02-28")])
def test_a_range_that_cuts_months(spark, tmp_path, start, end):
    whole = frame(spark, rows_of(7))
    store = MomentStore(spark, str(tmp_path))
    store.merge(moments.first_moments(flagged(whole)))
    state = store.between(start, end, flagged(whole))
    expected = att.first_attempt_counts(flagged(filters.in_date_range(whole, start, end)))
    assert tuples(moments.counts(state), *COUNTS) == tuples(expected, *COUNTS)
    if (start, end) != ("2026-01-01", "2026-03-31"):
        with pytest.raises(ValueError, match="cuts a month"):
            store.between(start, end)


def test_other_months_are_not_read(spark, tmp_path):
    store = MomentStore(spark, str(tmp_path))
    store.merge(moments.first_moments(plain(frame(spark, rows_of(5)))))
    files = store.read("2026-02", "2026-02").inputFiles()
    assert files and all("month=2026-02/" in f for f in files)
    assert {r["month"] for r in store.read().select("month").distinct().collect()} == {"2026-01", "2026-02", "2026-03"}
    assert MomentStore(spark, str(tmp_path / "none")).read().count() == 0


def test_the_ranking_from_state(spark, tmp_path, customers):
    whole = frame(spark, rows_of(9))
    cards = customers(*[(i, f"{400000 + i % 5}0000") for i in range(1, 61)])
    usable = filters.drop_blacklisted_not_in(whole, ["Expired card"])
    store = MomentStore(spark, str(tmp_path))
    store.merge(moments.first_moments(plain(usable)))
    for bins in (None, ["400001", "400003"]):
        ranked = approval.rank_first(moments.per_processor(store.between("2026-01-01", "2026-03-31")), cards, bins)
        expected = approval.approval_rate_ranked(whole, cards, "2026-01-01", "2026-03-31", bins=bins, errors=["Expired card"])
        assert tuples(ranked, *expected.columns) == tuples(expected)


def test_a_stream_merges_each_batch_once(spark, tmp_path):
    parts = [rows_of(seed, 40) for seed in (11, 12, 13)]
    store = MomentStore(spark, str(tmp_path / "store"))
    merge = lambda batch, number: store.merge(moments.first_moments(plain(batch)), "stream", number)

    def run():
        stream = spark.readStream.schema(schemas.TRANSACTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    whole = frame(spark, [row for part in parts for row in part])
    assert tuples(moments.per_processor(store.read()), *FIRST) == tuples(att.first_attempt_per_processor(whole), *FIRST)
    assert store.log.latest().content["applied"] == {"stream": 2}
