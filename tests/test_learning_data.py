"""Edge cases of encoding, statistics, features, split and routing."""

import random

import pytest
from helpers import tuples
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from binroute.operators import encoding, evaluation, features, profile, routing, split
from binroute.operators.totals import running_totals
from binroute.plans import training as plan
from binroute.sources import schemas


def profile_of(spark, column, values):
    rows = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return rows, encoding.category_profile(rows, [column])


def grown(spark, existing, values):
    _, counted = profile_of(spark, "c", values)
    return tuples(
        encoding.extend_dictionary(encoding.dictionary_frame(spark, {"c": existing}), counted), "category", "code"
    )


def test_unseen_categories_follow_the_largest_code(spark):
    assert grown(spark, {"z": 4}, ["b", "a", "z"]) == [("a", 5), ("b", 6), ("z", 4)]


def test_dictionary_may_start_anywhere(spark):
    assert grown(spark, {"f": 2, "t": 3}, ["x", "f"]) == [("f", 2), ("t", 3), ("x", 4)]
    assert grown(spark, {}, ["b", "a", "a"]) == [("a", 0), ("b", 1)]


def test_trailing_blank_makes_another_category(spark):
    assert grown(spark, {"EUR": 0}, ["EUR ", "EUR"]) == [("EUR ", 1), ("EUR", 0)]


def test_growing_twice_changes_nothing(spark):
    _, counted = profile_of(spark, "c", list("dbca"))
    once = encoding.extend_dictionary(encoding.dictionary_frame(spark, {"c": {"c": 7}}), counted)
    assert tuples(encoding.extend_dictionary(once, counted)) == tuples(once)


def test_mode_tie_takes_the_smallest(spark):
    rows, counted = profile_of(spark, "c", ["b", "a", "b", "a", None, "z"])
    modes = encoding.column_modes(counted)
    assert tuples(modes) == [("c", "a")]
    filled = encoding.impute_modes(rows, modes, ["c"])
    assert tuples(filled.groupBy("c").count()) == [("a", 3), ("b", 2), ("z", 1)]


def test_column_without_values_is_an_error(spark):
    rows, counted = profile_of(spark, "c", [None, None])
    existing = encoding.dictionary_frame(spark, {"c": {"x": 0}})
    with pytest.raises(PySparkException, match="no value to fill"):
        encoding.impute_modes(rows, encoding.column_modes(counted), ["c"]).collect()
    with pytest.raises(PySparkException, match="no code for c NULL"):
        encoding.encode(rows, encoding.fit_encoder(counted, existing), ["c"]).collect()


def test_encode_fills_nulls_and_decode_names_unknown_codes(spark):
    rows, counted = profile_of(spark, "c", ["b", None, "a", "b"])
    encoder = encoding.fit_encoder(counted, encoding.dictionary_frame(spark, {"c": {"b": 9}}))
    assert tuples(encoding.encode(rows, encoder, ["c"])) == [(10,), (9,), (9,), (9,)]
    codes = spark.createDataFrame([(9,), (77,)], "code int")
    assert tuples(encoding.decode(codes, encoder.dictionary, "c", "code", "name")) == [
        (77, "Unknown ID 77"),
        (9, "b"),
    ]


# --- statistics ------------------------------------------------------------------


def training_rows(spark, rows):
    """Rows (bin, processor, status) with constant other columns."""
    full = [(b, "m", "c", s, "t", "EUR", p, "x") for b, p, s in rows]
    return spark.createDataFrame(full, schemas.TRAINING)


SEED = {"status": {"approved": 0, "declined": 1, "filtered": 2}, "is_3d": {"f": 2, "t": 3}}


def prepared(spark, rows, **options):
    return plan.prepare(training_rows(spark, rows), encoding.dictionary_frame(spark, SEED), **options)


@pytest.mark.parametrize("others", [[], ["merchant"], ["merchant", "card_type", "currency", "project_name"]])
def test_one_pass_counts_equal_the_direct_profile(spark, others):
    rng = random.Random(len(others))

    def pick(*values):
        return rng.choice([*values, None])

    rows = spark.createDataFrame(
        [
            (pick(1, 2), pick("m", "n"), pick("c"), pick("approved", "declined"), pick("t", "f"), None, pick("P", "Q"), "x")
            for _ in range(300)
        ],
        schemas.TRAINING,
    )
    counts, counted = plan.category_counts(rows, others)
    assert tuples(counted) == tuples(encoding.category_profile(rows, [*plan.COUNTED, *others]))
    assert tuples(counts) == tuples(rows.groupBy("bin", *plan.COUNTED).agg(F.count("*").alias("n")))


def test_processor_needs_ten_rows(spark):
    rows = [(1, "nine", "approved")] * 9 + [(1, "ten", "approved")] * 10
    ready = prepared(spark, rows)
    names = encoding.decode(
        ready.stats.all_processors, ready.encoder.dictionary, "processor_name", "processor_name_encoded", "name"
    )
    assert tuples(names, "name") == [("ten",)]
    assert ready.rows.count() == 10


def test_rows_of_unsuccessful_bins_do_not_count_towards_ten(spark):
    rows = [(1, "A", "approved")] * 6 + [(2, "A", "declined")] * 6 + [(1, "B", "approved")] * 10
    assert prepared(spark, rows).rows.select("processor_name_encoded").distinct().count() == 1
    assert prepared(spark, rows, require_success=False).rows.count() == 22


def test_null_bin_is_dropped_and_filtered_is_a_failure(spark):
    rows = [(1, "A", "approved")] * 5 + [(1, "A", "filtered")] * 15 + [(None, "A", "approved")] * 4
    stats = prepared(spark, rows).stats
    assert tuples(stats.bin_tx) == [(1, 20)]
    assert tuples(stats.bin_success) == [(1, 0.25)]
    assert tuples(stats.proc_success, "processor_success_rate") == [(0.25,)]
    assert tuples(stats.bin_proc_stats.drop("processor_name_encoded")) == [(1, 20, 5, 0.25)]


def test_fallbacks(spark):
    rows = [(1, "A", "approved")] * 10 + [(2, "B", "approved")] * 10 + [(2, "B", "declined")] * 10
    stats = prepared(spark, rows).stats
    bins = spark.createDataFrame([(1,), (999999,)], "bin long")
    names = ["bin", "processor_name_encoded", "bin_tx_count", "bin_success_rate", "processor_success_rate"]
    names += ["bin_processor_tx_count", "bin_processor_success_count", "bin_processor_success_rate"]
    assert tuples(stats.global_fallback) == [(15.0, 0.75, 15.0, 10.0, 0.75)]
    assert tuples(features.candidate_features(bins, stats, 3), *names) == [
        (1, 0, 10.0, 1.0, 1.0, 10.0, 10.0, 1.0),
        (1, 1, 10.0, 1.0, 0.5, 15.0, 10.0, 0.75),
        (999999, 0, 15.0, 0.75, 1.0, 15.0, 10.0, 0.75),
        (999999, 1, 15.0, 0.75, 0.5, 15.0, 10.0, 0.75),
    ]
    assert tuples(features.candidate_features_nb(bins, stats, 3), *names) == [
        (1, 0, 10.0, 1.0, 1.0, 10.0, 10.0, 1.0),
        (1, 1, 10.0, 1.0, 0.5, 0.0, 0.0, 0.0),
        (999999, 0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0),
        (999999, 1, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0),
    ]
    assert features.candidate_features(bins.where("bin < 0"), stats, 3).count() == 0


# --- running totals and split ----------------------------------------------------


def test_running_totals_match_brute_force(spark):
    rng = random.Random(3)
    values = rng.sample(range(100_000), 2_000)
    data = [(v % 3, v, rng.randint(0, 9)) for v in values]
    frame = spark.createDataFrame(data, "g int, v int, x int")
    got = {row.v: row.total for row in running_totals(frame, [F.desc("v")], {"total": "x"}, within=["g"]).collect()}
    for g in range(3):
        total = 0
        for _, v, x in sorted((d for d in data if d[0] == g), key=lambda d: -d[1]):
            total += x
            assert got[v] == total
    everything = running_totals(frame, [F.col("v")], {"total": "x"})
    assert everything.agg(F.max("total")).first()[0] == sum(x for _, _, x in data)


@pytest.mark.parametrize("hot", [0, 700])
def test_split_is_exact_even_with_many_copies(spark, hot):
    """A third of all rows may be copies of one row at the very cut."""
    rng = random.Random(hot)
    data = [(i, int(rng.random() < 0.3), rng.randrange(2**32)) for i in range(1500)]
    data += [(-1, 0, 2**31 // 8)] * hot + [(-2, 1, 2**31 // 5)] * hot
    frame = spark.createDataFrame(data, "id int, label int, k long").repartition(7)
    got = split.stratified_split(frame, "label", F.col("k")).collect()
    assert len(got) == len(data)
    n, test = len(data), -(-len(data) // 5)
    ones = sum(d[1] for d in data)
    shares = [(n - ones) * (n - test), ones * (n - test)]
    train = [s // n for s in shares]
    if sum(train) < n - test:
        train[max((0, 1), key=lambda c: (shares[c] % n, -c))] += 1
    for label, size in ((0, n - ones), (1, ones)):
        chosen = sorted(r.k for r in got if r.label == label and r.is_holdout)
        assert chosen == sorted(d[2] for d in data if d[1] == label)[: size - train[label]]


def test_split_does_not_depend_on_files(spark, tmp_path):
    rows = [(i % 50, i % 2, 7) for i in range(700)]  # one key for all rows, each row several times
    found = []
    for files in (1, 7):
        path = str(tmp_path / str(files))
        spark.createDataFrame(rows, "id int, label int, k long").repartition(files).write.parquet(path)
        found.append(tuples(split.stratified_split(spark.read.parquet(path), "label", F.col("k"))))
    assert found[0] == found[1] and sum(r[3] for r in found[0]) == 140
    assert sorted(r[:3] for r in found[0]) == sorted(rows)


def test_quotas_of_very_large_classes(spark):
    counts = spark.createDataFrame([(0, 6 * 10**12 + 3), (1, 4 * 10**12 + 1)], "label int, n long")
    n, test = 10**13 + 4, 2 * 10**12 + 1
    shares = [(6 * 10**12 + 3) * (n - test), (4 * 10**12 + 1) * (n - test)]
    train = [share // n for share in shares]
    train[0 if shares[0] % n >= shares[1] % n else 1] += n - test - sum(train)
    assert tuples(split.class_quotas(counts, "label")) == [
        (0, 6 * 10**12 + 3 - train[0]),
        (1, 4 * 10**12 + 1 - train[1]),
    ]


def test_split_of_tiny_classes(spark):
    frame = spark.createDataFrame([(0, 1)] * 3 + [(1, 2)], "label int, k long")
    got = split.stratified_split(frame, "label", F.col("k"))
    assert tuples(got.groupBy("label", "is_holdout").count()) == [(0, False, 2), (0, True, 1), (1, False, 1)]


# --- evaluation ------------------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double, prediction int")


def test_auc_counts_a_tie_half(spark):
    rows = scored(spark, [(1, 0.9, 1), (0, 0.8, 1), (1, 0.7, 1), (0, 0.7, 1), (0, 0.1, 0)])
    assert evaluation.auc(rows).first()[0] == 0.75
    assert tuples(evaluation.roc(rows), "fpr", "tpr") == [
        (0.0, 0.0),
        (0.0, 0.5),
        (1 / 3, 0.5),
        (2 / 3, 1.0),
        (1.0, 1.0),
    ]
    assert (None, 1.0, 0.0) in tuples(evaluation.precision_recall(rows))


def test_report_without_predicted_positives(spark):
    report = {r["class"]: r for r in evaluation.classification_report(scored(spark, [(1, 0.1, 0), (0, 0.2, 0)])).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1, report["1"].support) == (0.0, 0.0, 0.0, 1)
    assert report["0"].precision == 0.5 and report["accuracy"].f1 == 0.5
    assert report["macro avg"].precision == 0.25 and report["weighted avg"].support == 2


def test_correlation_puts_constant_columns_last(spark):
    rows = spark.createDataFrame([(0, 1, 5, 3), (1, 2, 5, 2), (2, 3, 5, 1)], "s int, up int, same int, down int")
    got = profile.correlation(rows, ["same", "down", "up", "s"], "s").collect()
    assert [r.column_name for r in got][2:] == ["down", "same"]
    assert got[0].correlation == pytest.approx(1) and got[1].correlation == pytest.approx(1)
    assert got[2].correlation == pytest.approx(-1) and got[3].correlation is None


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")], "a int, b string")
    assert tuples(profile.dedup_profile(rows)) == [(5, 3, 2)]
    assert profile.dedup_rows(rows).count() == 3
    assert tuples(profile.null_profile(rows)) == [("a", 0, 5, 2), ("b", 2, 5, 2)]


# --- routing ---------------------------------------------------------------------


def candidates(spark, rows):
    return spark.createDataFrame(rows, "bin long, processor_name_encoded int, processor string, score double")


def test_external_only_where_no_internal_is_good(spark):
    rows = candidates(
        spark,
        [(1, 0, "in", 0.79), (1, 1, "x1", 0.1), (1, 2, "x2", 0.2), (1, 3, "x3", 0.3), (1, 4, "x4", 0.4)]
        + [(2, 0, "in", 0.80), (2, 1, "x1", 0.99)],
    )
    routed = routing.route_internal_first(rows, ["x1", "x2", "x3", "x4"])
    assert tuples(routed, "bin", "rank", "processor") == [(1, 1, "x4"), (1, 2, "x3"), (1, 3, "x2"), (2, 1, "in")]


def test_top_processors_keep_code_order_on_equal_scores(spark):
    rows = candidates(spark, [(1, 5, "b", 0.5), (1, 2, "c", 0.50001), (1, 3, "d", 0.1), (1, 4, "e", 0.9)])
    top = routing.top_processors(rows, ["e"], top_n=3, threshold=0.2)
    assert tuples(top, "Rank", "Processor", "Predicted Success %", "Fallback External") == [
        (1, "e", 90.0, "Yes"),
        (2, "c", 50.0, "No"),
        (3, "b", 50.0, "No"),
    ]


def test_predictions_join_the_report_from_the_right(spark):
    top = routing.top_processors(candidates(spark, [(1, 0, "a", 0.5), (1, 1, "gone", 0.4)]), [])
    report = spark.createDataFrame([("1", "a", 7), ("1", "new", 8)], "BIN string, Processor string, total int")
    joined = routing.predicted_vs_actual(top, report)
    assert tuples(joined, "Processor", "Predicted Success %", "total") == [("a", 50.0, 7), ("new", None, 8)]
