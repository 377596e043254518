
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from binroute import constants as C  # noqa: E402
from binroute import fixtures as fx  # noqa: E402
from binroute.operators import (  # noqa: E402
    approval,
    attempts,
    encoding,
    evaluation,
    features,
    filters,
    learning,
    moments,
    profile,
    routing,
    split,
)
from binroute.plans import refresh  # noqa: E402
from binroute.plans import training as plan  # noqa: E402
from binroute.sources import readers  # noqa: E402
from binroute.sources.readers import read_bin_csv, read_csv, read_dictionary_json, read_training_csv  # noqa: E402
from binroute.sources.schemas import CATEGORICAL, FEATURES  # noqa: E402
from binroute.sources.scratch import materialize, scratch_path  # noqa: E402
from binroute.sources import layout, writers  # noqa: E402
from binroute.sources.moment_store import MomentStore  # noqa: E402
from binroute.sources.writers import write_dictionary_json, write_report_csv  # noqa: E402

try:  # the text operators are an optional part: they, or the libraries that only they need, may be absent
    import corpus_pipeline  # noqa: F401
    from binroute.llm import registry as llm
except ModuleNotFoundError as missing:
    if missing.name.startswith("binroute") and not missing.name.startswith("binroute.llm"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

WHOLE = oracles.WHOLE
YEAR = oracles.YEAR
SELECTED = ("400001", "400002", "400003", "400007")
# The codes that features need; the other columns are not encoded for them.
NEEDED = ("status", "is_3d", "processor_name")


def entry(spark: SparkSession) -> DataFrame:
    return approval.by_rank(_ranked(spark, "/root/testdata/sf0.001"))


# --- approval --------------------------------------------------------------------


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fx.transactions(spark, sf), fx.customers(spark, sf), filters.blacklist_table(spark)


def _all_bins(spark: SparkSession, sf: str) -> DataFrame:
    return fx.customers(spark, sf).select(attempts.bin_of(F.col("card_no")).cast("long").alias("bin")).distinct()


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    txn, cards, _ = _inputs(spark, sf)
    return approval.approval_rate_ranked(txn, cards, *WHOLE)


def _text_bins(spark: SparkSession, sf: str) -> DataFrame:
    """BINs that are no plain numbers, wanted through a frame."""
    txn = fx.transactions(spark, sf)
    wanted = spark.createDataFrame([(b,) for b in oracles.TEXT_BINS], "bin string")
    return approval.by_rank(approval.approval_rate_ranked(txn, fx.lettered_customers(spark, sf), *WHOLE, bins=wanted))


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    txn, cards, _ = _inputs(spark, sf)
    return approval.approval_rate_ranked(txn, cards, *YEAR, bins=SELECTED)


def _stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return approval.bin_processor_stats(*_inputs(spark, sf), as_of=WHOLE[0])


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return approval.report_ranked(_ranked(spark, sf), fx.EXTERNAL)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means depend on summation order in the last bits; results show six digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _dated(attempt_rows: DataFrame) -> DataFrame:
    """Dates as text: clients differ in the type they give a date."""
    return attempt_rows.withColumn("created_date", F.col("created_date").cast("string"))


def _first_usable(spark: SparkSession, sf: str) -> DataFrame:
    return attempts.first_attempt_per_processor(fx.transactions(spark, sf)).select(
        "txid", "processor_name", "status"
    )


def _moment_store(spark: SparkSession, sf: str, blacklist: bool) -> MomentStore:
    """First moments from three batches: the later half of the attempts, the earlier half, and late ones of both."""
    txn = fx.transactions(spark, sf)
    late, second = F.crc32(F.concat_ws("/", "txid", "error_description")) % 5 == 0, F.col("created_date") >= F.lit("1998-07-10").cast("date")
    store = MomentStore(spark, scratch_path(spark, "moments"))
    for number, part in enumerate((second & ~late, ~second & ~late, late)):
        rows = txn.where(part)
        flagged = filters.flag_blacklisted(rows, filters.blacklist_table(spark)) if blacklist else rows.withColumn("blacklisted", F.lit(False))
        store.merge(moments.first_moments(flagged), number=number)
    store.merge(moments.first_moments(txn.withColumn("blacklisted", F.lit(False))), number=2)  # a repeated batch adds nothing
    store.compact()
    return store


def _first_from_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = moments.per_processor(_moment_store(spark, sf, blacklist=False).read())
    return rows.select("txid", "processor_name", "status")


def _stats_from_state(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics from the stored months; the month that the range cuts is read from the attempts."""
    store = _moment_store(spark, sf, blacklist=True)
    flagged = filters.flag_blacklisted(fx.transactions(spark, sf), filters.blacklist_table(spark))
    state = store.between(oracles.STATE_RANGE[0], oracles.STATE_RANGE[1], flagged)
    return approval.stats_of_first(moments.counts(state), fx.customers(spark, sf))


def _ranked_from_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking over attempts stored by month and payment, and cards stored by payment."""
    path = scratch_path(spark, "layout")
    name = "binroute_" + path[-32:]
    layout.write_attempts(fx.transactions(spark, sf), f"{name}_attempts", f"{path}/attempts", buckets=8)
    layout.write_cards(fx.customers(spark, sf), f"{name}_cards", f"{path}/cards", buckets=8)
    stored = layout.read_attempts(spark, f"{name}_attempts", *YEAR)
    return approval.approval_rate_ranked(stored, spark.table(f"{name}_cards"), *YEAR)


# --- BIN input -------------------------------------------------------------------


def _bin_text(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders")
    text = F.concat(
        (400000 + F.col("o_custkey") % 70).cast("string"),
        F.lit(", "),
        F.col("o_orderkey").cast("string"),
        F.lit(","),
        F.lpad((F.col("o_custkey") % 1000).cast("string"), 6, "0"),
        F.lit(" ,x"),
        F.col("o_orderstatus"),
    )
    return filters.bins_from_text(orders.select(text.alias("bins")))


def _bin_csv(spark: SparkSession, sf: str) -> DataFrame:
    holder, bin_no = F.col("o_custkey"), (400000 + F.col("o_custkey") % 70).cast("string")
    value = (
        F.when(holder % 6 == 0, bin_no)
        .when(holder % 6 == 1, F.concat(bin_no, F.lit(".0")))
        .when(holder % 6 == 2, F.lpad((holder % 1000).cast("string"), 6, "0"))
        .when(holder % 6 == 3, F.concat(F.lit("-"), holder.cast("string")))
        .when(holder % 6 == 4, "")
        .otherwise(F.col("o_orderkey").cast("string"))
    )
    path = scratch_path(spark, "bins-csv")
    write_report_csv(fx.table(spark, sf, "orders").select(value.alias("BIN")), path)
    return read_bin_csv(spark, path)


# --- encoding --------------------------------------------------------------------


def _seed(spark: SparkSession) -> DataFrame:
    return encoding.dictionary_frame(spark, oracles.SEED_CODES)


def _training(spark: SparkSession, sf: str) -> DataFrame:
    return fx.training(spark, sf)


def _modes(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.column_modes(encoding.category_profile(_training(spark, sf)))


def _mode_impute(spark: SparkSession, sf: str) -> DataFrame:
    modes = materialize(_modes(spark, sf), "modes")
    return encoding.impute_modes(_training(spark, sf), modes, CATEGORICAL).drop("bin")


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.extend_dictionary(_seed(spark), encoding.category_profile(_training(spark, sf)))


def _encode_column(spark: SparkSession, sf: str) -> DataFrame:
    coded = encoding.encode_column(_training(spark, sf), _seed(spark), "currency")
    return coded.select("l_orderkey", "l_linenumber", "currency", "currency_encoded")


def _encoded(spark: SparkSession, sf: str, columns=CATEGORICAL) -> DataFrame:
    rows = _training(spark, sf)
    encoder = encoding.fit_encoder(encoding.written_profile(rows, columns), _seed(spark))
    return encoding.encode(rows, encoder, columns)


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    coded = _encoded(spark, sf, ["processor_name"])
    named = encoding.decode(coded, _seed(spark), "processor_name", "processor_name_encoded", "processor")
    return named.select("l_orderkey", "l_linenumber", "processor_name_encoded", "processor")


# --- statistics and features -----------------------------------------------------


def _prepared(spark: SparkSession, sf: str, require_success: bool = True) -> plan.Prepared:
    rows = _training(spark, sf).select("bin", *NEEDED, "l_orderkey", "l_linenumber")
    return plan.prepare(rows, _seed(spark), NEEDED, require_success)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf).pairs


def _valid_processors(spark: SparkSession, sf: str) -> DataFrame:
    """Rare processors go after BINs without success have gone."""
    pairs = _pairs(spark, sf)
    return features.valid_processors(pairs.join(features.successful_bins(pairs), "bin", "left_semi"))


def _stats(name: str) -> Query:
    return lambda spark, sf: getattr(_prepared(spark, sf).stats, name)


def _stats_merged(spark: SparkSession, sf: str) -> DataFrame:
    """All statistics after three refreshes: old years, new years, and late rows of both."""
    rows = fx.training(spark, sf, "l_shipdate", "l_returnflag")
    year, late = F.date_format("l_shipdate", "yyyy"), (F.col("l_linenumber") == 7) | (F.col("l_returnflag") == "R")
    base = scratch_path(spark, "store")
    for part in (~late & (year < "1999"), ~late & (year >= "1999"), late):
        stats = refresh.refresh_and_publish(rows.where(part), year, base, _seed(spark))
    names = writers.load_dictionary(spark, base, writers.latest(spark, base)[1].dictionary_run)
    return encoding.decode(stats.pairs, names, "processor_name", "processor_name_encoded", "processor").drop("processor_name_encoded")


def _feature_rows(spark: SparkSession, sf: str, require_success: bool = True) -> DataFrame:
    names = ["l_orderkey", "l_linenumber", "processor_name_encoded", "success_flag", *FEATURES]
    return _prepared(spark, sf, require_success).rows.select(*names)


def _candidate_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Every BIN of the card table and one that no table knows."""
    return _all_bins(spark, sf).unionByName(spark.range(1).select(F.lit(999999).cast("long").alias("bin")))


def _candidate_query(notebook: bool, named: bool = False) -> Query:
    """Features of all candidates; ``named`` adds processor name and a score."""
    build = features.candidate_features_nb if notebook else features.candidate_features

    def run(spark: SparkSession, sf: str) -> DataFrame:
        ready = _prepared(spark, sf, require_success=not notebook)
        flag = encoding.code_of(_seed(spark), "is_3d", "t")
        rows = _rounded(build(_candidate_bins(spark, sf), ready.stats, flag), *FEATURES[4:])
        if not named:
            return rows
        scored = rows.withColumn("score", F.col("bin_processor_success_rate"))
        return encoding.decode(
            scored, ready.encoder.dictionary, "processor_name", "processor_name_encoded", "processor"
        )

    return run


# --- split, evaluation, routing --------------------------------------------------


def _split(spark: SparkSession, sf: str) -> DataFrame:
    key = (
        F.col("l_orderkey") % 2147483647 * 1000003
        + F.col("l_linenumber") * 7919
        + F.col("processor_name_encoded") * 97
        + F.col("success_flag") * 31
    ) % 4294967291
    rows = _feature_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", "bin", "processor_name_encoded", "success_flag"
    )
    return split.stratified_split(rows, "success_flag", key)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """A deterministic score, so that the oracle can check the metrics exactly."""
    score = F.col("bin_processor_success_rate")
    return _feature_rows(spark, sf).select(
        F.col("success_flag").alias("label"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("prediction"),
    )


def _top(spark: SparkSession, sf: str) -> DataFrame:
    return routing.top_processors(_candidate_query(notebook=False, named=True)(spark, sf), fx.EXTERNAL)


def _routed(threshold: float) -> Query:
    scored = _candidate_query(notebook=True, named=True)
    return lambda spark, sf: routing.route_internal_first(scored(spark, sf), fx.EXTERNAL, threshold=threshold)


def _fitted(spark: SparkSession, sf: str, class_weighted: bool, trees: int):
    """A model of the training part, the prepared tables, and the weighted cells it has seen."""
    ready = _prepared(spark, sf, require_success=class_weighted)
    key = plan.content_key(["l_orderkey", "l_linenumber", "processor_name_encoded", "is_3d_encoded"])
    parts = split.stratified_split(ready.rows, "success_flag", key)
    cells = learning.training_cells(parts.where(~F.col("is_holdout")), key)
    return learning.train(cells, class_weighted, trees), ready, cells


def _gbt(class_weighted: bool, trees: int = C.TREES) -> Query:
    """Train on the training part and score every candidate, by the model and by the table of its nodes.

    Both ways give a probability, and the same one.
    """

    def run(spark: SparkSession, sf: str) -> DataFrame:
        model, ready, _ = _fitted(spark, sf, class_weighted, trees)
        flag = encoding.code_of(ready.encoder.dictionary, "is_3d", "t")
        rows = materialize(features.candidate_features(_candidate_bins(spark, sf), ready.stats, flag), "candidates")
        path = scratch_path(spark, "model")
        model.write().save(path)
        keys = ["bin", "processor_name_encoded"]
        by_nodes = learning.score_by_nodes(learning.node_table(spark, path), rows, keys)
        both = learning.score(model, rows).select(*keys, "score").join(by_nodes.withColumnRenamed("score", "by_nodes"), keys)
        same = F.abs(F.col("score") - F.col("by_nodes")) < 1e-9
        return both.select(*keys, F.col("score").between(0, 1).alias("is_probability"), same.alias("agrees_with_nodes"))

    return run


def _training_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows, and whether the model gets more of them right than the commoner class has."""
    model, _, cells = _fitted(spark, sf, class_weighted=False, trees=20)
    share = F.sum(F.col("n") * F.col(learning.LABEL)) / F.sum("n")
    counted = cells.agg(F.sum("n").alias("training_rows"), F.greatest(share, 1 - share).alias("floor"))
    accuracy = learning.training_accuracy(model, cells).scalar()
    return counted.select("training_rows", (accuracy >= F.col("floor")).alias("reaches_floor"))


# --- files -----------------------------------------------------------------------


def _training_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with awkward texts, written as CSV and read back."""
    kind, merchant = F.col("l_linenumber") % 5, F.col("merchant")
    awkward = (
        F.when(kind == 0, F.concat(F.lit('He said "hi", '), merchant))
        .when(kind == 1, F.concat(F.lit("two\nlines, "), merchant))
        .when(kind == 2, "NA")
        .when(kind == 3, "")
        .otherwise(F.concat(F.lit(" "), merchant, F.lit(" ")))
    )
    rows = _training(spark, sf).withColumn("merchant", awkward)
    path = scratch_path(spark, "training-csv")
    write_report_csv(rows.select("status", "l_orderkey", *[c for c in ("bin", *CATEGORICAL) if c != "status"]), path)
    return read_training_csv(spark, path)


def _damaged_csv(spark: SparkSession, sf: str) -> readers.Loaded:
    """Training rows as lines of files, some of which are too long, too short, without a number, or in files with another header."""
    names = ["bin", *CATEGORICAL]
    rows, kind = _training(spark, sf), F.col("l_orderkey") % 13
    number = F.when(kind == 3, F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))).otherwise(F.coalesce(F.col("bin").cast("string"), F.lit("")))
    line = F.concat_ws(",", number, *[F.coalesce(c, F.lit("")) for c in CATEGORICAL])
    line = F.when(kind == 1, F.concat(line, F.lit(",more"))).when(kind == 2, F.substring_index(line, ",", 5)).otherwise(line)
    path = scratch_path(spark, "damaged-csv")
    # As many files as the rows have partitions, each under its header; no task sees more than its partition.
    headed = (kind != 4) & F.col("l_linenumber").isNotNull()
    known = rows.where(headed).select(line.alias(",".join(names)))
    known.write.option("header", True).option("sep", "\u0001").option("quote", "").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)
    # Three files hold another header, those of the lines of kind 4 and of lines without a number have none.
    heads = spark.range(0, 3, 1, 3).select(F.lit(",".join(reversed(names))).alias("line"))
    heads.unionByName(rows.where(~headed).select(line.alias("line"))).write.mode("append").text(path)
    return readers.read_training_csv_tolerant(spark, path, max_share=0.5, columns=names, one_line=True)


def _training_csv_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _damaged_csv(spark, sf).rejects.groupBy("reason", "record").agg(F.count("*").alias("records"))


def _training_csv_kept(spark: SparkSession, sf: str) -> DataFrame:
    return _damaged_csv(spark, sf).rows


def _dictionary_json(spark: SparkSession, sf: str) -> DataFrame:
    """The grown dictionary, one JSON file per column, read back."""
    dictionary = materialize(_dictionary(spark, sf), "dictionary")
    read = []
    for column in CATEGORICAL:
        path = scratch_path(spark, f"{column}-json")
        write_dictionary_json(dictionary, path, column)
        read.append(read_dictionary_json(spark, path, column))
    whole = read[0]
    for other in read[1:]:
        whole = whole.unionByName(other)
    return whole


def _report_csv(spark: SparkSession, sf: str) -> DataFrame:
    report = _report(spark, sf)
    path = scratch_path(spark, "report-csv")
    write_report_csv(report, path)
    return read_csv(spark, path, one_line=True).select(*[F.col(f.name).cast(f.dataType) for f in report.schema])


def queries() -> dict[str, Query]:
    return {
        # approval rates
        "approval_rate_ranked": lambda s, d: approval.by_rank(_ranked(s, d)),
        "approval_rate_selected": lambda s, d: approval.by_rank(_selected(s, d)),
        "approval_rate_text_bins": _text_bins,
        "approval_rate_legacy": lambda s, d: approval.approval_rate_legacy(*_inputs(s, d)[:2], *YEAR),
        "bin_processor_stats": lambda s, d: approval.by_bin(
            approval.bin_processor_stats(*_inputs(s, d), as_of=fx.AS_OF)
        ),
        "bin_processor_stats_all": lambda s, d: approval.by_bin(_stats_all(s, d)),
        "bin_processor_stats_legacy": lambda s, d: approval.by_bin(
            approval.bin_processor_stats_legacy(*_inputs(s, d)[:2], as_of=WHOLE[0])
        ),
        "poor_pairs": lambda s, d: approval.worst_first(approval.poor_pairs(_stats_all(s, d), 5, 30.0)),
        "active_bins": lambda s, d: approval.active_bins(*_inputs(s, d), as_of=fx.AS_OF),
        "active_bins_legacy": lambda s, d: approval.active_bins_legacy(*_inputs(s, d)[:2], as_of=fx.AS_OF),
        "active_processors": lambda s, d: approval.active_processors(
            fx.transactions(s, d), filters.blacklist_table(s), fx.AS_OF
        ),
        "active_processors_legacy": lambda s, d: approval.active_processors_legacy(
            fx.transactions(s, d), as_of=fx.AS_OF
        ),
        # building blocks
        "blacklist_not_in": lambda s, d: _dated(filters.drop_blacklisted_not_in(fx.transactions(s, d))),
        "blacklist_anti_join": lambda s, d: _dated(
            filters.drop_blacklisted_anti(fx.transactions(s, d), filters.blacklist_table(s))
        ),
        "txn_with_bin": lambda s, d: attempts.txn_with_bin(*_inputs(s, d)[:2]),
        "first_attempt_time": lambda s, d: attempts.first_times(fx.transactions(s, d)),
        "first_attempt_ties": lambda s, d: attempts.first_attempts(fx.transactions(s, d)).select(
            "txid", "processor_name", "status"
        ),
        "first_attempt_per_processor": _first_usable,
        "first_attempt_state": _first_from_state,
        "bin_processor_stats_state": _stats_from_state,
        "approval_rate_layout": _ranked_from_layout,
        "bin_split": lambda s, d: features.with_bin_parts(_training(s, d)).select(
            "l_orderkey", "l_linenumber", "bin", "bin_prefix", "bin_suffix"
        ),
        # report
        "report_ranked": _report,
        "report_reranked": lambda s, d: approval.report_reranked(_report(s, d)),
        "processor_distribution": lambda s, d: _rounded(
            approval.processor_distribution(_report(s, d)), "Approval Rate (%)"
        ),
        "external_counts": lambda s, d: approval.most_first(approval.external_counts(_report(s, d))),
        "internal_external_summary": lambda s, d: _rounded(
            approval.internal_external_summary(_report(s, d)), "avg_internal", "avg_external"
        ),
        # BIN input
        "bin_input_text": lambda s, d: filters.bin_list(_bin_text(s, d)),
        "bin_input_text_counts": lambda s, d: filters.bin_counts(_bin_text(s, d)),
        "bin_input_csv": lambda s, d: filters.bin_list(_bin_csv(s, d)),
        "bin_input_csv_counts": lambda s, d: filters.bin_counts(_bin_csv(s, d)),
        # encoding
        "mode_impute": _mode_impute,
        "column_modes": _modes,
        "extend_dictionary": _dictionary,
        "encode_column": _encode_column,
        "encode_all": _encoded,
        "decode_processor": _decoded,
        # statistics and features
        "successful_bins": lambda s, d: features.successful_bins(_pairs(s, d)),
        "valid_processors": _valid_processors,
        "valid_processors_nb": lambda s, d: features.valid_processors(_pairs(s, d)),
        "stats_merged": _stats_merged,
        "all_processors": _stats("all_processors"),
        "bin_tx": _stats("bin_tx"),
        "bin_success": _stats("bin_success"),
        "proc_success": _stats("proc_success"),
        "bin_proc_stats": _stats("bin_proc_stats"),
        "global_fallback": lambda s, d: _rounded(_stats("global_fallback")(s, d), *[
            c for c in FEATURES[4:] if c != "processor_success_rate"
        ]),
        "training_features": _feature_rows,
        "training_features_nb": lambda s, d: _feature_rows(s, d, require_success=False),
        "candidate_features": _candidate_query(notebook=False),
        "candidate_features_nb": _candidate_query(notebook=True),
        # split and profile
        "stratified_split": _split,
        "class_ratio": lambda s, d: split.class_ratio(_split(s, d), "success_flag"),
        "null_profile": lambda s, d: profile.null_profile(_training(s, d)),
        "dedup_rows": lambda s, d: profile.dedup_rows(_training(s, d)),
        "dedup_profile": lambda s, d: profile.dedup_profile(_training(s, d)),
        "status_correlation": lambda s, d: _rounded(
            profile.correlation(
                _encoded(s, d),
                [*[f"{c}_encoded" for c in CATEGORICAL if c != "project_name"], "bin"],
                "status_encoded",
            ),
            "correlation",
        ),
        # evaluation
        "eval_accuracy": lambda s, d: evaluation.accuracy(_scored(s, d)),
        "eval_confusion": lambda s, d: evaluation.confusion(_scored(s, d)),
        "eval_auc": lambda s, d: _rounded(evaluation.auc(_scored(s, d)), "auc"),
        "eval_roc": lambda s, d: evaluation.roc(_scored(s, d)),
        "eval_pr": lambda s, d: evaluation.precision_recall(_scored(s, d)),
        "eval_report": lambda s, d: _rounded(
            evaluation.classification_report(_scored(s, d)), "precision", "recall", "f1"
        ),
        # routing
        "top_processors": _top,
        "route_internal_first": _routed(C.ROUTING_THRESHOLD),
        "route_internal_first_low": _routed(0.40),
        "predicted_vs_actual": lambda s, d: routing.predicted_vs_actual(_top(s, d), _report(s, d)),
        # learning
        "gbt_scores": _gbt(class_weighted=True),
        "gbt_scores_unweighted": _gbt(class_weighted=False, trees=20),
        "training_accuracy": _training_accuracy,
        # files
        "training_csv": _training_csv,
        "training_csv_rejects": _training_csv_rejects,
        "training_csv_kept": _training_csv_kept,
        "dictionary_json": _dictionary_json,
        "report_csv": _report_csv,
    } | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | (llm.oracle_sql() if llm else {})
