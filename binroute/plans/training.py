"""Retraining and scoring, end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binroute.constants import HOLDOUT_FRACTION, MIN_PROCESSOR_ROWS, SCORES_PER_BIN, TREES
from binroute.operators import encoding, evaluation, features, learning, routing, split
from binroute.sources import writers
from binroute.sources.commits import Conflict
from binroute.sources.scratch import materialize
from binroute.sources.schemas import CATEGORICAL, FEATURES

# The categories behind the features; their codes are needed in any case.
COUNTED = ("status", "is_3d", "processor_name")


@dataclass(frozen=True)
class Prepared:
    encoder: encoding.Encoder
    pairs: DataFrame
    stats: features.Stats
    rows: DataFrame


def counted_sets(training: DataFrame, others: Sequence[str], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows per BIN and counted categories, and per value of each other column, in one pass.

    Grouping sets yield both: a set of BIN and counted categories, and a set for
    each other column, whose codes are only for the result. ``by`` are columns of
    all sets, such as a period.
    """
    together = [*by, "bin", *COUNTED]
    text = training.select(*by, "bin", *[F.col(c).cast("string").alias(c) for c in (*COUNTED, *others)])
    sets = text.groupingSets([together, *[[*by, c] for c in others]], *together, *others)
    counted = materialize(sets.agg(F.count("*").alias("n"), F.grouping_id().alias("_set")), "counts")

    # The grouping id has a bit per column, the last column lowest, set where
    # the column is not in the set.
    bit = {c: 1 << i for i, c in enumerate(reversed([*together, *others]))}
    number = {c: sum(bit.values()) - bit[c] - sum(bit[b] for b in by) for c in others}
    counts = counted.where(F.col("_set") == sum(bit[c] for c in others)).select(*together, "n")
    values = F.coalesce(*[F.when(F.col("_set") == number[c], F.col(c)) for c in others]) if others else F.lit(None).cast("string")
    column = F.coalesce(*[F.when(F.col("_set") == number[c], F.lit(c)) for c in others]) if others else F.lit(None).cast("string")
    single = counted.where(F.col("_set").isin(*number.values())) if others else counted.where(F.lit(False))
    return counts, single.select(*by, column.alias("column_name"), values.alias("category"), "n")


def category_counts(training: DataFrame, others: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows per BIN and counted categories, and the profile of all categories."""
    counts, single = counted_sets(training, others)
    return counts, encoding.category_profile(counts, COUNTED, F.col("n")).unionByName(single)


def fit_counts(
    counts: DataFrame, profile: DataFrame, existing: DataFrame, require_success: bool = True, min_processor_rows: int = MIN_PROCESSOR_ROWS
) -> tuple[encoding.Encoder, DataFrame, features.Stats]:
    """Codes, pair counts and statistics from rows that are counted already.

    Both filters look at the pairs of all counts, so counts of parts of the rows
    must be summed before.
    """
    encoder = encoding.fit_encoder(profile, existing)
    cells = features.labelled(encoding.encode(counts, encoder, COUNTED))
    pairs = features.pair_counts(cells, F.col("n"))
    return encoder, pairs, features.fit_stats(pairs, require_success, min_processor_rows)


def prepare(
    training: DataFrame,
    existing: DataFrame,
    columns: Sequence[str] = CATEGORICAL,
    require_success: bool = True,
    min_processor_rows: int = MIN_PROCESSOR_ROWS,
) -> Prepared:
    """Encode, filter, compute statistics and attach them to every row.

    One pass counts everything that codes, modes and statistics need. ``rows``
    is lazy and costs a second pass when used.
    """
    counts, profile = category_counts(training, [c for c in columns if c not in COUNTED])
    encoder, pairs, stats = fit_counts(counts, profile, existing, require_success, min_processor_rows)
    rows = features.labelled(encoding.encode(training, encoder, columns))
    return Prepared(encoder, pairs, stats, features.training_features(rows, stats))


def content_key(columns: Sequence[str]) -> Column:
    """A 32-bit order key from the content of a row, for splitting."""
    return F.xxhash64(F.lit(42), *columns).bitwiseAND(0xFFFFFFFF)


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    stats: features.Stats
    encoder: encoding.Encoder
    cells: DataFrame
    holdout: DataFrame
    accuracy: float
    message: str


def retrain(
    training: DataFrame,
    existing: DataFrame,
    trees: int = TREES,
    class_weighted: bool = True,
    require_success: bool = True,
    stats_from: str = "all",
    fraction: float = HOLDOUT_FRACTION,
) -> Trained:
    """Fit on 80 % and evaluate on the rest.

    Statistics come from all rows, hold-out included, which flatters the
    hold-out accuracy; ``stats_from="train"`` takes them from the training part.
    """
    ready = prepare(training, existing, require_success=require_success)
    # The key sees all columns, so that few rows share one; only these are kept.
    key = content_key([c for c in ready.rows.columns if c not in FEATURES[4:]])
    base = ["processor_name_encoded", learning.LABEL, *FEATURES[:4]]
    keyed = ready.rows.select(*base, *FEATURES[4:], key.alias("order_key"))
    parts = split.stratified_split(keyed, learning.LABEL, F.col("order_key"), fraction)
    stats = ready.stats
    if stats_from == "train":
        kept = parts.where(~F.col("is_holdout")).select(*base)
        stats = features.fit_stats(features.pair_counts(kept), require_success)
        parts = _reattach(parts.select(*base, "order_key", "is_holdout"), stats)
    cells = learning.training_cells(parts.where(~F.col("is_holdout")), F.col("order_key"))
    model = learning.train(cells, class_weighted, trees)
    scored = learning.score(model, parts.where("is_holdout"))
    holdout = materialize(
        scored.select(F.col(learning.LABEL).alias("label"), "score", "prediction"), "holdout"
    )
    accuracy = evaluation.accuracy(holdout).first()["accuracy"]
    return Trained(model, stats, ready.encoder, cells, holdout, accuracy, run_message(accuracy))


def _reattach(rows: DataFrame, stats: features.Stats) -> DataFrame:
    """Statistics of the training part on all rows; 0 where it has none."""
    joined = (
        rows.join(materialize(stats.bin_tx.join(stats.bin_success, "bin"), "bins"), "bin", "left")
        .join(materialize(stats.proc_success, "processors"), "processor_name_encoded", "left")
        .join(materialize(stats.bin_proc_stats, "pairs"), features.PAIR, "left")
    )
    return joined.na.fill(0)


def run_summary(spark: SparkSession, accuracy: float, old_accuracy: float = 0.0) -> DataFrame:
    """One row: hold-out accuracy of the new model, and of the old one.

    Without a published run the old accuracy is 0.
    """
    return spark.createDataFrame([(old_accuracy, accuracy)], "old_accuracy double, new_accuracy double")


def run_message(accuracy: float, old_accuracy: float = 0.0) -> str:
    return f"hold-out accuracy {accuracy:.2%}, before {old_accuracy:.2%}; the new model is in use"


def recoded(done: Trained, current: DataFrame) -> Trained | None:
    """A trained run with its new categories appended to another dictionary.

    Needed when another run has published a dictionary meanwhile: its codes stay,
    ours follow them. None if the code of a category that the model knows by its
    code would change; then only a new fit helps.
    """
    ours = done.encoder.dictionary
    grown = materialize(encoding.extend_dictionary(current, ours), "dictionary")
    codes = ours.join(grown.withColumnRenamed("code", "_new"), ["column_name", "category"]).where(F.col("code") != F.col("_new"))
    codes = materialize(codes.select("column_name", "code", "_new"), "moved")
    if not codes.where(F.col("column_name").isin("is_3d", "status")).isEmpty():
        return None
    lookup = done.encoder.lookup.join(codes, ["column_name", "code"], "left").select(
        "column_name", "category", F.coalesce("_new", "code").alias("code")
    )
    theirs = grown.join(ours, ["column_name", "category"], "left_anti")
    processors = codes.where(F.col("column_name") == "processor_name").select(F.col("code").alias("processor_name_encoded"), "_new")
    pairs = done.stats.pairs.join(processors, "processor_name_encoded", "left")
    pairs = pairs.withColumn("processor_name_encoded", F.coalesce("_new", "processor_name_encoded")).select(*done.stats.pairs.columns)
    encoder = encoding.Encoder(materialize(lookup.unionByName(theirs.select(*lookup.columns)), "lookup"))
    return replace(done, encoder=encoder, stats=features.Stats(materialize(pairs, "stats")))


def retrain_and_publish(training: DataFrame, base: str, seed: DataFrame | None = None, attempts: int = 20, **options) -> Trained:
    """Retrain with the stored dictionary and publish the run.

    ``seed`` is the dictionary to start from when none is stored yet. If another
    run is published meanwhile, this one's new categories are coded again after
    the other's and it is published on top, without a second fit unless a code
    that the model uses has changed.
    """
    spark = training.sparkSession
    commit, current = writers.latest(spark, base)
    existing = _stored(spark, base, current, seed)
    done, model_run = retrain(training, existing, **options), None
    for _ in range(attempts):
        run_ts = writers.new_run_ts()
        done = replace(done, message=run_message(done.accuracy, _accuracy(current)))
        if model_run is None:
            writers.save_model(done.model, base, run_ts)
            model_run = run_ts
        dictionary_run = writers.save_dictionary(done.encoder.dictionary, base, run_ts, current.dictionary_run if current else None)
        writers.save_stats(done.stats, base, run_ts)
        months = current.months if current else {}
        try:
            writers.publish(spark, base, commit, writers.Run(run_ts, done.accuracy, done.message, dictionary_run, run_ts, model_run, months))
            return done
        except Conflict:
            commit, current = writers.latest(spark, base)
            existing = _stored(spark, base, current, seed)
            again = recoded(done, existing)
            if again is None:
                done, model_run = retrain(training, existing, **options), None
            else:
                done = again
    raise Conflict(f"{attempts} other runs were published in {base}")


def _stored(spark: SparkSession, base: str, run: writers.Run | None, seed: DataFrame | None) -> DataFrame:
    if run is None and seed is not None:
        return seed
    return writers.load_dictionary(spark, base, run.dictionary_run if run else None)


def _accuracy(run: writers.Run | None) -> float:
    return (run.accuracy or 0.0) if run else 0.0


def score_bins(
    bins: DataFrame,
    artifacts: writers.Artifacts,
    external: Sequence[str],
    is_3d: str = "t",
    top_n: int = SCORES_PER_BIN,
    threshold: float = 0.0,
) -> DataFrame:
    """Ranked processors for each BIN from a published model."""
    flag = encoding.code_of(artifacts.dictionary, "is_3d", is_3d)
    candidates = features.candidate_features(bins, artifacts.stats, flag)
    scored = learning.score(artifacts.model, candidates)
    named = encoding.decode(scored, artifacts.dictionary, "processor_name", "processor_name_encoded", "processor")
    return routing.top_processors(named, external, top_n, threshold)
