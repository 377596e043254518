"""Report sink and versioned storage of dictionaries, statistics and models.

Every run writes below its own ``run_ts``; nothing is overwritten, so older
runs are the backups. A run becomes visible by its commit, which happens last
and names every folder that belongs to the run (``binroute.sources.commits``):
two runs that start from one dictionary cannot both follow it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binroute.operators.features import Stats
from binroute.sources import schemas
from binroute.sources.commits import Commit, CommitLog, Folder
from binroute.sources.readers import path_exists

RUNS = "run_ts string, accuracy double, message string, dictionary_run string, stats_run string, model_run string, months map<string,array<string>>"
_TS = "%Y%m%d_%H%M%S_%f"


def write_report_csv(report: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, blanks around values are kept."""
    report.write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_dictionary_json(dictionary: DataFrame, path: str, column_name: str) -> None:
    """The categories of one column as one JSON object, which is the file's format."""
    codes = dictionary.where(F.col("column_name") == column_name).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "code")))).alias("codes")
    )
    codes.select(F.to_json("codes")).coalesce(1).write.text(path)


def new_run_ts() -> str:
    return datetime.now(timezone.utc).strftime(_TS)


def _at(base: str, kind: str, run_ts: str) -> str:
    return f"{base.rstrip('/')}/{kind}/run_ts={run_ts}"


@dataclass(frozen=True)
class Run:
    """What a commit names: the runs that wrote its dictionary, statistics, model and monthly counts."""

    run_ts: str
    accuracy: float | None
    message: str
    dictionary_run: str
    stats_run: str
    model_run: str | None
    months: dict[str, list[str]] = field(default_factory=dict)

    @property
    def folders(self) -> set[tuple[str, str]]:
        named = {("dictionary", self.dictionary_run), ("stats", self.stats_run), *(("months", run) for parts in self.months.values() for run in parts)}
        return named | ({("model", self.model_run)} if self.model_run else set())


def save_dictionary(dictionary: DataFrame, base: str, run_ts: str, previous: str | None) -> str:
    """Write a grown dictionary and return the run that holds it.

    Without new keys nothing is written and the previous run stays current.
    """
    if previous is not None:
        before = load_dictionary(dictionary.sparkSession, base, previous)
        if dictionary.join(before, ["column_name", "category"], "left_anti").isEmpty():
            return previous
    dictionary.write.parquet(_at(base, "dictionary", run_ts))
    return run_ts


def load_dictionary(spark: SparkSession, base: str, run_ts: str | None) -> DataFrame:
    if run_ts is None:
        return spark.createDataFrame([], schemas.DICTIONARY)
    return spark.read.schema(schemas.DICTIONARY).parquet(_at(base, "dictionary", run_ts))


def save_stats(stats: Stats, base: str, run_ts: str) -> None:
    stats.pairs.write.parquet(_at(base, "stats", run_ts))


def load_stats(spark: SparkSession, base: str, run_ts: str) -> Stats:
    return Stats(spark.read.parquet(_at(base, "stats", run_ts)))


def save_model(model: PipelineModel, base: str, run_ts: str) -> None:
    model.write().save(_at(base, "model", run_ts))


def load_model(base: str, run_ts: str) -> PipelineModel:
    return PipelineModel.load(_at(base, "model", run_ts))


def save_months(counts: DataFrame, values: DataFrame, base: str, run_ts: str) -> list[str]:
    """Write counts by ``month`` and return the months."""
    folder = _at(base, "months", run_ts)
    for name, rows in (("counts", counts), ("values", values)):
        rows.repartition("month").write.partitionBy("month").parquet(f"{folder}/{name}")
    return [r["month"] for r in counts.select("month").distinct().orderBy("month").collect()]  # few: one a period


def load_months(spark: SparkSession, base: str, months: dict[str, list[str]], name: str, schema: str) -> DataFrame:
    """The stored counts of all months, with parts of the same month side by side."""
    paths = [f"{_at(base, 'months', run)}/{name}/month={month}" for month, parts in months.items() for run in parts]
    paths = [p for p in paths if name == "counts" or path_exists(spark, p)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def log(spark: SparkSession, base: str) -> CommitLog:
    return CommitLog(spark, f"{base.rstrip('/')}/commits")


def publish(spark: SparkSession, base: str, after: Commit | None, run: Run) -> Commit:
    """Make a run the current one, or raise ``Conflict`` if ``after`` is no longer the latest."""
    return log(spark, base).append(after, vars(run))


def latest(spark: SparkSession, base: str) -> tuple[Commit | None, Run | None]:
    """The last commit and its run, from one read."""
    commit = log(spark, base).latest()
    return commit, Run(**commit.content) if commit else None


def runs(spark: SparkSession, base: str) -> DataFrame:
    """All runs that are not removed."""
    if not log(spark, base).versions():
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).json(f"{base.rstrip('/')}/commits/*.json")


def latest_run(spark: SparkSession, base: str) -> str | None:
    run = latest(spark, base)[1]
    return run.run_ts if run else None


@dataclass(frozen=True)
class Artifacts:
    model: PipelineModel
    stats: Stats
    dictionary: DataFrame


def load_latest(spark: SparkSession, base: str) -> Artifacts:
    """Model, statistics and dictionary of the last published run, all named by one commit."""
    run = latest(spark, base)[1]
    if run is None:
        raise FileNotFoundError(f"no published run in {base}")
    if run.model_run is None:
        raise FileNotFoundError(f"no model is published in {base}")
    return Artifacts(load_model(base, run.model_run), load_stats(spark, base, run.stats_run), load_dictionary(spark, base, run.dictionary_run))


def remove_old_runs(spark: SparkSession, base: str, keep: int, grace: timedelta = timedelta(days=1)) -> list[str]:
    """Keep the last ``keep`` runs and delete what none of them reaches; returns the deleted folders.

    A kept run may name the dictionary, model or counts of an older one, which then stay.
    Folders of runs that no commit names (failed ones) go too. Nothing that was
    begun within ``grace`` goes, as its run may not have committed yet. Commits
    go first: a removal that breaks off leaves folders that the next one deletes.
    """
    if keep < 1:
        raise ValueError("the current run cannot be removed")
    commits = log(spark, base)
    versions = commits.versions()
    reached = {path for v in versions[-keep:] for path in Run(**commits.read(v).content).folders}
    commits.forget(versions[:-keep])
    begun_before = (datetime.now(timezone.utc) - grace).strftime(_TS)
    store, gone = Folder(spark, base), []
    for kind in ("dictionary", "stats", "model", "months"):
        for name in store.names(kind):
            run_ts = name.removeprefix("run_ts=")
            if (kind, run_ts) not in reached and run_ts < begun_before and name != run_ts:
                store.delete(f"{kind}/{name}")
                gone.append(f"{kind}/{name}")
    return gone
