"""First moments of payments, kept in a folder and merged batch by batch.

A merge writes the state of its batch, by month, and one commit that names it;
its cost is that of the batch. A reader takes one commit and lays the parts of the
wanted months under each other. ``compact`` merges the parts of a month into one.
"""

from __future__ import annotations

import calendar
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binroute.operators import moments
from binroute.operators.filters import in_date_range
from binroute.sources.commits import CommitLog, Folder
from binroute.sources.writers import new_run_ts

_COLUMNS = moments.STATE.removeprefix("month string, ")


def _months(start: date, end: date) -> list[tuple[str, date, date]]:
    """Each month of a range, with its first and last day."""
    out, year, month = [], start.year, start.month
    while (year, month) <= (end.year, end.month):
        last = calendar.monthrange(year, month)[1]
        out.append((f"{year:04d}-{month:02d}", date(year, month, 1), date(year, month, last)))
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
    return out


class MomentStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _part(self, name: str) -> str:
        return f"{self.path}/parts/run_ts={name}"

    def _write(self, state: DataFrame, name: str) -> list[str]:
        state.repartition("month", F.pmod(F.xxhash64("txid"), F.lit(16))).write.partitionBy("month").parquet(self._part(name))
        return [m.removeprefix("month=") for m in Folder(self.spark, self._part(name)).names() if m.startswith("month=")]

    def merge(self, state: DataFrame, writer: str = "attempts", number: int | None = None) -> bool:
        """Add the state of a batch; False if the batch is in already.

        ``number`` counts the batches of a writer upwards, as a stream does: a batch
        whose number is not above the last one is a repeated try and adds nothing.
        Several writers may merge at once. A merge that breaks off adds nothing.
        """
        seen = self.log.latest()
        if number is not None and seen and seen.content["applied"].get(writer, -1) >= number:
            return False
        name = new_run_ts()
        months, added = self._write(state, name), []

        def change(now):
            content = now.content if now else {"parts": {}, "applied": {}}
            added[:] = [number is None or content["applied"].get(writer, -1) < number]
            if not added[0]:
                return None
            applied = content["applied"] | ({writer: number} if number is not None else {})
            return {"applied": applied, "parts": content["parts"] | {m: [*content["parts"].get(m, []), name] for m in months}}

        self.log.update(change)
        return added[0]

    def _state(self, parts: dict[str, list[str]]) -> DataFrame:
        """Parts of months side by side; the month is in the path."""
        paths = [f"{self._part(name)}/month={month}" for month, names in parts.items() for name in names]
        if not paths:
            return self.spark.createDataFrame([], moments.STATE)
        month = F.regexp_extract("_metadata.file_path", "month=([^/]*)/", 1)
        rows = self.spark.read.schema(_COLUMNS).parquet(*paths)
        return rows.select(month.alias("month"), *[c.split()[0] for c in _COLUMNS.split(", ")])

    def parts(self) -> dict[str, list[str]]:
        now = self.log.latest()
        return now.content["parts"] if now else {}

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The state of the months from ``first`` to ``last`` (``2026-01``); files of other months are not read."""
        return self._state({m: p for m, p in self.parts().items() if (first or m) <= m <= (last or m)})

    def between(self, start: date | str, end: date | str, flagged: DataFrame | None = None) -> DataFrame:
        """The state of the closed date range.

        Whole months come from the store. A month that the range cuts comes from
        ``flagged``, the attempts themselves, of which only those days are read.
        """
        start, end = date.fromisoformat(str(start)), date.fromisoformat(str(end))
        whole = [m for m, low, high in _months(start, end) if start <= low and high <= end]
        cut = [(max(start, low), min(end, high)) for m, low, high in _months(start, end) if m not in whole]
        state = self._state({m: p for m, p in self.parts().items() if m in set(whole)})
        if not cut:
            return state
        if flagged is None:
            raise ValueError(f"the range {start} to {end} cuts a month; its attempts are needed")
        for low, high in cut:
            state = state.unionByName(moments.first_moments(in_date_range(flagged, low, high)))
        return state

    def compact(self, least: int = 2) -> None:
        """Merge the parts of each month that has at least ``least`` of them, and keep the rest."""

        def change(now):
            many = {m: p for m, p in now.content["parts"].items() if len(p) >= least} if now else {}
            if not many:
                return None
            name = new_run_ts()
            self._write(moments.merged(self._state(many)), name)
            return now.content | {"parts": now.content["parts"] | {m: [name] for m in many}}

        self.log.update(change)

    def remove_unused(self, keep: int = 1, grace: timedelta = timedelta(days=1)) -> list[str]:
        """Delete parts that none of the last ``keep`` commits names and that were begun before ``grace``."""
        versions = self.log.versions()
        used = {name for v in versions[-keep:] for names in self.log.read(v).content["parts"].values() for name in names}
        self.log.forget(versions[:-keep])
        begun_before = (datetime.now(timezone.utc) - grace).strftime("%Y%m%d_%H%M%S_%f")
        folder = Folder(self.spark, f"{self.path}/parts")
        gone = [n for n in folder.names() if n.startswith("run_ts=") and n[7:] not in used and n[7:] < begun_before]
        for name in gone:
            folder.delete(name)
        return gone
