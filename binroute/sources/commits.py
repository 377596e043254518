"""An optimistic commit log: one numbered JSON file per version, created only if absent.

A writer reads the latest version, writes its files under names of its own, and
then claims the next number. If another writer has claimed it, nothing of the
loser becomes visible: it looks at the winner's commit, adapts and tries again.
A reader takes one commit and finds in it all that belongs together.

Claiming is a hard link on a local or mounted file system and a rename that does
not overwrite elsewhere (atomic on HDFS). A store whose rename overwrites or
copies needs a single writer.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

_NAME = re.compile(r"(\d{20})\.json")


class Conflict(Exception):
    """Another writer has claimed the version."""


@dataclass(frozen=True)
class Commit:
    version: int
    content: dict[str, Any]


class Folder:
    """A folder of any Hadoop file system, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        self._fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._at(name)))

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Write a file that is not there yet, whole or not at all; False if it is there."""
        self._fs.mkdirs(self._at())
        folder = self._fs.resolvePath(self._at())
        draft = f".{uuid.uuid4().hex}.draft"
        if folder.toUri().getScheme() == "file":
            here = folder.toUri().getPath()
            with open(f"{here}/{draft}", "x", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(f"{here}/{draft}", f"{here}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{here}/{draft}")
            return True
        if self.exists(name):
            return False
        stream = self._fs.create(self._at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.rename(self._at(draft), self._at(name)):
            return True
        self.delete(draft)
        return False


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return [int(m[1]) for m in map(_NAME.fullmatch, self.folder.names()) if m]

    def read(self, version: int) -> Commit:
        return Commit(version, json.loads(self.folder.text(f"{version:020d}.json")))

    def latest(self) -> Commit | None:
        versions = self.versions()
        return self.read(versions[-1]) if versions else None

    def append(self, after: Commit | None, content: dict[str, Any]) -> Commit:
        """Claim the version after the given one, or raise ``Conflict``."""
        version = after.version + 1 if after else 1
        if not self.folder.create(f"{version:020d}.json", json.dumps(content, sort_keys=True)):
            raise Conflict(f"version {version} of {self.folder.path} exists")
        return Commit(version, content)

    def update(self, change: Callable[[Commit | None], dict[str, Any] | None], attempts: int = 100) -> Commit | None:
        """Append what ``change`` makes of the latest commit, again on each conflict; None makes no version."""
        for _ in range(attempts):
            now = self.latest()
            content = change(now)
            if content is None:
                return now
            try:
                return self.append(now, content)
            except Conflict:
                continue
        raise Conflict(f"{attempts} others were faster in {self.folder.path}")

    def forget(self, versions: list[int]) -> None:
        """Delete versions other than the latest, oldest first."""
        last = self.versions()[-1:]
        for version in sorted(set(versions) - set(last)):
            self.folder.delete(f"{version:020d}.json")
