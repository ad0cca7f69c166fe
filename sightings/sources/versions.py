"""A log of versions beside stored tables: a version exists when its entry does, and an entry is made in one step.

An entry is a small JSON file whose name is its number.  It is created under the condition that no file of that
name is there, so of two writers who saw the same last version one fails.  Data are written to folders of their own
before the entry that names them; a failure in between leaves the former version as it was.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Version:
    number: int
    entry: dict


class VersionLog:
    """The versions of one table; ``folder`` is reached by the driver alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, number: int):
        return self._path(f"{self.folder}/{number:012d}.json")

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> Version:
        stream = self._fs.open(self._file(number))
        try:
            return Version(number, json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def current(self) -> Version | None:
        """The last version; an entry that was cut short while it was written counts as not made."""
        for number in reversed(self.numbers()):
            try:
                return self.read(number)
            except json.JSONDecodeError:
                continue
        return None

    def commit(self, entry: dict, expected: int | None) -> Version:
        """Makes the version after ``expected`` (None: the first one); fails if that is not the last any more."""
        current = self.current()
        if (current.number if current else None) != expected:
            raise VersionConflict(f"expected version {expected}, found {current.number if current else None}")
        number = max([expected if expected is not None else -1, *self.numbers()]) + 1
        try:
            stream = self._fs.create(self._file(number), False)
        except Py4JJavaError as error:
            raise VersionConflict(f"version {number} is there already") from error
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        return Version(number, entry)
