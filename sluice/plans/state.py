"""Small state, as JSON documents in a folder that the cluster shares; each write is one rename."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._jvm = jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.at(name)))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = True) -> bool:
        """Writes beside the place and renames; without ``replace`` an existing file stays and False comes back."""
        target = self._path(self.at(name))
        if not replace and self.fs.exists(target):
            return False
        beside = self._path(self.at(f"{name}.{uuid.uuid4().hex}.tmp"))
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        if replace and self.fs.exists(target):
            self.fs.delete(target, False)
        done = self.fs.rename(beside, target)
        if not done:
            self.fs.delete(beside, False)
        return done

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)


class Store:
    """Documents by key. Each write is a new numbered file, made by one rename; the last one counts, so a crash at any
    point leaves the old or the new document. Of earlier ones the last is kept."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, f"{root.rstrip('/')}/_state")

    def _held(self, key: str) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{key}.doc") if n.endswith(".json")]

    def get(self, key: str, default: Any = None) -> Any:
        held = self._held(key)
        return json.loads(self.files.read(f"{key}.doc/{held[-1]:012d}.json")) if held else default

    def put(self, key: str, value: Any) -> None:
        while True:
            held = self._held(key)
            if self.files.write(f"{key}.doc/{held[-1] + 1 if held else 1:012d}.json", json.dumps(value, sort_keys=True), replace=False):
                break
        for old in held[:-1]:
            self.files.remove(f"{key}.doc/{old:012d}.json")


CURSOR_KINDS = ("int64", "timestamp_tz", "lsn", "gtid", "snapshot_pk")


class BackwardsCursor(ValueError):
    pass


@dataclass(frozen=True)
class Cursor:
    """A position: a kind and its text."""

    kind: str
    value: str

    def __post_init__(self):
        if self.kind not in CURSOR_KINDS:
            raise ValueError(f"unknown cursor kind {self.kind!r}")


class Positions:
    """The position of each (pipeline, stream). It never goes back unless told to."""

    def __init__(self, store: Store):
        self.store = store

    def get(self, pipeline: str, stream: str) -> Cursor | None:
        held = self.store.get(f"positions/{pipeline}/{stream}")
        return Cursor(held["kind"], held["value"]) if held and held["kind"] else None

    def run(self, pipeline: str, stream: str) -> str | None:
        """The run that the position comes from."""
        return (self.store.get(f"positions/{pipeline}/{stream}") or {}).get("run")

    def begin(self, pipeline: str, stream: str, cursor: Cursor | None, run: str | None) -> None:
        """Sets a position, or none, whatever was held."""
        self.store.put(f"positions/{pipeline}/{stream}", {"kind": cursor.kind if cursor else None, "value": cursor.value if cursor else None, "run": run, "batches": 0})

    def batches(self, pipeline: str, stream: str, run: str) -> int:
        """How many batches of a run are behind the position."""
        held = self.store.get(f"positions/{pipeline}/{stream}")
        return held["batches"] if held and held.get("run") == run else 0

    def commit(self, pipeline: str, stream: str, cursor: Cursor, backwards: bool = False, run: str | None = None, batches: int = 0) -> None:
        """``run``, ``batches``: what a run has loaded up to here, kept in the same document."""
        held = self.get(pipeline, stream)
        if held and held.kind == cursor.kind and not backwards and _rank(cursor) < _rank(held):
            raise BackwardsCursor(f"{cursor.value} is before {held.value}")
        self.store.put(f"positions/{pipeline}/{stream}", {"kind": cursor.kind, "value": cursor.value, "run": run, "batches": batches})


def _rank(cursor: Cursor) -> Any:
    if cursor.kind in ("int64", "snapshot_pk"):
        return int(cursor.value)
    if cursor.kind == "lsn":
        from ..sources.positions import lsn

        return lsn(cursor.value)
    if cursor.kind == "gtid":
        from ..sources.positions import GtidSet

        return GtidSet.parse(cursor.value).count()
    return cursor.value
