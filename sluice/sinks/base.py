"""Load identities, results, and checked paths."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame


class SinkError(ValueError):
    pass


@dataclass(frozen=True)
class LoadId:
    """What makes a batch the same batch."""

    tenant: str
    pipeline: str
    run: str
    batch: int
    stream: str = ""

    def text(self) -> str:
        return "\x1f".join((self.tenant, self.pipeline, self.run, f"{self.batch:05d}", self.stream))


@dataclass(frozen=True)
class Loaded:
    rows: int
    path: str


class Sink(ABC):
    """``fence``: when a run's position may be used, after each ``batch`` or only after the whole ``run``."""

    fence = "batch"

    def validate(self) -> None:
        """Raises if the destination can't take rows."""

    def prepare(self, load: LoadId) -> None:
        """Before a run's first batch."""
        self.validate()

    def commit(self, load: LoadId) -> None:
        """After a run's last batch. It may come again."""

    def abort(self, load: LoadId) -> None:
        """Forgets what a run has brought that isn't committed."""

    @abstractmethod
    def load(self, load: LoadId, batch: DataFrame) -> Loaded: ...


def safe(name: str) -> str:
    """A name that is one folder of a path."""
    if not name or name in (".", "..") or re.search(r"[/\\\x00]|\.\.", name):
        raise SinkError(f"unsafe name {name!r}")
    return name


def table_name(stream: str, table: str | None) -> str:
    """The table of a stream: the stream's own name, else the spec's."""
    name = stream or table or ""
    if not name:
        raise SinkError("neither stream nor table")
    if any(c == '"' or ord(c) < 32 or ord(c) == 127 for c in name):
        raise SinkError(f"unsafe table name {name!r}")
    return name
