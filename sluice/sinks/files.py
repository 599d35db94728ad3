"""Parquet folders by batch: plain batches, append-only event logs, dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Loaded, LoadId, Sink, safe


def _write(batch: DataFrame, path: str, files: int | None) -> Loaded:
    from pyspark.sql import Observation

    seen = Observation()
    watched = batch.observe(seen, F.count(F.lit(1)).alias("rows"))
    (watched.coalesce(files) if files else watched).write.mode("overwrite").parquet(path)
    return Loaded(seen.get["rows"], path)


@dataclass(frozen=True)
class BatchFolders(Sink):
    """``base/tenant/pipeline/[stream/]run/batch=00000``: a folder for each batch, an empty one too; a batch that comes
    again replaces its folder."""

    base: str
    files: int | None = None
    middle: str = ""

    def path(self, load: LoadId) -> str:
        parts = [self.base.rstrip("/"), safe(load.tenant), safe(load.pipeline)]
        parts += [safe(load.stream)] if load.stream else []
        parts += [self.middle] if self.middle else []
        return "/".join([*parts, safe(load.run), f"batch={load.batch:05d}"])

    def load(self, load: LoadId, batch: DataFrame) -> Loaded:
        return _write(batch, self.path(load), self.files)


def event_log(base: str) -> BatchFolders:
    """All change rows with their metadata, under ``cdc/``."""
    return BatchFolders(base, middle="cdc")


def dead_letters(base: str) -> BatchFolders:
    """Rejected rows, under ``dead-letter/``, whatever the sink of the kept ones."""
    return BatchFolders(base, middle="dead-letter")
