"""Runs that reach a keyed table at once: batches wait beside it, one merge at the run's end rewrites its buckets once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import Files
from .base import Loaded, LoadId, Sink, SinkError, safe
from .files import _write
from .keyed import KeyedTable

#: The batch that brought a staged row; of rows with one key and one cursor value the one emitted last counts.
EMITTED = "_sluice_emitted"


class Staged(Sink):
    """Stages batches under ``base`` in a folder for each run; ``commit`` merges them into ``table`` and removes them.
    A batch that comes again replaces its folder, a commit that comes again changes nothing."""

    fence = "run"

    def __init__(self, table: KeyedTable, base: str):
        self.table, self.files = table, Files(table.spark, base)

    @property
    def order(self) -> tuple[str, ...]:
        return self.table.order

    @order.setter
    def order(self, columns: tuple[str, ...]) -> None:
        self.table.order = columns

    def _at(self, load: LoadId, run: str) -> str:
        return "/".join([safe(load.tenant), safe(load.pipeline), *([safe(load.stream)] if load.stream else []), safe(run)])

    def _folders(self, load: LoadId) -> list[str]:
        return [at for at in (self._at(load, load.run), self._at(load, f"{load.run}.without")) if self.files.exists(at)]

    def load(self, load: LoadId, batch: DataFrame) -> Loaded:
        if EMITTED in batch.columns:
            raise SinkError(f"a batch can't have a column {EMITTED}")
        emitted = -1 if load.run.endswith(".without") else load.batch
        path = self.files.at(f"{self._at(load, load.run)}/batch={load.batch:05d}")
        return _write(batch.withColumn(EMITTED, F.lit(emitted).cast("long")), path, None)

    def commit(self, load: LoadId) -> Loaded:
        held = self._folders(load)
        done = Loaded(0, self.table.path)
        if held:
            reader = self.table.spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true")
            rows = reader.parquet(*[self.files.at(at) for at in held])
            if self.table.keys and "_cdc.op" not in rows.columns:
                rows = self.table._last(rows, (EMITTED,))
            done = self.table.load(load, rows.drop(EMITTED))
            self.abort(load)
        return done

    def abort(self, load: LoadId) -> None:
        for at in self._folders(load):
            self.files.remove(at)
