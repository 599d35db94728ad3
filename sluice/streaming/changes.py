"""Continuous runs: a snapshot at a pinned position, then the change log from there on.

The log is a folder that new files come to; Spark's checkpoint holds how far it was read, and moves on only after the
sink has loaded a batch. The sink knows loads by batch, so a batch that runs again after a crash changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..plans.state import Store
from ..sinks.base import LoadId, Sink
from ..sources.changes import from_envelopes, meta, snapshot
from ..sources.cursor import snapshot_chunk
from ..sources.positions import lsn_number
from ..sources.slots import Slot

#: Lag in bytes and hours beyond which a slot is at notice, warning and critical.
LAG_TIERS = ((50 << 30, 24, "critical"), (10 << 30, 6, "warning"), (1 << 30, 1, "notice"))


def lag_tier(size: int, hours: float = 0.0) -> str:
    return next((name for b, h, name in LAG_TIERS if size >= b or hours >= h), "ok")


def lag_tiers(size: Column, hours: Column) -> Column:
    """The tier of each row's lag. A null counts as no lag."""
    out = F.lit("ok")
    for b, h, name in reversed(LAG_TIERS):
        out = F.when((F.coalesce(size, F.lit(0)) >= b) | (F.coalesce(hours, F.lit(0)) >= h), name).otherwise(out)
    return out


@dataclass
class ChangeRun:
    """``slot``: confirms a batch's last position, that of heartbeats too, after the sink has loaded the batch."""

    spark: SparkSession
    store: Store
    sink: Sink
    tenant: str
    pipeline: str
    stream: str
    key: str
    slot: Slot | None = None

    def _id(self, phase: str, batch: int) -> LoadId:
        return LoadId(self.tenant, self.pipeline, phase, batch, self.stream)

    def snapshot(self, table: DataFrame, pin: str, rows: int = 1_000_000) -> int:
        """Loads the table in key order, chunk by chunk. A run that takes up again keeps the first run's pin and goes
        on after its last whole chunk."""
        place = f"snapshots/{self.pipeline}/{self.stream}"
        held = self.store.get(place) or {"pin": pin, "last": None, "chunk": 0, "done": False}
        while not held["done"]:
            chunk = snapshot_chunk(table, self.key, held["last"], rows).persist()
            try:
                facts = chunk.agg(F.count(F.lit(1)).alias("n"), F.max(self.key).alias("last")).first()
                if facts["n"]:
                    self.sink.load(self._id("snapshot", held["chunk"]), snapshot(chunk, held["pin"], self.key))
                held |= {"last": facts["last"] if facts["n"] else held["last"], "chunk": held["chunk"] + 1, "done": facts["n"] < rows}
            finally:
                chunk.unpersist()
            self.store.put(place, held)
        return held["chunk"]

    def follow(self, log: str, schema: T.StructType, checkpoint: str, files: int = 1, trigger: dict | None = None, after: Callable[[DataFrame, int], None] | None = None):
        """Follows a folder of JSON envelopes. ``files``: how many a batch takes, which bounds it."""
        lines = self.spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(log)
        rows = from_envelopes(lines, schema)

        def load(batch: DataFrame, number: int) -> None:
            self.sink.load(self._id("stream", number), batch)
            if self.slot:
                last = batch.agg(F.max_by(meta("lsn"), lsn_number(meta("lsn")))).first()[0]
                if last:
                    self.slot.advance(last)
            if after:
                after(batch, number)

        query = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        return query.trigger(**(trigger or {"availableNow": True})).start()


class Progress(StreamingQueryListener):
    """What each batch read, and an end after so many batches."""

    def __init__(self, most: int | None = None):
        self.rows: list[int] = []
        self.most = most

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.rows.append(event.progress.numInputRows)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def reached(self) -> bool:
        return self.most is not None and len(self.rows) >= self.most
