"""Bounded runs: read from the position, transform, load kept and rejected rows, commit the position last."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain
from ..operators.transforms import Operator
from ..sinks.base import LoadId, Sink
from ..sources.cursor import CursorScan
from ..sources.readers import Limits
from .evolution import Recorder, conform
from .state import Cursor, Positions, Store

STATES = ("queued", "running", "completed", "failed", "cancelled")


class RunFailed(RuntimeError):
    pass


@dataclass
class Summary:
    run: str
    state: str = "queued"
    batches: int = 0
    read: int = 0
    loaded: int = 0
    rejected: int = 0
    overlap: int = 0
    cursor: str | None = None
    schema_version: int | None = None
    more: bool = False
    seconds: float = 0.0
    counters: list[dict[str, int]] = field(default_factory=list)


@dataclass
class Pipeline:
    """A pipeline over one stream. The position and the end of the run follow the rows read, not the rows kept, so a
    batch whose rows are all filtered out is passed like any other.

    ``limits`` end a run between batches, as soon as one is reached; ``more`` in the summary says that rows may be left.
    With a sink whose fence is the run, the position that other runs see moves after the sink's commit. The commit is
    decided on first, in one document, so after a crash the next run finishes it before all else; batches of a run that
    failed wait for it to come again, and are dropped when another run begins."""

    spark: SparkSession
    store: Store
    tenant: str
    name: str
    stream: str
    scan: CursorScan
    sink: Sink
    dead_letter: Sink | None = None
    operators: list[Operator] = field(default_factory=list)
    batch_size: int = 100_000
    policy: str = "propagate_additive"
    threshold: float | None = 0.01
    fail_on_any: bool = False
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self):
        if getattr(self.sink, "order", None) == ():  # of rows with one key in a batch the last one counts
            self.sink.order = (self.scan.cursor,)

    def run(self, table: DataFrame, run_id: str, attempts: int = 5, wait: float = 1.0) -> Summary:
        """Runs until the source has no more rows. Loads are known by run and batch. A run that failed and comes again
        under its id goes on after the batches behind its position, and reads the batch that it was at up to the same
        bound, so nothing is loaded twice and nothing is passed over."""
        if self.store.get(f"tenants/{self.tenant}", {}).get("status") == "suspended":
            raise RunFailed(f"tenant {self.tenant} is suspended")
        out = Summary(run_id, "running")
        self._record(out)
        began = time.monotonic()
        try:
            if self._settled() != run_id:
                self.sink.prepare(self._id(run_id))
                self._loop(table, out, attempts, wait)
            out.state = "completed"
        except BaseException:
            out.state = "failed"
            raise
        finally:
            out.seconds = time.monotonic() - began
            self._record(out)
        return out

    def abort(self) -> None:
        """Drops what a failed run has staged."""
        positions = Positions(self.store)
        held = positions.run(self.name, self._staged)
        if held and self.sink.fence == "run":
            self.sink.abort(self._id(held))
            positions.begin(self.name, self._staged, None, None)

    def _id(self, run: str, batch: int = 0) -> LoadId:
        return LoadId(self.tenant, self.name, run, batch, self.stream)

    @property
    def _staged(self) -> str:
        return f"{self.stream}.staged"

    def _place(self, run: str, positions: Positions) -> str:
        """The stream under whose name the run's own position is held."""
        if self.sink.fence == "batch":
            return self.stream
        if positions.run(self.name, self._staged) != run:
            self.abort()
            positions.begin(self.name, self._staged, positions.get(self.name, self.stream), run)
        return self._staged

    def _settled(self) -> str | None:
        """Finishes a commit that was decided on, and says whose it was."""
        place, positions = f"committing/{self.name}/{self.stream}", Positions(self.store)
        decided = self.store.get(place)
        if not decided:
            return None
        self.sink.commit(self._id(decided["run"], decided["batches"]))
        if decided["at"]:
            positions.commit(self.name, self.stream, Cursor(*decided["at"]), run=decided["run"], batches=decided["batches"])
        if decided["without"]:
            self.store.put(f"without/{self.name}/{self.stream}", {"run": decided["run"]})
        positions.begin(self.name, self._staged, None, None)
        self.store.put(place, None)
        return decided["run"]

    def _enough(self, out: Summary, first: int, size: int, began: float) -> bool:
        most = self.limits
        pairs = ((most.rows, out.read), (most.batches, out.batches - first), (most.bytes, size), (most.seconds, time.monotonic() - began))
        return any(bound is not None and had >= bound for bound, had in pairs)

    def _record(self, out: Summary) -> None:
        self.store.put(f"runs/{self.name}/{out.run}", {k: v for k, v in out.__dict__.items()})

    def _loop(self, table: DataFrame, out: Summary, attempts: int, wait: float) -> None:
        self.scan.check(table.schema)
        derived = chain.derive_schema(self.operators, self.scan.after(table, None).schema)
        version = Recorder(self.store, f"{self.name}/{self.stream}").resolve(derived, self.policy)
        out.schema_version = version.version
        positions = Positions(self.store)
        place = self._place(out.run, positions)
        out.batches = positions.batches(self.name, place, out.run)
        self._without(table, out, version.struct(), attempts, wait)
        self._pages(table, out, version, positions, place, attempts, wait)
        if place != self.stream:
            at = positions.get(self.name, place)
            self.store.put(f"committing/{self.name}/{self.stream}", {"run": out.run, "batches": out.batches, "at": [at.kind, at.value] if at else None, "without": table.schema[self.scan.cursor].nullable})
            self._settled()

    def _pages(self, table: DataFrame, out: Summary, version, positions: Positions, place: str, attempts: int, wait: float) -> None:
        first, size, began = out.batches, 0, time.monotonic()
        while True:
            if self._enough(out, first, size, began):
                out.more = True
                return
            position = positions.get(self.name, place)
            begun = self.store.get(f"pending/{self.name}/{self.stream}")
            upto = Cursor(*begun["upto"]) if begun and (begun["run"], begun["batch"]) == (out.run, out.batches) else None
            page = self.scan.page(table, position, self.batch_size, upto).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                n = page.count()
                at = self.scan.position(page) if n else None
                stale = 0
                if position and n and self.scan.resume == "inclusive":
                    from ..sources.cursor import literal

                    stale = page.where(F.col(f"`{self.scan.cursor}`") == literal(position, table.schema[self.scan.cursor])).count()
                if n == stale and position and upto is None:  # nothing but the boundary, which was loaded before
                    return
                if at or upto:
                    at = upto or at
                    self.store.put(f"pending/{self.name}/{self.stream}", {"run": out.run, "batch": out.batches, "upto": [at.kind, at.value]})
                    if n:
                        self._load(page, out, version.struct(), n, attempts, wait)
                    out.read, out.overlap, out.batches = out.read + n, out.overlap + stale, out.batches + 1
                    positions.commit(self.name, place, at, run=out.run, batches=out.batches)
                    if self.limits.bytes is not None:
                        size += page.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
                    out.cursor = at.value
                if n < self.batch_size and upto is None:
                    return
            finally:
                page.unpersist()

    def _without(self, table: DataFrame, out: Summary, schema, attempts: int, wait: float) -> None:
        """The rows without a cursor value, a batch of their own, once for each stream."""
        place = f"without/{self.name}/{self.stream}"
        if not table.schema[self.scan.cursor].nullable or self.store.get(place):
            return
        rows = self.scan.without(table).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = rows.count()
            if n:
                self._load(rows, out, schema, n, attempts, wait, LoadId(self.tenant, self.name, f"{out.run}.without", 0, self.stream))
                out.read += n
            if self.sink.fence == "batch":
                self.store.put(place, {"run": out.run, "rows": n})
        finally:
            rows.unpersist()

    def _load(self, page: DataFrame, out: Summary, schema, n: int, attempts: int, wait: float, load: LoadId | None = None) -> None:
        applied = chain.apply(self.operators, page)
        load = load or LoadId(self.tenant, self.name, out.run, out.batches, self.stream)
        for attempt in range(attempts):
            try:
                rejected = 0
                if applied.rejected is not None:
                    rejected = applied.rejected.count()
                    if self.dead_letter and rejected:
                        self.dead_letter.load(load, applied.rejected)
                out.loaded += self.sink.load(load, conform(applied.kept, schema)).rows
                out.rejected += rejected
                break
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(min(30.0, wait * 2**attempt))
        if chain.over_threshold(out.rejected, out.read + n, self.threshold, self.fail_on_any):
            raise RunFailed(f"{out.rejected} of {out.read + n} rows were rejected")


def preview(table: DataFrame, operators: list[Operator], rows: int = 1000) -> DataFrame:
    """What the operators make of the first rows; nothing is loaded."""
    return chain.apply(operators, table.limit(rows)).kept


def full_refresh(table: DataFrame, operators: list[Operator], sink, load: LoadId):
    """Replaces a keyed table by the whole source at once."""
    return sink.replace(load, chain.apply(operators, table).kept)


__all__ = ["STATES", "Cursor", "Pipeline", "RunFailed", "Summary", "full_refresh", "preview"]
