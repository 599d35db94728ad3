"""Keyed tables on plain Parquet: versions, upserts, change application and evolution without a lakehouse format.

A table is a folder with ``_manifests/NNNNNNNNNN.json``; the last one says which folders hold the rows. With keys, rows
live in buckets by key hash, and a load rewrites only the buckets it touches, in a new folder; it becomes visible, with
the load's identity, by one rename of the manifest that must not exist yet. A load that comes again finds its identity
and does nothing. Old folders stay until ``expire`` removes them, so earlier versions can be read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import widens
from ..plans.evolution import diff
from ..plans.state import Files
from ..sources.changes import check_ops, data_columns, meta, strip
from .base import Loaded, LoadId, Sink, SinkError, safe, table_name

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another load made this version first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int
    folders: dict[str, list[str]]  # bucket -> folders
    loads: dict[str, int]


class KeyedTable(Sink):
    """``buckets`` should grow with the table (about 256 MB each); ``rebucket`` changes it. ``order``: columns by which
    the last of a batch's rows with one key is told, where the batch has them; of equal ones the largest row counts."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = (), buckets: int = 16, deletes: str = "hard", apply_truncate: bool = False, order: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), tuple(keys), buckets if keys else 1
        if deletes not in ("hard", "column", "side_table"):
            raise SinkError(f"unknown way to delete {deletes!r}")
        self.deletes, self.apply_truncate, self.order = deletes, apply_truncate, tuple(order)
        self.files = Files(spark, self.path)

    # ---- reading ----

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names("_manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest | None:
        held = self.versions()
        if not held:
            return None
        version = held[-1] if version is None else version
        if version not in held:
            raise SinkError(f"no version {version}")
        m = json.loads(self.files.read(f"_manifests/{version:010d}.json"))
        return Manifest(m["version"], T.StructType.fromJson(m["schema"]), tuple(m["keys"]), m["buckets"], m["folders"], m["loads"])

    def _rows(self, m: Manifest, buckets: list[str] | None = None) -> DataFrame:
        folders = sorted({f for b, fs in m.folders.items() if buckets is None or b in buckets for f in fs})
        if not folders:
            return self.spark.createDataFrame([], m.schema)
        return self.spark.read.schema(m.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m is None:
            raise SinkError("the table has no version yet")
        return self._rows(m)

    # ---- writing ----

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _commit(self, m: Manifest | None, schema: T.StructType, folders: dict[str, list[str]], load: LoadId | None, rows: int, drop_loads: bool = False) -> None:
        version = (m.version if m else 0) + 1
        loads = {} if m is None or drop_loads else dict(m.loads)
        if load:
            loads[load.text()] = rows
        body = {"version": version, "schema": schema.jsonValue(), "keys": list(self.keys), "buckets": self.buckets, "folders": folders, "loads": loads}
        if not self.files.write(f"_manifests/{version:010d}.json", json.dumps(body, sort_keys=True), replace=False):
            raise Conflict(f"version {version} exists")

    def _put(self, frame: DataFrame, touched: list[str] | None) -> dict[str, list[str]]:
        """Writes rows in a new folder by bucket; which folders now hold each touched bucket. A task sorts what it writes
        by bucket, so buckets beyond the size that adaptive execution gives a task are dealt to several tasks."""
        at = f"data/{uuid.uuid4().hex}"
        if not self.keys:
            frame.write.parquet(f"{self.path}/{at}/{BUCKET}=0")
            return {"0": [f"{at}/{BUCKET}=0"]}
        tagged = frame.withColumn(BUCKET, self._bucket())
        tagged.hint("rebalance", len(touched) if touched else self.buckets, F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{at}")
        made = {n.split("=")[1] for n in self.files.names(at) if n.startswith(f"{BUCKET}=")}
        return {b: [f"{at}/{BUCKET}={b}"] if b in made else [] for b in (touched or [str(i) for i in range(self.buckets)])}

    def _schema(self, m: Manifest | None, batch: DataFrame, evolve: bool) -> T.StructType:
        new = strip(batch).schema
        for k in self.keys:
            if k not in new.fieldNames():
                raise SinkError(f"key {k!r} isn't in the batch")
        if m is None:
            return new
        return evolved(m.schema, new) if evolve else m.schema

    def load(self, load: LoadId, batch: DataFrame) -> Loaded:
        m = self.manifest()
        if m and load.text() in m.loads:
            return Loaded(0, self.path)
        if "_cdc.op" in batch.columns:
            return self._changes(m, load, batch)
        schema = self._schema(m, batch, evolve=True)
        rows = _shaped(batch, schema)
        if not self.keys:
            n = rows.count()
            made = self._put(rows, None)
            folders = {"0": [*(m.folders.get("0", []) if m else []), *made["0"]]}
            self._commit(m, schema, folders, load, n)
            return Loaded(n, self.path)
        rows = self._last(rows).persist()
        try:
            return self._merge(m, schema, rows, None, load, rows.count())
        finally:
            rows.unpersist()

    def _last(self, rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
        """One row for each key: the last by ``order``, then by ``more``. Partial maxima are taken before the shuffle."""
        order = [c for c in (*self.order, *more) if c in rows.columns]
        keys = [F.col(f"`{k}`") for k in self.keys]
        rest = [F.col(f"`{f.name}`") for f in rows.schema if f.name not in self.keys]
        if not rest:
            return rows.distinct()
        plain = [F.col(f"`{f.name}`") for f in rows.schema if f.name not in self.keys and not isinstance(f.dataType, (T.MapType, T.VariantType))]
        by = F.struct(*[F.col(f"`{c}`").isNotNull() for c in order], *[F.col(f"`{c}`") for c in order], F.lit(0), *plain)
        found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_last"))
        return found.select(*[F.col(f"`{f.name}`") if f.name in self.keys else F.col("_last").getField(f.name).alias(f.name) for f in rows.schema])

    def _merge(self, m: Manifest | None, schema: T.StructType, upserts: DataFrame, deletes: DataFrame | None, load: LoadId, n: int) -> Loaded:
        """Upserts replace, deletes remove; only touched buckets are read and written."""
        keys = [F.col(f"`{k}`") for k in self.keys]
        gone = upserts.select(*keys) if deletes is None else upserts.select(*keys).union(deletes.select(*keys))
        touched = sorted(str(r[0]) for r in gone.select(self._bucket()).distinct().collect())  # at most as many as buckets
        fresh = upserts
        if m:
            old = _shaped(self._rows(m, touched), schema)
            fresh = old.join(gone.distinct(), list(self.keys), "left_anti").select(*[F.col(f"`{f.name}`") for f in schema]).unionByName(upserts)
        folders = {**(m.folders if m else {}), **(self._put(fresh, touched) if touched else {})}
        self._commit(m, schema, folders, load, n)
        return Loaded(n, self.path)

    def _changes(self, m: Manifest | None, load: LoadId, batch: DataFrame) -> Loaded:
        if not self.keys:
            raise SinkError("changes need keys")
        batch, last = check_ops(batch).persist(), None
        try:
            counts = {r["op"]: r["n"] for r in batch.groupBy(meta("op").alias("op")).agg(F.count(F.lit(1)).alias("n")).collect()}
            schema = self._schema(m, batch, evolve=m is None or bool(counts.get("c")))
            if m and not counts.get("c"):
                schema = m.schema
            if self.deletes == "column" and "_deleted_at" not in schema.fieldNames():
                schema = T.StructType([*schema.fields, T.StructField("_deleted_at", T.TimestampType())])
            rows = batch.where(meta("op").isin("i", "u", "s", "d"))
            if self.apply_truncate and counts.get("t"):
                bound = batch.where(meta("op") == "t").agg(F.max(meta("seq"))).first()[0]
                rows = rows.where(meta("seq") > F.lit(bound))
                m = Manifest(m.version, m.schema, m.keys, m.buckets, {}, m.loads) if m else None
            by_key = Window.partitionBy(*[F.col(f"`{k}`") for k in self.keys])
            last = rows.withColumn("_nth", F.row_number().over(by_key.orderBy(meta("seq").desc(), (meta("op") == "s").asc()))).where("_nth = 1").drop("_nth")
            last = self._filled(m, rows, last, by_key).persist()  # read for the buckets, the keys and the rows
            upserts = _shaped(last.where(meta("op") != "d"), schema)
            dropped = last.where(meta("op") == "d")
            if self.deletes == "column":
                kept = _shaped(dropped.withColumn("_deleted_at", meta("commit_ts")), schema)
                upserts, dropped = upserts.unionByName(kept), dropped.limit(0)
            if self.deletes == "side_table":
                keys = [F.col(f"`{k}`") for k in self.keys]
                KeyedTable(self.spark, f"{self.path}_deletes", self.keys, self.buckets).load(load, dropped.select(*keys, meta("commit_ts").alias("_deleted_at")))
            n = sum(counts.get(op, 0) for op in "iusd")
            return self._merge(m, schema, upserts, dropped, load, n)
        finally:
            for held in filter(None, (batch, last)):
                held.unpersist()

    def _filled(self, m: Manifest | None, rows: DataFrame, last: DataFrame, by_key) -> DataFrame:
        """Cells that an update left alone: the key's last value in this batch, else the stored one."""
        if "_cdc.unchanged" not in rows.columns:
            return last
        names = [c for c in data_columns(rows) if c not in self.keys]
        told = lambda c: ~F.coalesce(F.array_contains(meta("unchanged"), F.lit(c)), F.lit(False))
        whole = by_key.orderBy(meta("seq")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = rows.withColumn("_nth", F.row_number().over(by_key.orderBy(meta("seq").desc(), (meta("op") == "s").asc())))
        ranked = ranked.select("*", *[F.last(F.when(told(c), F.struct(F.col(f"`{c}`").alias("v"))), ignorenulls=True).over(whole).alias(f"_told_{c}") for c in names]).where("_nth = 1")
        if m:
            touched = [str(r[0]) for r in rows.select(self._bucket()).distinct().collect()]
            old = self._rows(m, touched).select(*[F.col(f"`{k}`") for k in self.keys], *[F.col(f"`{c}`").alias(f"_old_{c}") for c in names if c in m.schema.fieldNames()])
            ranked = ranked.join(old, list(self.keys), "left")
        value = lambda c: F.when(F.col(f"`_told_{c}`").isNotNull(), F.col(f"`_told_{c}`.v")).otherwise(F.col(f"`_old_{c}`") if f"_old_{c}" in ranked.columns else F.lit(None))
        return ranked.select(*[F.col(f"`{k}`") for k in self.keys], *[value(c).alias(c) for c in names], *[F.col(f"`{c}`") for c in rows.columns if c.startswith("_cdc.")])

    def replace(self, load: LoadId, frame: DataFrame) -> Loaded:
        """A full refresh: the new rows are written aside and take the table's place at once."""
        m = self.manifest()
        if m and load.text() in m.loads:
            return Loaded(0, self.path)
        rows = strip(frame)
        made = self._put(rows, None)
        n = self._count(rows.schema, made)
        self._commit(m, rows.schema, made, load, n)
        return Loaded(n, self.path)

    def _count(self, schema: T.StructType, folders: dict[str, list[str]]) -> int:
        return self._rows(Manifest(0, schema, self.keys, self.buckets, folders, {})).count()

    # ---- upkeep ----

    def compact(self, files: int = 1) -> None:
        """Rewrites rows in fewer files; no row changes."""
        m = self.manifest()
        if m is None:
            return
        rows = self._rows(m)
        if self.keys:
            made = self._put(rows, None)
        else:
            at = f"data/{uuid.uuid4().hex}/{BUCKET}=0"
            rows.coalesce(files).write.parquet(f"{self.path}/{at}")
            made = {"0": [at]}
        self._commit(m, m.schema, made, None, 0)

    def rebucket(self, buckets: int) -> None:
        m = self.manifest()
        self.buckets = buckets
        if m:
            self._commit(m, m.schema, self._put(self._rows(m), None), None, 0)

    def expire(self, keep: int = 1) -> None:
        """Removes all but the last versions, and the folders that no kept version uses."""
        held = self.versions()
        used = {f for v in held[-keep:] for fs in self.manifest(v).folders.values() for f in fs}
        gone = {f for v in held[:-keep] for fs in self.manifest(v).folders.values() for f in fs} - used
        for v in held[:-keep]:
            self.files.remove(f"_manifests/{v:010d}.json")
        for f in gone:
            self.files.remove(f)


def evolved(held: T.StructType, live: T.StructType) -> T.StructType:
    """The destination's schema after a change: columns are added (nullable) and widened, never dropped or narrowed."""
    refused = [c for c in diff(held, live) if c.kind == "narrow" or c.kind == "drop_column"]
    if refused:
        raise SinkError("refused: " + ", ".join(f"{c.kind}({c.column})" for c in refused))
    out = []
    for f in held:
        new = live[f.name].dataType
        out.append(T.StructField(f.name, new if widens(f.dataType, new) else f.dataType, f.nullable))
    return T.StructType([*out, *[T.StructField(f.name, f.dataType, True) for f in live if f.name not in held.fieldNames()]])


def _shaped(frame: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(frame.columns)
    return frame.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


class Routed(Sink):
    """A keyed table for each stream. ``streams`` has a stream's keys; others have ``keys``."""

    def __init__(self, spark: SparkSession, base: str, table: str | None = None, keys: tuple[str, ...] = (), streams: dict[str, tuple[str, ...]] | None = None, **more):
        self.spark, self.base, self.table, self.keys, self.streams, self.more = spark, base.rstrip("/"), table, keys, streams or {}, more

    def of(self, stream: str) -> KeyedTable:
        name = safe(table_name(stream, self.table))
        return KeyedTable(self.spark, f"{self.base}/{name}", self.streams.get(stream, self.keys), **self.more)

    def load(self, load: LoadId, batch: DataFrame) -> Loaded:
        return self.of(load.stream).load(load, batch)

    def load_streams(self, load: LoadId, batch: DataFrame, column: str = "_stream") -> dict[str, Loaded]:
        """Routes rows by their stream's name; the names are the pipeline's configured ones, so they are few."""
        from dataclasses import replace

        names = [r[0] for r in batch.select(column).distinct().collect()]
        return {n: self.load(replace(load, stream=n), batch.where(F.col(column) == n).drop(column)) for n in sorted(names)}
