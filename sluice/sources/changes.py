"""Change logs: envelopes, the binary replication stream of Postgres, and the metadata that change rows carry.

A change row has its table's columns and ``_cdc.op, _cdc.lsn, _cdc.commit_ts, _cdc.txid, _cdc.seq``. ``op`` is i, u, d,
s (snapshot), c (schema change), t (truncate) or h (heartbeat). ``seq`` orders rows totally and comes from the log.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..functions.types import OIDS, field_of
from .positions import lsn_text

META = T.StructType(
    [T.StructField("_cdc.op", T.StringType()), T.StructField("_cdc.lsn", T.StringType()), T.StructField("_cdc.commit_ts", T.TimestampType()), T.StructField("_cdc.txid", T.LongType()), T.StructField("_cdc.seq", T.LongType())]
)
#: Microseconds from 1970 to the epoch of the replication stream, 2000-01-01.
EPOCH = 946_684_800_000_000
#: Stands for a large value that an update left as it was.
UNCHANGED = "\x00unchanged\x00"


def meta(name: str) -> Column:
    return F.col(f"`_cdc.{name}`")


def data_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if not c.startswith("_cdc.")]


def strip(frame: DataFrame) -> DataFrame:
    """Rows without metadata columns."""
    return frame.select(*[F.col(f"`{c}`") for c in data_columns(frame)])


def snapshot(table: DataFrame, lsn: str, key: str) -> DataFrame:
    """A table's rows as change rows at a pinned position; they come before all that the log has."""
    made = {"op": F.lit("s"), "lsn": F.lit(lsn), "commit_ts": F.lit(None).cast("timestamp"), "txid": F.lit(None).cast("long"), "seq": F.lit(-1).cast("long")}
    return table.select("*", *[c.alias(f"_cdc.{n}") for n, c in made.items()])


class DecodeError(ValueError):
    pass


@dataclass
class Relation:
    id: int
    namespace: str
    name: str
    columns: list[tuple[str, int, bool]]  # name, type number, part of the key


@dataclass
class Event:
    op: str
    relation: Relation | None
    values: dict[str, str | None] = field(default_factory=dict)
    lsn: int = 0
    commit_us: int = 0
    txid: int = 0


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 1

    def take(self, form: str):
        size = struct.calcsize(">" + form)
        if self.at + size > len(self.data):
            raise DecodeError("message ends early")
        out = struct.unpack_from(">" + form, self.data, self.at)
        self.at += size
        return out[0] if len(out) == 1 else out

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise DecodeError("text without an end")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def row(self, relation: Relation) -> dict[str, str | None]:
        out: dict[str, str | None] = {}
        for name, _, _ in relation.columns[: self.take("H")]:
            kind = chr(self.take("B"))
            if kind == "n":
                out[name] = None
            elif kind == "u":
                out[name] = UNCHANGED
            elif kind == "t":
                size = self.take("I")
                out[name] = self.data[self.at : self.at + size].decode()
                self.at += size
            else:
                raise DecodeError(f"unknown column kind {kind!r}")
        return out


def decode(messages: Iterator[bytes], relations: dict[int, Relation] | None = None) -> Iterator[Event]:
    """Events of whole transactions, each with its own commit's position and time. Transactions without a commit at
    the end of the messages are left out; they come again with it."""
    relations = {} if relations is None else relations
    open_: list[Event] = []
    begun: tuple[int, int, int] | None = None
    for data in messages:
        if not data:
            raise DecodeError("empty message")
        tag, b = chr(data[0]), _Bytes(data)
        if tag == "B":
            begun, open_ = b.take("QqI"), []
        elif tag == "C":
            b.take("B")
            at, _, commit = b.take("QQq")
            for e in open_:
                e.lsn, e.commit_us, e.txid = at, commit + EPOCH, begun[2] if begun else 0
            yield from open_
            begun, open_ = None, []
        elif tag == "R":
            id_, namespace, name, _, n = b.take("I"), b.text(), b.text(), b.take("B"), b.take("H")
            columns = []
            for _ in range(n):
                flags, column = b.take("B"), b.text()
                type_, _ = b.take("Ii")
                columns.append((column, type_, bool(flags & 1)))
            now = Relation(id_, namespace, name, columns)
            held = relations.get(id_)
            if held and held.columns != columns:
                open_.append(Event("c", now))
            relations[id_] = now
        elif tag in "IUD":
            id_ = b.take("I")
            if id_ not in relations:
                raise DecodeError(f"unknown relation {id_}")
            r, kind = relations[id_], chr(b.take("B"))
            old = None
            if kind in "KO":
                old = b.row(r)
                if tag == "U":
                    kind = chr(b.take("B"))
            if tag == "D":
                if old is None:
                    raise DecodeError("delete without a row")
                keys = {c for c, _, k in r.columns if k} or set(old)
                open_.append(Event("d", r, {c: v if c in keys else None for c, v in old.items()}))
            else:
                if kind != "N":
                    raise DecodeError(f"unknown row kind {kind!r}")
                open_.append(Event(tag.lower(), r, b.row(r)))
        elif tag == "T":
            n = b.take("I")
            b.take("B")
            for _ in range(n):
                id_ = b.take("I")
                open_.append(Event("t", relations.get(id_)))
        elif tag not in "MYO":
            raise DecodeError(f"unknown message {tag!r}")


def table_schema(relation: Relation) -> T.StructType:
    return T.StructType([field_of(name, OIDS.get(oid, "unknown")) for name, oid, _ in relation.columns])


def typed(frame: DataFrame, schema: T.StructType, on_bad: str = "error") -> DataFrame:
    """Text cells as the schema's types; cells that an update left alone become null, their names are listed in
    ``_cdc.unchanged``."""
    parsers = {
        "boolean": scalars.parse_bool, "date": scalars.parse_date, "timestamp": scalars.parse_timestamp, "timestamp_ntz": scalars.parse_timestamp_ntz,
        "binary": lambda c, on_bad: scalars.parse_bytes(c, on_bad=on_bad),
    }
    names = [f.name for f in schema]
    left = F.array_compact(F.array(*[F.when(F.col(f"`{n}`") == UNCHANGED, F.lit(n)) for n in names]))
    out = []
    for f in schema:
        cell = F.nullif(F.col(f"`{f.name}`"), F.lit(UNCHANGED))
        if f.metadata.get("semantic") == "time_us":
            made = scalars.parse_time_us(cell, on_bad)
        elif isinstance(f.dataType, T.StringType):
            made = cell
        elif f.dataType.typeName() in parsers:
            made = parsers[f.dataType.typeName()](cell, on_bad=on_bad)
        else:
            made = scalars.parse_number(cell, f.dataType.simpleString(), on_bad)
        out.append(made.cast(f.dataType).alias(f.name))
    rest = [F.col(f"`{c}`") for c in frame.columns if c.startswith("_cdc.")]
    return frame.select(*out, *rest, left.alias("_cdc.unchanged"))


def decode_log(log: DataFrame, table: str, schema: T.StructType, segment: str = "segment", on_bad: str = "error") -> DataFrame:
    """Change rows of one table from a recorded binary log: rows ``segment, seq, data``. A segment starts with the
    relations it uses and ends with a commit, as a replication window does; segments are decoded side by side."""
    names = [f.name for f in schema]
    columns = [*names, *[f.name for f in META]]
    cells = ", ".join(f"`{n}` string" for n in names)
    ddl = f"{cells}, `_cdc.op` string, `_cdc.lsn` string, `_cdc.commit_ts` timestamp, `_cdc.txid` long, `_cdc.seq` long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        base, rows = int(pdf["seq"].iloc[0]), []
        for i, e in enumerate(decode(iter(pdf["data"]))):
            if e.relation and e.relation.name == table:
                rows.append((*[e.values.get(n) for n in names], e.op, lsn_text(e.lsn), pd.Timestamp(e.commit_us, unit="us"), e.txid, base + i))
        return pd.DataFrame(rows, columns=columns)

    return typed(log.groupBy(segment).applyInPandas(run, ddl), schema, on_bad)


def from_envelopes(frame: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Change rows from JSON envelopes ``{"op", "lsn", "ts_us", "txid", "seq", "row": {...}}``."""
    kind = T.StructType([T.StructField("op", T.StringType()), T.StructField("lsn", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("txid", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("row", schema)])
    e = frame.select(F.from_json(F.col(column), kind, {"mode": "FAILFAST"}).alias("e"))
    cells = [F.col("e.row").getField(f.name).alias(f.name) for f in schema]
    return e.select(*cells, F.col("e.op").alias("_cdc.op"), F.col("e.lsn").alias("_cdc.lsn"), F.timestamp_micros("e.ts_us").alias("_cdc.commit_ts"), F.col("e.txid").alias("_cdc.txid"), F.col("e.seq").alias("_cdc.seq"))


def whole_transactions(changes: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` first change rows, never cutting a transaction."""
    last = changes.orderBy(meta("seq")).limit(rows).agg(F.max_by(meta("txid"), meta("seq")).alias("t"), F.max(meta("seq")).alias("s")).first()
    if last["s"] is None:
        return changes.limit(0)
    return changes.where((meta("seq") <= F.lit(last["s"])) | (meta("txid") == F.lit(last["t"])))


def current_state(changes: DataFrame, keys: list[str], apply_truncate: bool = False) -> DataFrame:
    """The table that a change log leads to: each key's last row, deleted ones gone. Rows c, t and h aren't data; with
    ``apply_truncate`` rows before the last t are dropped. Cells left alone take the key's last known value."""
    from pyspark.sql import Window

    rows = changes
    if apply_truncate:
        cut = F.max(F.when(meta("op") == "t", meta("seq")))
        bound = changes.agg(cut).first()[0]
        if bound is not None:
            rows = rows.where(meta("seq") > F.lit(bound))
    rows = rows.where(meta("op").isin("i", "u", "d", "s"))
    order = [meta("seq")]
    by_key = Window.partitionBy(*[F.col(f"`{k}`") for k in keys])
    if "_cdc.unchanged" in changes.columns:
        before = by_key.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        names = [c for c in data_columns(changes) if c not in keys]
        filled = []
        for c in names:
            gone = F.coalesce(F.array_contains(meta("unchanged"), F.lit(c)), F.lit(False))
            told = F.when(~gone, F.struct(F.col(f"`{c}`").alias("v")))
            filled.append(F.last(told, ignorenulls=True).over(before).getField("v").alias(c))
        rows = rows.select(*[F.col(f"`{k}`") for k in keys], *filled, *[F.col(f"`{c}`") for c in changes.columns if c.startswith("_cdc.")])
    last = rows.withColumn("_nth", F.row_number().over(by_key.orderBy(*[o.desc() for o in order]))).where("_nth = 1").drop("_nth")
    return strip(last.where(meta("op") != "d"))


def check_ops(changes: DataFrame) -> DataFrame:
    """The rows, failing on an op that isn't one."""
    good = meta("op").isin("i", "u", "d", "s", "c", "t", "h")
    return changes.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(meta("op"), F.lit("null")))).cast("boolean")))
