"""Incremental scans of tables by a cursor column.

A scan takes up where the last one ended. By default it reads the boundary value again (``>=``) and leaves it to the
keyed load to settle repeated rows, so ties across a page's edge aren't lost; ``strict`` reads only beyond it. A page
never ends within rows of one cursor value, so it always gets on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.state import Cursor


#: Rows up to which a page's bound comes from a top-k; beyond it each task would hold a page of rows, one task all bounds.
TOP = 10_000
#: Ranges of cursor values that one step of a larger page's bound counts.
RANGES = 1000


class CursorError(ValueError):
    pass


def kind_of(field: T.StructField) -> str:
    if isinstance(field.dataType, T.IntegralType):
        return "int64"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp_tz"
    raise CursorError(f"column {field.name!r} of type {field.dataType.simpleString()} can't be a cursor")


def literal(cursor: Cursor, field: T.StructField) -> Column:
    if cursor.kind not in ("int64", "timestamp_tz"):
        raise CursorError(f"a {cursor.kind} position can't bind a scan")
    if cursor.kind != kind_of(field):
        raise CursorError(f"a {cursor.kind} position doesn't fit column {field.name!r}")
    if cursor.kind == "int64":
        return F.lit(int(cursor.value)).cast(field.dataType)
    text = cursor.value.removesuffix("Z") if isinstance(field.dataType, T.TimestampNTZType) else cursor.value
    return F.lit(text).cast(field.dataType)


def text_of(value: Column, field: T.StructField) -> Column:
    """A cursor value as a position's text: whole numbers, or microseconds with Z."""
    if kind_of(field) == "int64":
        return value.cast("string")
    return F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


@dataclass(frozen=True)
class CursorScan:
    """A table read by cursor. ``cursor_class``: strictly_increasing, non_decreasing (needs keys) or unreliable
    (refused). ``window``: only cursor values in [low, high), for backfills that may run side by side."""

    cursor: str
    keys: tuple[str, ...] = ()
    columns: tuple[str, ...] | None = None
    cursor_class: str = "non_decreasing"
    resume: str = "inclusive"
    allow_nullable: bool = True

    def check(self, schema: T.StructType) -> None:
        if not schema.fields:
            raise CursorError("the table has no columns")
        if self.cursor not in schema.fieldNames():
            raise CursorError(f"no column {self.cursor!r}")
        kind_of(schema[self.cursor])
        if self.cursor_class == "unreliable":
            raise CursorError("an unreliable cursor can't drive a sync")
        if self.cursor_class == "non_decreasing" and not self.keys and self.resume == "inclusive":
            raise CursorError("a cursor with ties needs keys")
        if not self.allow_nullable and schema[self.cursor].nullable:
            raise CursorError("the cursor can be null")

    def after(self, table: DataFrame, position: Cursor | None) -> DataFrame:
        """Rows from the position on. Without one all rows, those without a cursor value too."""
        self.check(table.schema)
        out = table if self.columns is None else table.select(*[F.col(f"`{c}`") for c in self.columns])
        if position is None:
            return out
        bound = literal(position, table.schema[self.cursor])
        column = F.col(f"`{self.cursor}`")
        return out.where(column >= bound if self.resume == "inclusive" else column > bound)

    def window(self, table: DataFrame, low: str, high: str) -> DataFrame:
        field = table.schema[self.cursor]
        at = lambda v: literal(Cursor(kind_of(field), v), field)
        column = F.col(f"`{self.cursor}`")
        return self.after(table, None).where((column >= at(low)) & (column < at(high)))

    def without(self, table: DataFrame) -> DataFrame:
        """Rows that have no cursor value. No position is ever beyond them, so a run reads them once, before all pages."""
        return self.after(table, None).where(F.col(f"`{self.cursor}`").isNull())

    def page(self, table: DataFrame, position: Cursor | None, rows: int, upto: Cursor | None = None) -> DataFrame:
        """About ``rows`` rows in cursor order, with all ties of the last one. The bound comes from a top-k or, for a
        large page, from counts of ranges, not from a sort of the table, or is given: then all rows up to it. Rows
        without a cursor value are in no page, see ``without``."""
        column = F.col(f"`{self.cursor}`")
        found = self.after(table, position).where(column.isNotNull())
        if upto is not None:
            return found.where(column <= literal(upto, table.schema[self.cursor]))
        fresh = found  # rows at an inclusive position come again; they don't count, or they could fill the page for ever
        if position is not None and self.resume == "inclusive":
            fresh = found.where(column > literal(position, table.schema[self.cursor]))
        last = _nth(fresh, self.cursor, rows)
        return found if last is None else found.where(column <= last)

    def position(self, rows: DataFrame) -> Cursor | None:
        """The position after these rows: the largest cursor value, as the source gave it."""
        field = rows.schema[self.cursor]
        got = rows.agg(text_of(F.max(F.col(f"`{self.cursor}`")), field)).first()[0]
        return None if got is None else Cursor(kind_of(field), got)


def _number(value: Column, field: T.StructField) -> Column:
    """A cursor value as a whole number in the same order: days, microseconds or itself."""
    if isinstance(field.dataType, T.DateType):
        value = F.unix_date(value)
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    return value.cast("long")


def _value(number: int, field: T.StructField) -> Column:
    """The cursor value that a number stands for."""
    if isinstance(field.dataType, T.DateType):
        return F.date_from_unix_date(F.lit(number))
    out = F.timestamp_micros(F.lit(number).cast("long")) if kind_of(field) == "timestamp_tz" else F.lit(number)
    return out.cast(field.dataType)


def _nth(table: DataFrame, cursor: str, n: int) -> Column | None:
    """The n-th smallest value of a column without nulls, None where there are fewer rows. Beyond ``TOP`` the range that
    holds it is narrowed some thousandfold a step, so no task holds more than counts of ranges."""
    column, field = F.col(f"`{cursor}`"), table.schema[cursor]
    if n <= TOP:
        last = table.orderBy(column).limit(n).agg(F.max(column).alias("last"), F.count(F.lit(1)).alias("n")).first()
        return None if last["n"] < n else F.lit(last["last"])
    values = table.select(_number(column, field).alias("v"))
    low, high, count = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if count < n:
        return None
    while low < high:
        width = (high - low) // RANGES + 1
        held = values.where(F.col("v").between(low, high)).groupBy(F.expr(f"v div {width}L").alias("nth"))
        for _, low, high, count in sorted(held.agg(F.min("v"), F.max("v"), F.count("v")).collect()):
            if n <= count:
                break
            n -= count
    return _value(low, field)


def snapshot_chunk(table: DataFrame, key: str, last: int | None, rows: int) -> DataFrame:
    """The next chunk of a keyed snapshot. Without a last key it starts at the smallest, below zero too."""
    column = F.col(f"`{key}`")
    found = table if last is None else table.where(column > F.lit(last))
    return found.orderBy(column).limit(rows)


def ranges(table: DataFrame, key: str, parts: int) -> list[tuple[int, int]]:
    """Closed key ranges of about equal size, for snapshots whose chunks run side by side."""
    cuts = table.agg(F.min(key), F.max(key), F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()
    if cuts[0] is None:
        return []
    edges = sorted({cuts[0], *[c + 1 for c in cuts[2]], cuts[1] + 1})
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def deleted_keys(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Keys at the destination that the source no longer has."""
    return target.select(*keys).join(source.select(*keys), keys, "left_anti")


def synthetic_key(frame: DataFrame, columns: list[str], name: str = "_key") -> DataFrame:
    """A key for tables without one: a hash of chosen columns, nulls told from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns]
    return frame.withColumn(name, F.sha2(F.to_json(F.array(*parts)), 256))


def composite(frame: DataFrame, columns: list[str], values: list) -> DataFrame:
    """Rows after a position of several columns, compared as one."""
    here = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    there = F.struct(*[F.lit(v).cast(frame.schema[c].dataType).alias(f"c{i}") for i, (c, v) in enumerate(zip(columns, values, strict=True))])
    return frame.where(here > there)


def latest(frame: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key."""
    order = [F.col(f"`{c}`").desc_nulls_last() for c in by]
    return frame.withColumn("_nth", F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))).where("_nth = 1").drop("_nth")
