"""Transform operators: declarative steps over DataFrames.

Each operator checks itself against a schema (``check``), says which schema it gives (``derive``, without data) and
applies itself (``apply``). Checks are eager: whatever would fail for every row fails before any job starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import types as kinds
from ..functions.blake3 import blake3
from ..functions.scalars import tokenized
from .predicate import parse


class TransformError(ValueError):
    pass


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _field(schema: T.StructType, name: str) -> T.StructField:
    if name not in schema.fieldNames():
        raise TransformError(f"no column {name!r}")
    return schema[name]


def _new(schema: T.StructType, name: str) -> None:
    if name in schema.fieldNames():
        raise TransformError(f"column {name!r} exists")


class Operator:
    """A step that keeps or changes rows; ``splits`` marks the ones that also reject rows."""

    kind: ClassVar[str] = ""
    splits: ClassVar[bool] = False

    def derive(self, schema: T.StructType) -> T.StructType:
        return schema

    def apply(self, frame: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Select(Operator):
    kind = "select"
    columns: tuple[str, ...]

    def derive(self, schema):
        if len(set(self.columns)) < len(self.columns):
            raise TransformError("a column is selected twice")
        return T.StructType([_field(schema, c) for c in self.columns])

    def apply(self, frame):
        return frame.select(*[q(c) for c in self.columns])


@dataclass(frozen=True)
class Filter(Operator):
    kind = "filter"
    predicate: str
    strict: bool = False

    def derive(self, schema):
        parse(self.predicate, schema, self.strict)
        return schema

    def apply(self, frame):
        return frame.where(parse(self.predicate, frame.schema, self.strict))


@dataclass(frozen=True)
class Mask(Operator):
    """``how``: hash (BLAKE3), sha256 (salted), null, redact (whole, or all but the last ``keep_last`` characters, or
    after ``prefix``), remove, replace, tokenize (keyed)."""

    kind = "mask"
    column: str
    how: str = "hash"
    replacement: str = "[REDACTED]"
    salt: str = ""
    keep_last: int | None = None
    prefix: int | None = None
    key: str = ""

    def derive(self, schema):
        at = _field(schema, self.column)
        if self.how not in ("hash", "sha256", "null", "redact", "remove", "replace", "tokenize"):
            raise TransformError(f"unknown mask {self.how!r}")
        if not isinstance(at.dataType, T.StringType):
            raise TransformError(f"column {self.column!r} isn't text")
        if self.how in ("null", "remove") and not at.nullable:
            raise TransformError(f"column {self.column!r} can't be null")
        if self.how == "tokenize" and not self.key:
            raise TransformError("a key is needed")
        return schema

    def apply(self, frame):
        c = q(self.column)
        n = F.length(c)
        if self.how == "hash":
            out = blake3(c)
        elif self.how == "sha256":
            out = F.sha2(F.concat(F.lit(self.salt), c), 256)
        elif self.how in ("null", "remove"):
            out = F.lit(None).cast("string")
        elif self.how == "tokenize":
            out = tokenized(c, self.key)
        elif self.how == "redact" and self.keep_last is not None:
            out = F.concat(F.repeat(F.lit("*"), F.greatest(n - self.keep_last, F.lit(0))), F.right(c, F.lit(self.keep_last)))
        elif self.how == "redact" and self.prefix is not None:
            out = F.concat(F.left(c, F.lit(self.prefix)), F.repeat(F.lit("*"), F.greatest(n - self.prefix, F.lit(0))))
        else:
            out = F.when(c.isNotNull(), F.lit(self.replacement))
        return frame.withColumn(self.column, out)


@dataclass(frozen=True)
class AddColumn(Operator):
    """A constant, a typed null, or an expression in the predicate language's arithmetic."""

    kind = "add_column"
    name: str
    value: Any = None
    type: str | None = None
    expression: str | None = None

    def _type(self) -> T.DataType:
        if self.type:
            return T.DataType.fromDDL(self.type)
        for python, spark in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType())):
            if isinstance(self.value, python):
                return spark
        raise TransformError("a null needs a type")

    def derive(self, schema):
        _new(schema, self.name)
        if self.expression is not None:
            parse(self.expression, schema)
            from pyspark.sql import SparkSession

            return self.apply(SparkSession.active().createDataFrame([], schema)).schema
        return T.StructType([*schema.fields, T.StructField(self.name, self._type(), self.value is None)])

    def apply(self, frame):
        if self.expression is not None:
            made = parse(self.expression, frame.schema)
            return frame.withColumn(self.name, made.cast(self.type) if self.type else made)
        return frame.withColumn(self.name, F.lit(self.value).cast(self._type()))


@dataclass(frozen=True)
class Validate(Operator):
    """Rows that break a rule are rejected, or fail the run (``on_violation="fail"``). Rules: columns that must not be
    null, and predicates that must hold."""

    kind = "validate"
    splits = True
    not_null: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    on_violation: str = "reject"

    def derive(self, schema):
        for c in self.not_null:
            _field(schema, c)
        for p in self.predicates:
            parse(p, schema)
        return schema

    def passes(self, schema: T.StructType) -> Column:
        out = F.lit(True)
        for c in self.not_null:
            out = out & q(c).isNotNull()
        for p in self.predicates:
            out = out & F.coalesce(parse(p, schema), F.lit(False))
        return out

    def apply(self, frame):
        passes = self.passes(frame.schema)
        if self.on_violation == "fail":
            names = ", ".join([*self.not_null, *self.predicates])
            return frame.where(F.when(passes, True).otherwise(F.raise_error(F.lit(f"a row breaks: {names}")).cast("boolean")))
        return frame.where(passes)


@dataclass(frozen=True)
class ScalarUdf(Operator):
    """A registered function of one text column into a new one; null stays null."""

    kind = "scalar_udf"
    function: str
    input: str
    output: str

    def derive(self, schema):
        at = _field(schema, self.input)
        if not isinstance(at.dataType, T.StringType):
            raise TransformError(f"column {self.input!r} isn't text")
        _new(schema, self.output)
        from ..functions.registry import scalar

        scalar(self.function)
        return T.StructType([*schema.fields, T.StructField(self.output, T.StringType(), at.nullable)])

    def apply(self, frame):
        from ..functions.registry import scalar

        return frame.withColumn(self.output, scalar(self.function)(q(self.input)))


@dataclass(frozen=True)
class Project(Operator):
    """Keeps or drops columns, by name or by a pattern of names."""

    kind = "project"
    keep: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    keep_matching: str | None = None
    drop_matching: str | None = None

    def _names(self, schema: T.StructType) -> list[str]:
        import re

        for c in (*self.keep, *self.drop):
            _field(schema, c)
        out = list(self.keep) or schema.fieldNames()
        out = [c for c in out if c not in self.drop]
        if self.keep_matching:
            out = [c for c in out if re.fullmatch(self.keep_matching, c)]
        if self.drop_matching:
            out = [c for c in out if not re.fullmatch(self.drop_matching, c)]
        return out

    def derive(self, schema):
        return T.StructType([schema[c] for c in self._names(schema)])

    def apply(self, frame):
        return frame.select(*[q(c) for c in self._names(frame.schema)])


@dataclass(frozen=True)
class Rename(Operator):
    kind = "rename"
    names: dict[str, str]

    def derive(self, schema):
        for c in self.names:
            _field(schema, c)
        out = [T.StructField(self.names.get(f.name, f.name), f.dataType, f.nullable, f.metadata) for f in schema]
        if len({f.name for f in out}) < len(out):
            raise TransformError("two columns get one name")
        return T.StructType(out)

    def apply(self, frame):
        self.derive(frame.schema)
        return frame.select(*[q(c).alias(self.names.get(c, c)) for c in frame.columns])


@dataclass(frozen=True)
class Cast(Operator):
    """Widening is free, anything else needs ``narrowing``; ``on_bad_value``: error or null."""

    kind = "cast"
    column: str
    type: str
    narrowing: bool = False
    on_bad_value: str = "error"

    def derive(self, schema):
        at, to = _field(schema, self.column), T.DataType.fromDDL(self.type)
        if at.dataType != to and not kinds.widens(at.dataType, to) and not self.narrowing:
            raise TransformError(f"{at.dataType.simpleString()} to {to.simpleString()} isn't widening")
        return T.StructType([T.StructField(f.name, to, f.nullable or self.on_bad_value == "null") if f.name == self.column else f for f in schema])

    def apply(self, frame):
        c = q(self.column)
        return frame.withColumn(self.column, c.try_cast(self.type) if self.on_bad_value == "null" else c.cast(self.type))


@dataclass(frozen=True)
class Enrich(Operator):
    """A left join with reference data. Up to ``most_bytes`` (by the optimiser's estimate, and that is checked) the
    reference is broadcast; beyond that the join shuffles."""

    kind = "enrich"
    reference: DataFrame
    on: dict[str, str]
    columns: tuple[str, ...]
    most_bytes: int = 100 << 20

    def derive(self, schema):
        for c in self.on:
            _field(schema, c)
        for c in self.columns:
            _new(schema, c)
        return T.StructType([*schema.fields, *[T.StructField(c, _field(self.reference.schema, c).dataType, True) for c in self.columns]])

    def apply(self, frame):
        keys = {r: f"_on_{i}" for i, r in enumerate(self.on.values())}
        side = self.reference.select(*[q(r).alias(k) for r, k in keys.items()], *[q(c) for c in self.columns])
        size = int(str(side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size <= self.most_bytes:
            side = F.broadcast(side)
        held = [q(c) == F.col(keys[r]) for c, r in self.on.items()]
        on = held[0]
        for h in held[1:]:
            on = on & h
        return frame.join(side, on, "left").drop(*keys.values())


@dataclass(frozen=True)
class Union(Operator):
    """Fan-in: the rows of another branch or table after the chain's own, by column names; a column that one side lacks
    is null there. Equal rows all stay."""

    kind = "union"
    reference: DataFrame

    def derive(self, schema):
        have = set(schema.fieldNames())
        for f in self.reference.schema:
            if f.name in have and schema[f.name].dataType != f.dataType:
                raise TransformError(f"column {f.name!r} is {schema[f.name].dataType.simpleString()} here and {f.dataType.simpleString()} there")
        both = set(self.reference.columns)
        here = [T.StructField(f.name, f.dataType, f.nullable or f.name not in both or self.reference.schema[f.name].nullable) for f in schema]
        return T.StructType([*here, *[T.StructField(f.name, f.dataType, True) for f in self.reference.schema if f.name not in have]])

    def apply(self, frame):
        return frame.unionByName(self.reference, allowMissingColumns=True)


@dataclass(frozen=True)
class Dedupe(Operator):
    """One row for each key: ``any``, or the first or last by a column; ``within`` narrows the scope (a batch id)."""

    kind = "dedupe"
    keys: tuple[str, ...]
    keep: str = "any"
    by: str | None = None
    within: tuple[str, ...] = ()

    def derive(self, schema):
        for c in (*self.keys, *self.within, *([self.by] if self.by else [])):
            _field(schema, c)
        if self.keep not in ("any", "first", "last") or (self.keep != "any") != bool(self.by):
            raise TransformError("keep any, or the first or last by a column")
        return schema

    def apply(self, frame):
        keys = [*self.within, *self.keys]
        if self.keep == "any":
            return frame.dropDuplicates(keys)
        order = q(self.by).desc_nulls_last() if self.keep == "last" else q(self.by).asc_nulls_last()
        ranked = frame.withColumn("_nth", F.row_number().over(Window.partitionBy(*[q(k) for k in keys]).orderBy(order)))
        return ranked.where("_nth = 1").drop("_nth")


@dataclass(frozen=True)
class Flatten(Operator):
    """A struct's fields as columns with a prefix; the struct goes."""

    kind = "flatten"
    column: str
    prefix: str | None = None

    def _names(self, schema: T.StructType) -> list[tuple[str, T.StructField]]:
        at = _field(schema, self.column)
        if not isinstance(at.dataType, T.StructType):
            raise TransformError(f"column {self.column!r} isn't a struct")
        prefix = f"{self.column}_" if self.prefix is None else self.prefix
        return [(prefix + f.name, f) for f in at.dataType]

    def derive(self, schema):
        rest = [f for f in schema if f.name != self.column]
        for name, _ in self._names(schema):
            _new(T.StructType(rest), name)
        outer = schema[self.column].nullable
        return T.StructType([*rest, *[T.StructField(n, f.dataType, f.nullable or outer) for n, f in self._names(schema)]])

    def apply(self, frame):
        rest = [q(c) for c in frame.columns if c != self.column]
        return frame.select(*rest, *[q(self.column).getField(f.name).alias(n) for n, f in self._names(frame.schema)])


@dataclass(frozen=True)
class Unnest(Operator):
    """A row for each element of an array; without elements none, or with ``outer`` one with null."""

    kind = "unnest"
    column: str
    output: str | None = None
    position: str | None = None
    outer: bool = False

    def derive(self, schema):
        at = _field(schema, self.column)
        if not isinstance(at.dataType, T.ArrayType):
            raise TransformError(f"column {self.column!r} isn't an array")
        rest = [f for f in schema if f.name != self.column]
        more = [T.StructField(self.position, T.IntegerType(), self.outer)] if self.position else []
        return T.StructType([*rest, *more, T.StructField(self.output or self.column, at.dataType.elementType, at.dataType.containsNull or self.outer)])

    def apply(self, frame):
        rest = [q(c) for c in frame.columns if c != self.column]
        name = self.output or self.column
        if self.position:
            return frame.select(*rest, (F.posexplode_outer if self.outer else F.posexplode)(q(self.column)).alias(self.position, name))
        return frame.select(*rest, (F.explode_outer if self.outer else F.explode)(q(self.column)).alias(name))


@dataclass(frozen=True)
class Split(Operator):
    """The branch of each row: the first whose predicate holds, else the default."""

    kind = "split"
    branches: dict[str, str]
    default: str = "default"
    output: str = "branch"

    def derive(self, schema):
        _new(schema, self.output)
        for p in self.branches.values():
            parse(p, schema)
        return T.StructType([*schema.fields, T.StructField(self.output, T.StringType(), False)])

    def apply(self, frame):
        out = F.lit(self.default)
        for name, p in reversed(self.branches.items()):
            out = F.when(parse(p, frame.schema), F.lit(name)).otherwise(out)
        return frame.withColumn(self.output, out)

    def routed(self, frame: DataFrame) -> dict[str, DataFrame]:
        """A DataFrame for each branch."""
        tagged = self.apply(frame)
        return {b: tagged.where(F.col(self.output) == b).drop(self.output) for b in [*self.branches, self.default]}


_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct, "approx_distinct": F.approx_count_distinct,
    "array_agg": lambda c: F.array_sort(F.collect_list(c)), "first": F.first, "last": F.last,
}


@dataclass(frozen=True)
class Aggregate(Operator):
    """``measures``: output -> (function, column or *). The scope is the whole frame, or each value of ``within``."""

    kind = "aggregate"
    by: tuple[str, ...]
    measures: dict[str, tuple[str, str]] = field(default_factory=dict)
    within: tuple[str, ...] = ()

    def _made(self) -> list[Column]:
        out = []
        for name, (function, column) in self.measures.items():
            if function not in _AGGREGATES:
                raise TransformError(f"unknown aggregate {function!r}")
            out.append(_AGGREGATES[function](F.lit(1) if column == "*" else q(column)).alias(name))
        return out

    def derive(self, schema):
        for c in (*self.by, *self.within, *[c for _, c in self.measures.values() if c != "*"]):
            _field(schema, c)
        self._made()
        from pyspark.sql import SparkSession

        return self.apply(SparkSession.active().createDataFrame([], schema)).schema

    def apply(self, frame):
        return frame.groupBy(*[q(c) for c in (*self.within, *self.by)]).agg(*self._made())


@dataclass(frozen=True)
class Virtual(Operator):
    """Columns from the host: the run's start, and a repeatable pseudo-random number in [0, 1) of chosen columns."""

    kind = "virtual"
    now: str | None = None
    started_at: str = "1970-01-01 00:00:00"
    random: str | None = None
    of: tuple[str, ...] = ()

    def derive(self, schema):
        out = list(schema.fields)
        if self.now:
            _new(schema, self.now)
            out.append(T.StructField(self.now, T.TimestampType(), False))
        if self.random:
            _new(schema, self.random)
            out.append(T.StructField(self.random, T.DoubleType(), False))
        return T.StructType(out)

    def apply(self, frame):
        if self.now:
            frame = frame.withColumn(self.now, F.lit(self.started_at).cast("timestamp"))
        if self.random:
            bits = F.shiftrightunsigned(F.xxhash64(*[q(c) for c in self.of]), 11)
            frame = frame.withColumn(self.random, bits / F.lit(float(2**53)))
        return frame


OPERATORS = {c.kind: c for c in (Select, Filter, Mask, AddColumn, Validate, ScalarUdf, Project, Rename, Cast, Enrich, Union, Dedupe, Flatten, Unnest, Split, Aggregate, Virtual)}
