"""Logical types of sources, the Spark types that hold them, and which changes of a type widen it."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names used by sources (lower case) and the Spark type of each.
NAMES: dict[str, T.DataType] = {
    "int2": T.ShortType(), "smallint": T.ShortType(), "int16": T.ShortType(),
    "int4": T.IntegerType(), "int": T.IntegerType(), "integer": T.IntegerType(), "int32": T.IntegerType(), "mediumint": T.IntegerType(),
    "int8": T.LongType(), "bigint": T.LongType(), "int64": T.LongType(), "tinyint": T.IntegerType(),
    "float4": T.FloatType(), "real": T.FloatType(), "float": T.FloatType(), "float32": T.FloatType(),
    "float8": T.DoubleType(), "double": T.DoubleType(), "double precision": T.DoubleType(), "float64": T.DoubleType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "bit": T.BooleanType(),
    "text": T.StringType(), "varchar": T.StringType(), "character varying": T.StringType(), "char": T.StringType(), "bpchar": T.StringType(), "string": T.StringType(), "utf8": T.StringType(),
    "json": T.StringType(), "jsonb": T.StringType(), "uuid": T.StringType(),
    "bytea": T.BinaryType(), "blob": T.BinaryType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(),
    "date": T.DateType(), "time": T.LongType(),
    "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "datetime": T.TimestampType(),
    "timestamp": T.TimestampNTZType(), "timestamp without time zone": T.TimestampNTZType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
}
#: What the Spark type alone doesn't say.
MEANING = {"json": {"semantic": "json"}, "jsonb": {"semantic": "json"}, "time": {"semantic": "time_us"}, "uuid": {"source_type": "uuid"}}

#: Type numbers in a Postgres replication stream.
OIDS = {16: "bool", 17: "bytea", 20: "int8", 21: "int2", 23: "int4", 25: "text", 114: "json", 700: "float4", 701: "float8", 1042: "bpchar", 1043: "varchar", 1082: "date", 1083: "time", 1114: "timestamp", 1184: "timestamptz", 1700: "numeric", 2950: "uuid", 3802: "jsonb"}

_WIDER = [("byte", "short", "integer", "long"), ("float", "double"), ("varchar", "string"), ("char", "string")]


def field_of(name: str, source_type: str, nullable: bool = True, precision: int | None = None, scale: int | None = None) -> T.StructField:
    """The field of a column of a source; unknown types are text that remembers its source type."""
    kind = source_type.lower()
    if kind in ("numeric", "decimal"):
        if precision is None or precision > 38:
            return T.StructField(name, T.StringType(), nullable, {"source_type": kind})
        return T.StructField(name, T.DecimalType(precision, scale or 0), nullable)
    if kind in NAMES:
        return T.StructField(name, NAMES[kind], nullable, MEANING.get(kind, {}))
    return T.StructField(name, T.StringType(), nullable, {"source_type": kind})


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether every value of ``old`` is one of ``new``, and the two differ."""
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return old != new and new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    if isinstance(old, T.TimestampNTZType) and isinstance(new, T.TimestampType):
        return False
    if isinstance(old, T.DateType) and isinstance(new, T.TimestampNTZType):
        return True
    for chain in _WIDER:
        a, b = old.typeName(), new.typeName()
        if a in chain and b in chain:
            return chain.index(a) < chain.index(b)
    return False


def narrows(old: T.DataType, new: T.DataType) -> bool:
    return widens(new, old)
