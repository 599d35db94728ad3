"""User functions by ``name@version``: scalar, batch, transform (schema-changing) and aggregate.

There is no sandbox here: functions run in Python workers with what the cluster allows them. ``deterministic`` runs a
function twice on a sample and compares; it is a check, not a guarantee.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALAR: dict[str, Callable[[Column], Column]] = {"upper@0.1.0": F.upper, "lower@0.1.0": F.lower, "trim@0.1.0": F.trim}
_TABLE: dict[str, Callable] = {}
_BATCH: dict[str, tuple[Callable, Callable[[T.StructType], T.StructType]]] = {}


class FunctionError(ValueError):
    pass


def register_scalar(name: str, function: Callable[[pd.Series], pd.Series]) -> None:
    """A text to text function over batches; nulls never reach it and lengths must match."""
    if "@" not in name:
        raise FunctionError("name@version expected")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            there = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            got = function(texts[there])
            if len(got) != there.sum():
                raise FunctionError(f"{name}: {len(got)} values for {there.sum()}")
            out[there] = list(got)
            yield out

    _SCALAR[name] = run


def scalar(name: str) -> Callable[[Column], Column]:
    if name not in _SCALAR:
        raise FunctionError(f"no function {name!r}")
    return _SCALAR[name]


def schema_rule(rule: str, field: T.StructField | None = None, schema: T.StructType | None = None) -> Callable[[T.StructType], T.StructType]:
    """How a batch function's schema follows from its input's: identity, replace, add, drop, explicit."""
    rules = {
        "identity": lambda s: s,
        "replace": lambda s: T.StructType([field if f.name == field.name else f for f in s]),
        "add": lambda s: T.StructType([*s.fields, field]),
        "drop": lambda s: T.StructType([f for f in s if f.name != field.name]),
        "explicit": lambda s: schema,
    }
    if rule not in rules:
        raise FunctionError(f"unknown rule {rule!r}")
    return rules[rule]


def register_batch(name: str, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], derived: Callable[[T.StructType], T.StructType]) -> None:
    """A function of batches of rows (transform functions change how many there are)."""
    _BATCH[name] = function, derived


def apply_batch(name: str, frame: DataFrame) -> DataFrame:
    if name not in _BATCH:
        raise FunctionError(f"no function {name!r}")
    function, derived = _BATCH[name]
    return frame.mapInPandas(function, derived(frame.schema))


def register_table(spark, name: str, function: type, returns: str | T.StructType, deterministic: bool = True) -> str:
    """A table function, called by name in SQL or by ``apply_table``: a class whose ``eval`` yields the rows that a row
    becomes. Its SQL name is that before the ``@``."""
    if "@" not in name:
        raise FunctionError("name@version expected")
    made = F.udtf(function, returnType=returns)
    sql_name = name.split("@")[0]
    spark.udtf.register(sql_name, made.asDeterministic() if deterministic else made)
    _TABLE[name] = made
    return sql_name


def apply_table(name: str, frame: DataFrame, *arguments: str) -> DataFrame:
    """Each row beside the rows that the table function makes of its arguments; rows of which it makes none go."""
    if name not in _TABLE:
        raise FunctionError(f"no function {name!r}")
    return frame.lateralJoin(_TABLE[name](*[F.col(a).outer() for a in arguments]))


def aggregate(function: Callable[[pd.Series], float], returns: str = "double") -> Callable[[Column], Column]:
    """A grouped aggregate of one column; a group's values must fit a worker, so pre-aggregate hot groups first."""

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> float:
        return function(values)

    return run


def deterministic(function: Callable[[Column], Column], frame: DataFrame, column: str, rows: int = 1000) -> bool:
    sample = frame.select(F.col(column)).limit(rows).cache()
    try:
        first, second = ([r[0] for r in sample.select(function(F.col(column))).collect()] for _ in range(2))
        return first == second
    finally:
        sample.unpersist()
