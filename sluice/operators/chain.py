"""Chains of operators: one lazy DataFrame for kept rows, one for rejected rows, counters along the way."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transforms import Operator, TransformError, Validate


def derive_schema(operators: list[Operator], schema: T.StructType) -> T.StructType:
    """The chain's result schema, from the input's alone."""
    for i, op in enumerate(operators):
        try:
            schema = op.derive(schema)
        except ValueError as e:
            raise TransformError(f"operator {i} ({op.kind}): {e}") from e
    return schema


@dataclass
class Applied:
    """Kept rows; rejected rows with the index of the operator that rejected them; counters, filled by the first action
    (make it a write or a count: a sort reads its input twice, for its ranges first)."""

    kept: DataFrame
    rejected: DataFrame | None
    counters: dict[str, Observation]

    def counts(self) -> dict[str, int]:
        return {name: o.get["rows"] for name, o in self.counters.items()}


def apply(operators: list[Operator], frame: DataFrame, observed: bool = False) -> Applied:
    """Applies the operators in order. Kept and rejected rows read one lineage twice: persist the input, or write both
    in one batch, where it can't be read again."""
    derive_schema(operators, frame.schema)
    if "_cdc.op" in frame.columns and any(op.kind == "filter" for op in operators):
        warnings.warn("a filter over change rows also drops deletes whose row it doesn't keep; the destination keeps those rows", stacklevel=2)
    counters: dict[str, Observation] = {}

    def watch(now: DataFrame, name: str) -> DataFrame:
        if not observed:
            return now
        counters[name] = Observation(name)
        return now.observe(counters[name], F.count(F.lit(1)).alias("rows"))

    frame = watch(frame, "in")
    rejected = None
    for i, op in enumerate(operators):
        if isinstance(op, Validate) and op.on_violation == "reject":
            bad = frame.where(~op.passes(frame.schema)).withColumn("_rejected_by", F.lit(i))
            rejected = bad if rejected is None else rejected.unionByName(bad, allowMissingColumns=True)
        frame = watch(op.apply(frame), f"{i}:{op.kind}")
    return Applied(frame, rejected, counters)


def over_threshold(rejected: int, total: int, threshold: float | None = 0.01, fail_on_any: bool = False) -> bool:
    """Whether so many rejected rows fail a run. 0 and None switch the share off; ``fail_on_any`` is a rule of its own."""
    if fail_on_any:
        return rejected > 0
    return bool(threshold) and total > 0 and rejected / total > threshold
