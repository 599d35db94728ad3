"""Joins that Spark's planner has only one way for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(frame: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """``column NOT IN (SELECT key FROM other)``, as an anti join that shuffles where the other side is large; Spark's own
    plan broadcasts it at any size. With a null among the other keys nothing is left; a null in the column stays only if
    the other side is empty. What the other side has is told by one row."""
    told = other.agg(F.count(F.lit(1)).alias("_n"), F.count(F.col(f"`{key}`")).alias("_keys"))
    side = other.select(F.col(f"`{key}`").alias("_key")).where("_key IS NOT NULL").distinct()
    left = frame.join(side, F.col(f"`{column}`") == F.col("_key"), "left_anti").crossJoin(F.broadcast(told))
    return left.where((F.col("_n") == 0) | (F.col("_n") == F.col("_keys")) & F.col(f"`{column}`").isNotNull()).drop("_n", "_keys")
