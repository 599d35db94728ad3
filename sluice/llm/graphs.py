"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, release, stored

MOST_ROUNDS = 60
#: Edges that one task ties by itself, some 200 MB with its arrays; more are tied by rounds of joins.
ONE_TASK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges, sorted, and for each the index of its component's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]
        apart = up[x] != up[y]
        x, y = x[apart], y[apart]
    return nodes, up


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task tied to stars."""
    table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, up = roots(table.column("u").to_numpy(), table.column("v").to_numpy())
    leaf = np.flatnonzero(up != np.arange(len(up)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[up[leaf]])], names=["u", "v"])


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _spread(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _round(now: DataFrame) -> DataFrame:
    both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _spread(both, _least(both)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    small = _spread(large, _least(large))
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (a, b): root is the component's smallest node. The result is a table
    in the shared folder.

    At most ONE_TASK edges, which are counted before, are tied by one task; more are tied by rounds that tie a node's
    larger neighbours to its smallest one, then its smaller ones. Both give the same rows. A round's edges are a table that goes once the next one is there; its work is by joins
    and minima over edges, and no component is ever gathered."""
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(pairs.where("u <> v"))
    if now.count() <= ONE_TASK:
        settled = stored(now.coalesce(1).mapInArrow(_tied, "u long, v long"))
        forget(spark, now)
    else:
        before = None
        for _ in range(MOST_ROUNDS):
            after = stored(_round(now))
            forget(spark, now)
            release(spark)
            now = after
            state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
        else:
            raise RuntimeError("components did not settle")
        settled = now
    return settled.select(F.col("u").alias("node"), F.col("v").alias("root")).union(settled.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
