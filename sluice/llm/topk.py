"""Exact top-k search by tiled matrix products.

Queries go out in tiles of bounded size, one tile a pass over the vectors, and the driver holds one tile at a time: the
lists of a pass are written before the next tile is fetched. Each task multiplies the tile with shards
of its rows, selects the best of each shard (composite keys of score and id, so ties are exact), merges them into
its own best lists, and the lists of all tasks are merged as a tree: first by groups of tasks, then by query.

Scores are integer inner products of ``floor(256 * x)``. They are exact: a product runs in float64 only if every
partial sum is below 2**53, else in Python integers (saturated at 64 bits).

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null
id (they can't be named); vectors of another length than the query's aren't its candidates; an empty vector scores 0;
a query's own row is left out once, equal rows and other rows of its id stay; ties go to the smaller id; a query with
fewer candidates than k returns all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Queries in a tile: with 1024 components this is at most 64 MB, all that a pass broadcasts.
TILE_QUERIES = 8192
#: Rows of a shard that is multiplied with a tile at once.
SHARD_ROWS = 2048
#: Queries of a block within a tile; a block times a shard is held at once.
BLOCK_QUERIES = 1024
#: Tasks' lists that the first level of the merge tree joins.
FAN_IN = 16

_LISTS = "query_id long, q long, src int, vec_id long, score long"


def quantised(table: pa.RecordBatch, vector: str = "v") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: rows' ids and components, as floats that hold integers."""
    ids = table.column("vec_id").to_numpy(zero_copy_only=False)
    lists = table.column(vector)
    lists = lists.cast(pa.list_(pa.float64()))
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    length = np.diff(off)
    out = {}
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        out[n] = ids[rows], np.floor(256.0 * flat[off[rows][:, None] + np.arange(n)]) if n else np.zeros((len(rows), 0))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b, as int64 saturated."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of scores, by score, then by smaller id. ids: of the columns, or for each cell."""
    if ids.ndim == 1:
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], np.broadcast_to(ids[order], scores.shape)
        n = scores.shape[1]
        if k < n and scores.size and np.abs(scores).max() < 2**62 // n:
            composite = scores * n + np.arange(n - 1, -1, -1)
            top = np.argpartition(composite, n - k, axis=1)[:, n - k :]
            scores, ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
    order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == -(2**63) else -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _searcher(queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                for n, (ids, rows) in quantised(batch.slice(at, SHARD_ROWS)).items():
                    if n not in queries:
                        continue
                    asked = queries[n][2]
                    got = []
                    for q in range(0, len(asked), BLOCK_QUERIES):
                        got.append(best(products(asked[q : q + BLOCK_QUERIES], rows), ids, k))
                    s, i = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
                    if n in held:
                        s, i = best(np.concatenate([held[n][0], s], 1), np.concatenate([held[n][1], i], 1), k)
                    held[n] = s, i
        src = TaskContext.get().partitionId()
        for n, (s, i) in held.items():
            width = s.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(queries[n][0], width)), pa.array(np.repeat(queries[n][1], width)), pa.array(np.full(s.size, src, np.int32)), pa.array(i.ravel()), pa.array(s.ravel())],
                names=["query_id", "q", "src", "vec_id", "score"],
            )

    return search


def _tile(queries: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A tile's queries by length: ids, numbers and components."""
    sent: dict[int, list] = {}
    for batch in queries.select("vec_id", "q", "v").toArrow().combine_chunks().to_batches():
        numbers = batch.column("q").to_numpy(zero_copy_only=False)
        length = np.diff(batch.column("v").offsets.to_numpy())
        for n, (ids, rows) in quantised(batch).items():
            sent.setdefault(n, []).append((ids, numbers[length == n], rows))
    return {n: tuple(np.concatenate([x[j] for x in parts]) for j in range(3)) for n, parts in sent.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of ``queries`` (rows of ``vectors``) its k best other rows: ``query_id, rank, vec_id, score``."""
    clean = lambda d: d.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    )
    spark = vectors.sparkSession
    asked = stored(clean(queries).withColumn("q", F.monotonically_increasing_id()))
    tiles = max(1, math.ceil(asked.count() / TILE_QUERIES))
    asked = asked.withColumn("tile", F.pmod(F.xxhash64("q"), F.lit(tiles)))
    passes = []
    for t in range(tiles):  # a bounded block of queries against all rows
        found = clean(vectors).select("vec_id", "v").mapInArrow(_searcher(_tile(asked.where(F.col("tile") == t)), k + 1), _LISTS)
        passes.append(found if tiles == 1 else stored(found))
    lists = reduce(DataFrame.union, passes)
    selves = asked.select(F.col("q").alias("self"), F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: s + F.floor(x * 256).cast("decimal(19,0)") * F.floor(x * 256).cast("decimal(19,0)")).alias("square"))
    order = (F.col("score").desc(), F.col("vec_id"))
    first = Window.partitionBy("query_id", "q", F.floor(F.col("src") / FAN_IN)).orderBy(*order)
    second = Window.partitionBy("query_id", "q").orderBy(*order)
    merged = lists.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).withColumn("n", F.row_number().over(second)).where(F.col("n") <= k + 1)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score").cast("decimal(38,0)") == F.least(F.col("square"), F.lit(2**63 - 1).cast("decimal(38,0)")))
    # the row itself is any one candidate of its id and its own square; rows that agree in both can't be told apart in the result
    mine = F.min(F.when(own, F.col("n"))).over(Window.partitionBy("query_id", "q"))
    kept = merged.join(selves, F.col("q") == F.col("self")).withColumn("mine", mine).where(F.col("mine").isNull() | (F.col("n") != F.col("mine")))
    rank = F.when(F.col("n") > F.col("mine"), F.col("n") - 1).otherwise(F.col("n"))
    return kept.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 5
"""


def op5_topk_exact(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
