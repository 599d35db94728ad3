"""Mixing sources to target weights by weighted fair queueing.

Every document, in an order shuffled by a hash of its key and text, gets a virtual finish time: the words of its
source up to and including it, divided by the source's target. Later passes over a source go on where the pass
before ended. All finish times are sorted as one queue, which is cut where the total budget is reached.

Nothing needs a task for a whole source: running sums are taken within (source, hash bucket) groups of some
thousand documents and shifted by sums of the buckets before them; the queue is sorted by ranges of finish times, of
some QUEUE_ROWS entries each, whose sums tell the range where the budget ends; only that one is walked row by row.

Defined results: a null or empty text has size 0 and is never taken (0 words); a null source is a source of its own,
last in the order of sources; equal rows are queued one after the other, so the counts taken by them agree with any
order; an empty table gives an empty result. Columns beside those named are carried along; one named like an added
column (``size source_size target taken``) is replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, forget, parts_for, stored

#: Documents in a hash bucket of a source, and entries in a range of the queue, on average.
BUCKET_ROWS = 4096
QUEUE_ROWS = 1 << 18

ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size`` with the target of each source.

    Weights go to sources by code point, null last. A source is at its bound exactly if the words that sources with a
    smaller bound per weight leave over would still give it that bound, so one pass in that order finds the level.
    The table has a row for each source, already summed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    sized = sizes.withColumn("weight", F.get(kinds, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    sized = sized.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    left = total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    ranked = sized.withColumn("total", total).withColumn("level", level)
    ranked = ranked.withColumn("full", F.col("weight") * F.col("level") >= F.col("bound"))
    # the level of the first source below its bound holds for all after it
    held = F.min(F.when(~F.col("full"), F.struct(F.col("bound") / F.col("weight"), F.coalesce(F.col("source"), F.lit("\U0010ffff")), F.col("level")))).over(every)["level"]
    return ranked.withColumn("target", F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * held)).select("source", "source_size", "target", "total")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Rows of ``docs`` with their size, their source's size and target, and the words that the mix takes of them.

    ``carry``: the columns to return beside those, all by default; texts that aren't carried aren't shuffled."""
    keep = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry) if c not in ADDED]
    shuffled = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), shuffled.alias("at"))
    ranks = cut(_queued(rows.select("source", "size", "at"), weights, share, most))
    return _joined(rows, ranks)


def _joined(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Equal rows share their key; the i-th of them gets the i-th result."""
    nth = Window.partitionBy("at", "source", "size").orderBy(F.lit(0))
    left = rows.withColumn("nth", F.row_number().over(nth))
    right = ranks.withColumn("nth", F.row_number().over(nth)).withColumnsRenamed({"at": "r_at", "source": "r_source", "size": "r_size", "nth": "r_nth"})
    same = left["at"].eqNullSafe(right["r_at"]) & left["source"].eqNullSafe(right["r_source"]) & (left["size"] == right["r_size"]) & (left["nth"] == right["r_nth"])
    return left.join(right, same).select("row.*", "size", "source_size", "target", "taken")


def _queued(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    n = rows.select(F.count(F.lit(1))).first()[0]
    digits = max(1, math.ceil(math.log(max(n, 2) / BUCKET_ROWS, 16))) if n > BUCKET_ROWS else 1
    rows = rows.withColumn("bucket", F.substring("at", 1, digits))
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    aims = cut(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    offsets = offsets.withColumnsRenamed({"source": "o_source", "bucket": "o_bucket"})
    aims = aims.withColumnRenamed("source", "a_source")
    shifts = offsets.join(aims, offsets["o_source"].eqNullSafe(aims["a_source"])).drop("a_source")
    within = Window.partitionBy("source", "bucket").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("size").over(within))
    summed = summed.join(shifts, summed["source"].eqNullSafe(shifts["o_source"]) & (summed["bucket"] == shifts["o_bucket"])).drop("o_source", "o_bucket", "bucket")
    summed = cut(summed.withColumn("upto", F.col("upto") + F.col("offset")).drop("offset"))

    passes = math.ceil(most)
    finish = lambda p: (F.lit(p) * F.col("source_size") + F.col("upto")) / F.nullif(F.col("target"), F.lit(0.0))
    items = summed.where("size > 0").select("at", "source", "size", "total", F.explode(F.array(*[F.struct(F.lit(p).alias("turn"), finish(p).alias("v")) for p in range(passes)])).alias("i")).select("at", "source", "size", "total", "i.*").where("v is not null")
    place = [F.col("v"), F.col("source").asc_nulls_last(), F.col("at"), F.col("turn")]
    queue = stored(items.repartitionByRange(parts_for(passes * n, QUEUE_ROWS), *place).withColumn("range", F.spark_partition_id()))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    sums = queue.groupBy("range").agg(F.sum("size").alias("words"), F.max("total").alias("total")).withColumn("upto", F.sum("words").over(upto))
    crossing = sums.where("upto > total").orderBy("range").first()  # the range where the budget ends
    cut_at = F.lit(True)
    if crossing is not None:
        inside = Window.partitionBy("range").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
        spent = F.sum("size").over(inside) + F.lit(crossing["upto"] - crossing["words"])
        last = queue.where(F.col("range") == crossing["range"]).withColumn("spent", spent).where("spent > total").orderBy(*place).first()  # the first entry beyond it
        rank = lambda s: F.coalesce(s, F.lit("\U0010ffff\U0010ffff"))
        here = F.struct(F.col("v").alias("v"), rank(F.col("source")).alias("s"), F.col("at").alias("at"), F.col("turn").alias("turn"))
        there = F.struct(F.lit(last["v"]).alias("v"), rank(F.lit(last["source"]).cast("string")).alias("s"), F.lit(last["at"]).alias("at"), F.lit(last["turn"]).alias("turn"))
        cut_at = here < there
    forget(rows.sparkSession, queue)
    taken = F.lit(0).cast("long")
    for p in range(passes):
        one = summed.withColumn("v", finish(p)).withColumn("turn", F.lit(p))
        summed = one.withColumn(f"t{p}", F.when(F.col("v").isNotNull() & cut_at, F.col("size")).otherwise(F.lit(0)).cast("long")).drop("v", "turn")
        taken = taken + F.col(f"t{p}")
    return summed.select("at", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS ky
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS bound,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM s),
t AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, bound / weight AS ratio FROM w),
l AS (
  SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM t),
a AS (
  SELECT source, source_size, total,
         CASE WHEN weight * level >= bound THEN bound
              ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE weight * level < bound) END AS target
  FROM l),
c AS (
  SELECT d.*, a.source_size, a.target, a.total,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ky, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
         row_number() OVER () AS r
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
i AS (
  SELECT r, source, ky, size, total, p AS turn, (p * source_size + upto)::DOUBLE / target AS v
  FROM c, (SELECT unnest([0, 1]) AS p) WHERE size > 0),
q AS (SELECT r, size, total, sum(size) OVER (ORDER BY v, source NULLS LAST, ky, turn ROWS UNBOUNDED PRECEDING) AS spent FROM i),
k AS (SELECT r, sum(size)::BIGINT AS taken FROM q WHERE spent <= total GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (r)
"""


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, carry=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")
