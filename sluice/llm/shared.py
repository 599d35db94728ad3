"""Folders that all executors share, and sizes that plans are made from."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode (tests),
    and an error on a cluster, whose executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="sluice-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut, its rows kept where every executor can read them."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more: it does so when the driver's JVM
    collects its garbage, which a long job on a small heap may not do for hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(frame: DataFrame) -> DataFrame:
    """The frame written as a Parquet table in the shared folder and read again."""
    path = f"{shared_dir(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote, where no plan reads them any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def held(frame: DataFrame) -> Iterator[DataFrame]:
    """The frame written as a table, which is there inside the block only."""
    table = stored(frame)
    try:
        yield table
    finally:
        forget(frame.sparkSession, table)


def parts_for(total: float, each: float, least: int = 1) -> int:
    """So many parts that each holds about ``each`` of ``total``."""
    return max(least, math.ceil((total or 0) / each))


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, by one aggregation."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text)).cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0
