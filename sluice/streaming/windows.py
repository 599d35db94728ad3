"""Event-time windows over batches and streams, with what becomes of late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(frame: DataFrame, column: str, late: str | None = None) -> DataFrame:
    """The column as an instant (streams take no zone-less watermark), with a watermark for streams."""
    out = frame.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if late else out


def tumbling(frame: DataFrame, column: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return _flat(frame.groupBy(F.window(column, size), *keys).agg(*aggregates))


def sliding(frame: DataFrame, column: str, size: str, step: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return _flat(frame.groupBy(F.window(column, size, step), *keys).agg(*aggregates))


def session(frame: DataFrame, column: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return _flat(frame.groupBy(F.session_window(column, gap).alias("window"), *keys).agg(*aggregates))


def overall(frame: DataFrame, *aggregates: Column) -> DataFrame:
    """The global window: partial sums in each task, one row in the end."""
    return frame.agg(*aggregates)


def _flat(frame: DataFrame) -> DataFrame:
    rest = [c for c in frame.columns if c != "window"]
    return frame.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[F.col(f"`{c}`") for c in rest])


def late_rows(batch: DataFrame, column: str, watermark) -> tuple[DataFrame, DataFrame]:
    """Rows in time and late rows of a micro-batch, for a side output of the late ones."""
    late = F.col(column) < F.lit(watermark).cast("timestamp")
    return batch.where(~late | F.col(column).isNull()), batch.where(late)


def joined(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A stream-stream join; both sides need watermarks and ``on`` a time bound, so state stays bounded."""
    return left.join(right, on, how)
