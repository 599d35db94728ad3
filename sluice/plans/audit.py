"""Audit chains, metering sums and lineage events."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def chained(events: list[dict]) -> list[dict]:
    """Events of one tenant with the hash of each: of the hash before and the event's canonical JSON."""
    out, prev = [], GENESIS
    for e in events:
        body = json.dumps(e, sort_keys=True, separators=(",", ":"))
        own = hashlib.sha256((prev + body).encode()).hexdigest()
        out.append({**e, "body": body, "prev_hash": prev, "hash": own})
        prev = own
    return out


def broken(log: DataFrame) -> DataFrame:
    """Rows ``tenant, id, body, prev_hash, hash`` whose own hash is wrong, or that don't follow the row before."""
    before = F.lag("hash").over(Window.partitionBy("tenant").orderBy("id"))
    own = F.sha2(F.concat("prev_hash", "body"), 256)
    return log.withColumn("_before", before).where((own != F.col("hash")) | (F.col("prev_hash") != F.coalesce("_before", F.col("prev_hash")))).drop("_before")


def prunable(log: DataFrame, verified_to: int) -> DataFrame:
    """Rows of the verified prefix, the only ones that may go."""
    return log.where(F.col("id") <= verified_to)


def metered(events: DataFrame, at: str = "emitted_at") -> DataFrame:
    """Sums by tenant, metric and day; an event that comes again counts once."""
    return events.dropDuplicates(["event_id"]).groupBy("tenant", "metric", F.to_date(at).alias("day")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_events"))


def lineage(run: str, stage: str, frame: DataFrame, output: str, at: datetime) -> dict:
    """The data sets that a stage's plan reads, and the one it makes."""
    return {"run": run, "stage": stage, "inputs": sorted(frame.inputFiles()), "output": output, "at": at.isoformat()}
