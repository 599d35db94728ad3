"""Counters, gauges and durations of runs, as rows and as text for a scraper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .state import Store

# Names that dashboards know.
RUNS_STARTED = "etl_runs_started_total"
RUNS_COMPLETED = "etl_runs_completed_total"
RUNS_FAILED = "etl_runs_failed_total"
ROWS_READ = "etl_rows_read_total"
ROWS_LOADED = "etl_rows_loaded_total"
ROWS_REJECTED = "etl_rows_rejected_total"
CDC_EVENTS = "etl_cdc_events_total"
SLOT_LAG_BYTES = "etl_cdc_slot_lag_bytes"
DURATION_SECONDS = "etl_activity_duration_seconds"


def of_runs(store: Store, pipeline: str) -> dict[str, float]:
    """Sums over the last record of each of a pipeline's runs."""
    records = [store.get(f"runs/{pipeline}/{n.removesuffix('.doc')}") for n in store.files.names(f"runs/{pipeline}")]
    total = lambda k: float(sum(r.get(k) or 0 for r in records))
    count = lambda state: float(sum(r["state"] == state for r in records))
    return {
        RUNS_STARTED: float(len(records)), RUNS_COMPLETED: count("completed"), RUNS_FAILED: count("failed"),
        ROWS_READ: total("read"), ROWS_LOADED: total("loaded"), ROWS_REJECTED: total("rejected"), DURATION_SECONDS: total("seconds"),
    }


def of_changes(events: int, lag: int) -> dict[str, float]:
    return {CDC_EVENTS: float(events), SLOT_LAG_BYTES: float(lag)}


def rows(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), "name string, value double")


def exposition(values: dict[str, float], **labels: str) -> str:
    """The text format of scrapers, a line for each value."""
    escaped = {k: v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for k, v in labels.items()}
    tags = ",".join(f'{k}="{v}"' for k, v in sorted(escaped.items()))
    return "".join(f"{n}{{{tags}}} {v:g}\n" if tags else f"{n} {v:g}\n" for n, v in sorted(values.items()))
