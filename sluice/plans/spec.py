"""Pipelines as YAML documents and as dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from ..operators.transforms import OPERATORS, Operator
from .state import Store

# Fixed values of the document format.
API = "platform.etl/v0"
KINDS = ("Connection", "Pipeline")


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Resource:
    kind: str
    name: str
    spec: dict


def documents(text: str) -> list[Resource]:
    import yaml

    out = []
    for doc in filter(None, yaml.safe_load_all(text)):
        if doc.get("apiVersion") != API:
            raise SpecError(f"unknown apiVersion {doc.get('apiVersion')!r}")
        if doc.get("kind") not in KINDS:
            raise SpecError(f"unknown kind {doc.get('kind')!r}")
        name = (doc.get("metadata") or {}).get("name")
        if not name:
            raise SpecError("metadata.name is missing")
        out.append(Resource(doc["kind"], name, doc.get("spec") or {}))
    return out


def operators(steps: list[dict]) -> list[Operator]:
    """Operators of ``transform`` steps: ``{"kind"|"type": ..., parameters}``."""
    out = []
    for i, step in enumerate(steps):
        step = {"on" if k is True else k: v for k, v in step.items()}  # YAML reads a bare "on" as true
        kind = step.pop("kind", None) or step.pop("type", None)
        if kind not in OPERATORS:
            raise SpecError(f"operator {i}: unknown kind {kind!r}")
        for key, value in step.items():
            if isinstance(value, list):
                step[key] = tuple(value)
        if kind == "aggregate":
            step["measures"] = {k: tuple(v) for k, v in step.get("measures", {}).items()}
        if kind in ("enrich", "union") and isinstance(step.get("reference"), str):  # a table, or the folder of one
            spark = SparkSession.active()
            at = step["reference"]
            step["reference"] = spark.read.parquet(at) if "/" in at else spark.table(at)
        try:
            out.append(OPERATORS[kind](**step))
        except TypeError as e:
            raise SpecError(f"operator {i} ({kind}): {e}") from e
    return out


@dataclass(frozen=True)
class PipelineSpec:
    source: dict
    destination: dict
    batch_size: int = 100_000
    mode: str = "incremental"
    transform: tuple[dict, ...] = ()
    sql: str | None = None
    policy: str = "propagate_additive"
    dead_letter_threshold: float | None = 0.01
    schedule: dict = field(default_factory=dict)

    @staticmethod
    def of(spec: dict) -> PipelineSpec:
        known = {k: spec[k] for k in PipelineSpec.__dataclass_fields__ if k in spec}
        out = PipelineSpec(**{**known, "transform": tuple(spec.get("transform") or ())})
        out.check()
        return out

    def check(self) -> None:
        if self.mode not in ("full_refresh", "append", "incremental", "cdc"):
            raise SpecError(f"unknown mode {self.mode!r}")
        if self.mode == "incremental" and not self.source.get("cursor_field"):
            raise SpecError("incremental needs cursor_field")
        if self.mode == "cdc" and not self.source.get("log"):
            raise SpecError("cdc needs a change log")
        if self.batch_size < 1:
            raise SpecError("batch_size must be positive")
        if "interval" in self.schedule and "cron" in self.schedule:
            raise SpecError("interval or cron, not both")
        if self.transform and self.sql:
            raise SpecError("transform or sql, not both")
        operators(list(self.transform))


def apply(store: Store, text: str) -> dict[str, str]:
    """Stores all documents of a text: created, updated or unchanged, by name."""
    out = {}
    for r in documents(text):
        if r.kind == "Pipeline":
            PipelineSpec.of(r.spec)
        key = f"resources/{r.kind}/{r.name}"
        held = store.get(key)
        out[f"{r.kind}/{r.name}"] = "created" if held is None else "unchanged" if held == r.spec else "updated"
        if held != r.spec:
            store.put(key, r.spec)
    return out


def changed(store: Store, text: str) -> dict[str, list[str]]:
    """Which top-level keys differ from what is stored, by name."""
    out = {}
    for r in documents(text):
        held = store.get(f"resources/{r.kind}/{r.name}") or {}
        out[f"{r.kind}/{r.name}"] = sorted(k for k in held.keys() | r.spec.keys() if held.get(k) != r.spec.get(k))
    return out


def get(store: Store, kind: str, name: str) -> Any:
    held = store.get(f"resources/{kind}/{name}")
    if held is None:
        raise SpecError(f"no {kind} {name!r}")
    return held
