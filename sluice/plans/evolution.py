"""Schema fingerprints, differences, policies and versions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blake3 import digests
from ..functions.types import widens
from .state import Store


def fingerprint(schema: T.StructType) -> str:
    """A hash of names, types, nullability and metadata; the order of fields doesn't count."""
    lines = []
    for f in sorted(schema, key=lambda f: f.name):
        meta = json.dumps(f.metadata or {}, sort_keys=True)
        lines.append(f"{f.name}\0{f.dataType.simpleString()}\0{int(f.nullable)}\0{meta}\0")
    return digests(["".join(lines).encode()])[0]


@dataclass(frozen=True, order=True)
class Change:
    """``kind``: add_column, drop_column, widen, narrow, make_nullable, make_required, reorder, rename."""

    kind: str
    column: str = ""
    old: str = ""
    new: str = ""
    nullable: bool = True

    @property
    def additive(self) -> bool:
        return self.kind in ("make_nullable", "widen", "reorder") or self.kind == "add_column" and self.nullable


def diff(old: T.StructType, new: T.StructType) -> list[Change]:
    """All changes, sorted."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    out = [Change("add_column", n, "", b[n].dataType.simpleString(), b[n].nullable) for n in b.keys() - a.keys()]
    out += [Change("drop_column", n, a[n].dataType.simpleString()) for n in a.keys() - b.keys()]
    for n in a.keys() & b.keys():
        x, y = a[n], b[n]
        if x.dataType != y.dataType:
            out.append(Change("widen" if widens(x.dataType, y.dataType) else "narrow", n, x.dataType.simpleString(), y.dataType.simpleString()))
        if x.nullable != y.nullable:
            out.append(Change("make_nullable" if y.nullable else "make_required", n))
    if [f.name for f in old if f.name in b] != [f.name for f in new if f.name in a]:
        out.append(Change("reorder"))
    return sorted(out)


def likely_renames(changes: list[Change]) -> list[tuple[str, str]]:
    """Pairs of a dropped and an added column of one type, where there is just one of each."""
    gone = [c for c in changes if c.kind == "drop_column"]
    come = [c for c in changes if c.kind == "add_column"]
    return [(g.column, c.column) for g in gone for c in come if g.old == c.new and sum(x.old == g.old for x in gone) == 1 and sum(x.new == c.new for x in come) == 1]


POLICIES = ("propagate_additive", "strict", "freeze", "propagate_all")


@dataclass(frozen=True)
class Decision:
    """``action``: noop, accept, retain_old or reject; ``refused`` has the changes that caused a rejection."""

    action: str
    refused: tuple[Change, ...] = ()


def decide(changes: list[Change], policy: str = "propagate_additive", overrides: dict[str, str] | None = None) -> Decision:
    """What a policy makes of changes. Overrides by column: ``ignore`` and ``freeze`` leave its changes out,
    ``protect`` refuses them."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    overrides = overrides or {}
    protected = tuple(c for c in changes if overrides.get(c.column) == "protect")
    if protected:
        return Decision("reject", protected)
    changes = [c for c in changes if overrides.get(c.column) not in ("ignore", "freeze")]
    if not changes:
        return Decision("noop")
    if policy == "freeze":
        return Decision("retain_old")
    if policy == "strict":
        return Decision("reject", tuple(changes))
    refused = tuple(c for c in changes if policy == "propagate_additive" and not c.additive)
    return Decision("reject", refused) if refused else Decision("accept")


class SchemaRejected(ValueError):
    def __init__(self, changes: tuple[Change, ...]):
        super().__init__("schema change refused: " + ", ".join(f"{c.kind}({c.column})" for c in changes))
        self.changes = changes


@dataclass
class Version:
    version: int
    fingerprint: str
    schema: dict
    parent: int | None = None
    changes: list[dict] = field(default_factory=list)

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)


class Recorder:
    """Versions of a stream's schema in a store."""

    def __init__(self, store: Store, stream: str):
        self.store, self.key = store, f"schemas/{stream}"

    def versions(self) -> list[Version]:
        return [Version(**v) for v in self.store.get(self.key, [])]

    def resolve(self, live: T.StructType, policy: str = "propagate_additive", overrides: dict[str, str] | None = None) -> Version:
        """The version that rows go by from now on; a new one is stored if the policy accepts the changes."""
        held = self.versions()
        print_ = fingerprint(live)
        if not held:
            new = Version(1, print_, live.jsonValue())
        else:
            last = held[-1]
            if last.fingerprint == print_:
                return last
            changes = diff(last.struct(), live)
            decision = decide(changes, policy, overrides)
            if decision.action == "reject":
                raise SchemaRejected(decision.refused)
            if decision.action in ("retain_old", "noop"):
                return last
            new = Version(last.version + 1, print_, live.jsonValue(), last.version, [asdict(c) for c in changes])
        self.store.put(self.key, [asdict(v) for v in [*held, new]])
        return new


def conform(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in a held schema: its columns and types, null where the live rows lack a column."""
    have = set(frame.columns)
    return frame.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def diverges(held: T.StructType, actual: T.StructType) -> list[Change]:
    """What a destination's schema has besides, or lacks of, the held one; nullability is a file format's own."""
    return [c for c in diff(held, actual) if c.kind not in ("make_nullable", "make_required", "reorder")]
