"""Positions in change logs: log sequence numbers and sets of transaction ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def lsn(text: str) -> int:
    high, _, low = text.partition("/")
    return (int(high, 16) << 32) + int(low, 16)


def lsn_text(value: int) -> str:
    return f"{value >> 32:X}/{value & 0xFFFFFFFF:X}"


def lsn_number(text: Column) -> Column:
    """A log position's text as a number: texts don't sort."""
    part = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return (part(1) * F.lit(2**32).cast("decimal(20,0)") + part(2)).cast("decimal(20,0)")


@dataclass(frozen=True)
class GtidSet:
    """Closed, merged intervals of transaction numbers by server."""

    intervals: tuple[tuple[str, tuple[tuple[int, int], ...]], ...] = ()

    @staticmethod
    def parse(text: str) -> GtidSet:
        found: dict[str, list[tuple[int, int]]] = {}
        for part in filter(None, (p.strip() for p in text.replace("\n", "").split(","))):
            server, *ranges = part.split(":")
            if not ranges:
                raise ValueError(f"no interval in {part!r}")
            for r in ranges:
                low, _, high = r.partition("-")
                a, b = int(low), int(high or low)
                if b < a or a < 1:
                    raise ValueError(f"bad interval {r!r}")
                found.setdefault(server.lower(), []).append((a, b))
        return GtidSet._of(found)

    @staticmethod
    def _of(found: dict[str, list[tuple[int, int]]]) -> GtidSet:
        out = []
        for server, ranges in sorted(found.items()):
            merged: list[tuple[int, int]] = []
            for a, b in sorted(ranges):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1] = merged[-1][0], max(b, merged[-1][1])
                else:
                    merged.append((a, b))
            out.append((server, tuple(merged)))
        return GtidSet(tuple(out))

    def union(self, other: GtidSet) -> GtidSet:
        found: dict[str, list[tuple[int, int]]] = {}
        for server, ranges in (*self.intervals, *other.intervals):
            found.setdefault(server, []).extend(ranges)
        return GtidSet._of(found)

    def add(self, server: str, number: int) -> GtidSet:
        return self.union(GtidSet(((server.lower(), ((number, number),)),)))

    def __contains__(self, item: tuple[str, int]) -> bool:
        return any(s == item[0].lower() and any(a <= item[1] <= b for a, b in ranges) for s, ranges in self.intervals)

    def count(self) -> int:
        return sum(b - a + 1 for _, ranges in self.intervals for a, b in ranges)

    def __str__(self) -> str:
        return ",".join(":".join([s, *(f"{a}-{b}" if b > a else str(a) for a, b in r)]) for s, r in self.intervals)
