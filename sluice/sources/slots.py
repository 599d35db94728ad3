"""What a change source must be set to, and the slot that holds its log for a reader."""

from __future__ import annotations

from dataclasses import dataclass

from ..plans.state import Store
from .positions import lsn, lsn_text

# Fixed values of the server's settings that a row-based log with global transaction ids needs.
MYSQL_SETTINGS = {"gtid_mode": "ON", "binlog_format": "ROW"}


class PreflightError(ValueError):
    pass


def mysql_preflight(settings: dict[str, str], tables: set[str], table: str) -> list[str]:
    """What is wrong with a server's settings, as ``SHOW GLOBAL VARIABLES`` lists them, or with the table; empty if
    nothing is. Names and values are compared without regard to case, a table's name as it is."""
    held = {k.lower(): v for k, v in settings.items()}
    wrong = [f"{k} is {held.get(k, 'not set')}, {v} is needed" for k, v in MYSQL_SETTINGS.items() if held.get(k, "").upper() != v]
    return wrong if table in tables else [*wrong, f"no table {table}"]


@dataclass
class Slot:
    """A reader's hold on a log: the log is kept from the confirmed position on. Here it is a document in the store; a
    reader of a live server confirms the same position there."""

    store: Store
    name: str

    def _held(self) -> dict:
        held = self.store.get(f"slots/{self.name}")
        if not held:
            raise PreflightError(f"no slot {self.name!r}")
        return held

    def ensure(self, tables: tuple[str, ...], start: str = "0/0") -> str:
        """Makes the slot, or adds tables to what it publishes; the confirmed position."""
        held = self.store.get(f"slots/{self.name}") or {"tables": [], "confirmed": start}
        now = {**held, "tables": sorted({*held["tables"], *tables})}
        if now != self.store.get(f"slots/{self.name}"):
            self.store.put(f"slots/{self.name}", now)
        return now["confirmed"]

    def tables(self) -> list[str]:
        return self._held()["tables"]

    def confirmed(self) -> str:
        return self._held()["confirmed"]

    def advance(self, to: str) -> str:
        """Confirms a position; an earlier one changes nothing."""
        held = self._held()
        if lsn(to) > lsn(held["confirmed"]):
            held["confirmed"] = lsn_text(lsn(to))
            self.store.put(f"slots/{self.name}", held)
        return held["confirmed"]

    def lag(self, head: str) -> int:
        """Bytes of the log between the confirmed position and its head."""
        return max(0, lsn(head) - lsn(self.confirmed()))

    def release(self) -> None:
        """Gives the log free; a slot that is gone already is no error."""
        self.store.put(f"slots/{self.name}", None)
