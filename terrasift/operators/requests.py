"""Bounds of requests, and who is logged in."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from dataclasses import dataclass, field

from .execute import MOST_PAGE

MOST_SQL, MOST_QUESTION = 200_000, 20_000


def text(value: object, name: str, most: int, least: int = 1) -> str:
    out = str(value if value is not None else "").strip()
    if not least <= len(out) <= most:
        raise ValueError(f"{name} has {least} to {most} characters")
    return out


def number(value: object, name: str, least: int, most: int | None = None) -> int:
    out = int(value)
    if out < least or most is not None and out > most:
        raise ValueError(f"{name} is {least} or more" + (f", {most} at most" if most is not None else ""))
    return out


@dataclass
class Question:
    chat_id: int
    query: str
    database_id: int | None = None
    schema_name: str | None = None
    table_list: list[str] = field(default_factory=list)
    view_list: list[str] = field(default_factory=list)
    geometry: str | None = None

    def __post_init__(self):
        self.chat_id, self.query = number(self.chat_id, "chat_id", 1), text(self.query, "query", MOST_QUESTION)
        if (self.database_id is None) != (self.schema_name is None):
            raise ValueError("database_id and schema_name go together")


@dataclass
class Execution:
    sql: str
    page: int = 1
    page_size: int = 20

    def __post_init__(self):
        self.sql = text(self.sql, "sql", MOST_SQL)
        self.page, self.page_size = number(self.page, "page", 1), number(self.page_size, "page_size", 1, MOST_PAGE)


def changes(**values: object) -> dict[str, object]:
    """The values that are given (not None); at least one must be."""
    out = {k: v for k, v in values.items() if v is not None}
    if not out:
        raise ValueError("nothing to change")
    return out


class Sessions:
    """Logged-in users by session id, in the driver's memory; they do not expire."""

    def __init__(self):
        self._held: dict[str, dict] = {}
        self._lock = threading.RLock()

    @staticmethod
    def _now() -> str:
        return dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat()

    def open(self, user: dict, links: list[dict] | None = None) -> str:
        key = str(uuid.uuid4())
        with self._lock:
            self._held[key] = {"user": user, "database_links": links or [], "login_time": self._now(), "last_update_time": self._now()}
        return key

    def get(self, key: str | None) -> dict | None:
        with self._lock:
            return self._held.get(key or "")

    def update(self, key: str, **values: object) -> bool:
        with self._lock:
            if key not in self._held:
                return False
            self._held[key] |= values | {"last_update_time": self._now()}
            return True

    def close(self, key: str) -> bool:
        with self._lock:
            return self._held.pop(key, None) is not None

    def count(self) -> int:
        with self._lock:
            return len(self._held)
