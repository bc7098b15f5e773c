"""SQL as text: identifiers, literals, rendering of binds, and what models' answers hold."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterable, Mapping

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
FENCE = re.compile(r"```[ \t]*(\w*)[ \t]*\r?\n?(.*?)```", re.DOTALL)
TAG = re.compile(r"<structured_json>(.*?)</structured_json>", re.DOTALL | re.IGNORECASE)


def identifier(name: str, what: str = "name") -> str:
    """The trimmed name if it is a plain identifier, else ValueError."""
    text = str(name or "").strip()
    if not IDENTIFIER.fullmatch(text):
        raise ValueError(f"{what} is not an identifier: {text!r}")
    return text


def quoted(name: str, mark: str = "`") -> str:
    return mark + name.replace(mark, mark * 2) + mark


def qualified(table: str, schema: str | None = None) -> str:
    """A quoted table name, with its schema if given; both must be identifiers."""
    parts = [identifier(schema, "schema")] if schema else []
    return ".".join(map(quoted, [*parts, identifier(table, "table")]))


def literal(value: object) -> str:
    """A value as a SQL literal."""
    match value:
        case None:
            return "NULL"
        case bool():
            return "TRUE" if value else "FALSE"
        case int() | float():
            return str(value)
        case dt.datetime() | dt.date() | dt.time():
            return f"'{value.isoformat()}'"
        case str():
            return "'" + value.replace("'", "''") + "'"
        case list() | tuple() | set() | frozenset():
            return "(" + ", ".join(map(literal, value)) + ")"
        case _:
            return literal(str(value))


def render(sql: str, params: Mapping[str, object] | None) -> str:
    """sql with its :name binds as literals, NULL for a missing one; casts (::) and quoted text stay.

    Without params the text is returned as it is.
    """
    if not params:
        return sql
    parts = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|(?<!:):([A-Za-z_]\w*)")
    return parts.sub(lambda m: literal(params.get(m[1])) if m[1] else m[0], sql)


def looks_like_sql(text: str) -> bool:
    return bool(re.match(r"\s*(?:with|select)\b", text or "", re.IGNORECASE))


def sql_of(text: str) -> str:
    """The body of the first fence of an answer, or all of it."""
    m = FENCE.search(text or "")
    return (m[2] if m else text or "").strip()


def summary_of(text: str, most: int = 1200) -> str:
    """An answer without fences and tagged parts, at most one blank line in a row, cut at most characters."""
    out = re.sub(r"\n{3,}", "\n\n", TAG.sub("", FENCE.sub("", text or ""))).strip()
    return out if len(out) <= most else out[:most] + "..."


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def first_json(text: str) -> dict | None:
    """The JSON object of an answer: all of it, else its last fence that is one, else its last tagged part, else the first
    object that can be decoded anywhere."""
    text = (text or "").strip()
    fences = [m[2] for m in FENCE.finditer(text) if m[1].lower() in ("", "json")]
    for candidate in [text, *reversed(fences), *TAG.findall(text)[-1:]]:
        if (found := _object(candidate)) is not None:
            return found
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return found
    return None


def unique(values: Iterable[object]) -> list[str]:
    """Trimmed values without blanks; of values equal but for case the first stays."""
    out: dict[str, str] = {}
    for value in values:
        text = str(value or "").strip()
        if text:
            out.setdefault(text.lower(), text)
    return list(out.values())
