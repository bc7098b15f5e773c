"""Settings by dotted path, from nested dicts or JSON text."""

from __future__ import annotations

import json
from collections.abc import Mapping


def load(text: str) -> dict:
    """Settings of JSON text; YAML too where its library is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and no YAML library is installed") from e
        return yaml.safe_load(text) or {}


def get(settings: Mapping, path: str, default: object = None) -> object:
    for key in path.split("."):
        if not isinstance(settings, Mapping) or key not in settings:
            return default
        settings = settings[key]
    return settings


def required(settings: Mapping, paths: list[str]) -> None:
    if missing := [p for p in paths if get(settings, p) in (None, "")]:
        raise ValueError(f"missing settings: {', '.join(missing)}")
