"""Configuration files: lists of literals and excluded types, found upwards from a folder."""

from __future__ import annotations

import tomllib
from pathlib import Path

from maskwright.functions.entities import by_name
from maskwright.operators.engine import ConfigError

NAME = ".maskwright.toml"
KEYS = ("allow_list", "deny_list", "exclude_entities")


def find(start: str | Path = ".") -> Path | None:
    """The nearest file in the folder or one above it."""
    here = Path(start).resolve()
    return next((d / NAME for d in (here, *here.parents) if (d / NAME).is_file()), None)


def load(path: str | Path | None = None, start: str | Path = ".") -> dict[str, tuple[str, ...]]:
    """The three lists, each that of the top level and then that of [scanner]. Unknown types raise."""
    at = Path(path) if path else find(start)
    if at is None:
        return {k: () for k in KEYS}
    try:
        data = tomllib.loads(at.read_text())
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        raise ConfigError(f"can't read the configuration {at}") from None
    out = {}
    for k in KEYS:
        values = [*data.get(k, []), *data.get("scanner", {}).get(k, [])]
        if not all(isinstance(v, str) for v in values):
            raise ConfigError(f"{k} must be a list of strings")
        out[k] = tuple(values)
    try:
        for name in out["exclude_entities"]:
            by_name(name)
    except ValueError as e:
        raise ConfigError(str(e)) from None
    return out
