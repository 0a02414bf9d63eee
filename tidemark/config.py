"""Settings of a run: defaults, then a JSON file, then the environment, then the command line."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from datetime import UTC, date, datetime
from typing import Any

PREFIX = "TIDEMARK_"


@dataclass(frozen=True)
class Config:
    data_dir: str = "."
    out_dir: str = "out"
    min_train: int = 312
    embargo: int = 53
    horizon: int = 52
    band: float = 7.0
    every: int = 1


def as_of(text: str) -> date:
    """An ISO day, or `auto` for today (UTC)."""
    return datetime.now(UTC).date() if text == "auto" else date.fromisoformat(text)


def weeks(text: str) -> int:
    """`312w` -> 312."""
    if not text.endswith("w") or not text[:-1].isdigit():
        raise ValueError(f"not a number of weeks: {text}")
    return int(text[:-1])


def load(path: str | None = None, given: dict[str, Any] | None = None, env: dict[str, str] | None = None) -> Config:
    kinds = {f.name: type(f.default) for f in fields(Config)}
    out = Config()
    layers: list[dict[str, Any]] = []
    if path:
        with open(path) as f:
            layers.append(json.load(f))
    env = dict(os.environ) if env is None else env
    layers.append({k: env[PREFIX + k.upper()] for k in kinds if PREFIX + k.upper() in env})
    layers.append({k: v for k, v in (given or {}).items() if v is not None})
    for layer in layers:
        if unknown := set(layer) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out = replace(out, **{k: kinds[k](v) for k, v in layer.items()})
    return out
