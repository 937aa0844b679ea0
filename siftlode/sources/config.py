"""Configuration: a YAML file, overrides by dotted path, and keys of cached artifacts."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Iterable
from typing import Any

try:
    import yaml
except ImportError:  # JSON is YAML too
    yaml = None


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return yaml.safe_load(text) if yaml else json.loads(text)


def apply_overrides(config: dict, overrides: Iterable[str]) -> dict:
    """A copy of ``config`` with each "a.b.0.c=value" set; a number is a place in a list, values are YAML, and missing
    tables on the way are made."""
    out = copy.deepcopy(config)
    for item in overrides:
        path, sep, raw = item.partition("=")
        if not sep:
            raise ValueError(f"not path=value: {item}")
        *way, last = path.split(".")
        at: Any = out
        for step in way:
            at = at[int(step)] if isinstance(at, list) else at.setdefault(step, {})
        value = (yaml.safe_load if yaml else json.loads)(raw)
        if isinstance(at, list):
            at[int(last)] = value
        else:
            at[last] = value
    return out


def config_key(config: Any, length: int = 10) -> str:
    """Name of an artifact made under ``config``: the first digits of a hash of its canonical JSON."""
    canonical = json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha1(canonical.encode()).hexdigest()[:length]
