"""Typed configuration with defaults, from a JSON document (or YAML where its library is installed)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

#: Settings that change where or how fast a build runs, not what it makes.
NOT_CONTENT = ("output_dir", "cache_dir", "workers")


@dataclass(frozen=True)
class Config:
    seed: int = 1234
    geometry_limit: int = 500
    row_limit: int | None = None
    near_miss_mm: float = 1.0
    required_clearance_mm: float = 1.0
    eval_fraction: float = 0.1
    targets: dict = field(default_factory=lambda: {"intersecting": 0.4, "disjoint": 0.3, "touching": 0.15, "near_miss": 0.15})
    output_dir: str = "out"
    cache_dir: str = "cache"
    workers: int = 2

    def digest(self) -> str:
        """Hash of what the build makes; folders, caches and workers don't count."""
        content = {k: v for k, v in asdict(self).items() if k not in NOT_CONTENT}
        return "sha256:" + hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()


def parse(text: str) -> Config:
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    known = {f.name for f in fields(Config)}
    if extra := sorted(set(found or {}) - known):
        raise ValueError(f"unknown settings: {', '.join(extra)}")
    return Config(**(found or {}))
