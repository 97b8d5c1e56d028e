"""Settings from the environment: TABLEWRIGHT_ROOT, _HOST, _PORT, _CACHE_SECONDS, _SWEEP_SECONDS, _SAMPLE_ROWS."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from tablewright.operators.sampling import SAMPLE_ROWS
from tablewright.plans.cache import TTL_SECONDS


@dataclass(frozen=True)
class Settings:
    root: str = "data/datasets"
    host: str = "127.0.0.1"
    port: int = 8080
    cache_seconds: int = TTL_SECONDS
    sweep_seconds: int = 300
    sample_rows: int = SAMPLE_ROWS

    @classmethod
    def of(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        """Defaults, but for what the environment names."""
        given = {}
        for f in fields(cls):
            if (value := environment.get(f"TABLEWRIGHT_{f.name.upper()}")) is not None:
                given[f.name] = type(f.default)(value)
        return cls(**given)
