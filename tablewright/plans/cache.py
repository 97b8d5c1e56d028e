"""A result cache with an expiry time."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable
from typing import Any

#: Seconds that a result is kept by default.
TTL_SECONDS = 600


def request_key(request: dict, *more: Any) -> str:
    """SHA-256 of a request and whatever else its result depends on, whatever the order of its keys."""
    return hashlib.sha256(json.dumps([request, *more], sort_keys=True, default=str).encode()).hexdigest()


class Cache:
    """``ttl_seconds`` None keeps entries for good. Safe to share between threads."""

    def __init__(self, ttl_seconds: float | None = TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self._ttl, self._clock, self._lock = ttl_seconds, clock, threading.Lock()
        self._held: dict[str, tuple[Any, float]] = {}

    def _alive(self, since: float) -> bool:
        return self._ttl is None or self._clock() - since <= self._ttl

    def get(self, key: str, default: Any = None) -> Any:
        with self._lock:
            if key not in self._held:
                return default
            value, since = self._held[key]
            if self._alive(since):
                return value
            del self._held[key]
            return default

    def set(self, key: str, value: Any) -> None:
        with self._lock:
            self._held[key] = value, self._clock()

    def has(self, key: str) -> bool:
        gone = object()
        return self.get(key, gone) is not gone

    def delete(self, key: str) -> bool:
        with self._lock:
            return self._held.pop(key, None) is not None

    def clear(self) -> None:
        with self._lock:
            self._held.clear()

    def sweep(self) -> int:
        """Drop what has expired; returns how much that was."""
        with self._lock:
            dead = [k for k, (_, since) in self._held.items() if not self._alive(since)]
            for k in dead:
                del self._held[k]
            return len(dead)

    def __len__(self) -> int:
        return len(self._held)
