"""A least-recently-used cache with a time to live, on the driver."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable


def key(query: str, **what) -> str:
    """A digest that ignores case and outer space of the query and the order of lists and names."""
    level = {k: sorted(v) if isinstance(v, (list, tuple, set)) else v for k, v in what.items() if v is not None}
    return hashlib.md5(json.dumps([query.strip().lower(), level], sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()


class Cache:
    """Of at most ``size`` entries, each for ``ttl`` seconds (None: for ever)."""

    def __init__(self, size: int = 1000, ttl: float | None = 3600, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[str, tuple[object, float]] = OrderedDict()
        self.reset_stats()

    def reset_stats(self) -> None:
        self.hits = self.misses = self.evictions = self.expired = 0

    def get(self, k: str):
        """The value, or None; an entry past its time counts as a miss."""
        found = self.entries.get(k)
        if found is not None and self.ttl is not None and self.clock() - found[1] > self.ttl:
            del self.entries[k]
            self.expired += 1
            found = None
        if found is None:
            self.misses += 1
            return None
        self.entries.move_to_end(k)
        self.hits += 1
        return found[0]

    def put(self, k: str, value) -> None:
        if k not in self.entries and len(self.entries) >= self.size:
            self.entries.popitem(last=False)
            self.evictions += 1
        self.entries[k] = (value, self.clock())
        self.entries.move_to_end(k)

    def clear(self) -> None:
        self.entries.clear()

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self.entries), "max_size": self.size, "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "expired": self.expired, "hit_rate": self.hits / asked if asked else 0.0}
