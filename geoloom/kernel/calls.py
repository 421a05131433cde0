"""Plain functions that UDFs call on the executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from .model import from_wkb, to_wkb

BYTES = 16 << 20  # that the results of one function may take
FUNCTIONS = 12  # whose results a worker holds


def read(data):
    return None if data is None else from_wkb(data)


def write(g):
    return None if g is None else to_wkb(g)


def lift(f: Callable) -> Callable:
    """A geometry function as one from geometry to WKB; null stays null."""
    return lambda g, *a: None if g is None else write(f(g, *a))


class Memory(dict):
    """A function's results by its arguments, begun anew when they outgrow ``BYTES``."""

    size = 0

    def keep(self, key, value):
        if self.size > BYTES:
            self.clear()
            self.size = 0
        self[key] = value
        self.size += 250 + sum(len(x) for x in ((*key, value) if isinstance(key, tuple) else (key, value)) if isinstance(x, bytes | str))
        return value


_memories: dict[str, Memory] = {}


def name() -> str:
    """A new name under which workers remember a function's results."""
    return uuid.uuid4().hex


def memory(name: str) -> Memory:
    """What this worker remembers under a name, from batch to batch and task to task."""
    if name not in _memories:
        while len(_memories) >= FUNCTIONS:
            del _memories[next(iter(_memories))]
        _memories[name] = Memory()
    return _memories[name]
