"""What a Python worker keeps from task to task: the store of one operator at a time.

Workers are reused by whichever operator runs next, so a store is dropped, and its memory handed back, when
another operator or another key asks for one.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

_HELD: list = [None, None]  # key and store


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """The store under ``key``; any other one is dropped before it is made."""
    if _HELD[0] != key:
        drop()
        _HELD[:] = [key, make()]
    return _HELD[1]


def drop() -> None:
    """Free what is held and let the allocator return its pages."""
    if _HELD[0] is not None:
        _HELD[:] = [None, None]
        gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batch, rows: int = 500):
    """A record batch in parts, so that few of its values are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
