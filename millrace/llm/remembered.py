"""What a Python worker remembers between tasks: of one operator at a time.

Spark keeps workers for all later stages, so what each operator of a pipeline left
behind would add up in every worker of an executor.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_HELD: dict[Any, Any] = {}


def remembered(owner: Any, make: Callable[[], Any]) -> Any:
    """What ``owner`` remembers, made anew if the worker did another's work meanwhile."""
    if owner not in _HELD:
        forget()
        _HELD[owner] = make()
    return _HELD[owner]


def forget() -> None:
    """Give back what is remembered, to the system too, for an operator that remembers nothing."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        # Of the C library of Linux only; elsewhere freed memory goes back as its library likes.
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
