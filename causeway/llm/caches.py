"""Python workers live on from stage to stage: only the running stage's caches may hold memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from functools import cache

import pyarrow as pa

_clear: dict[str, Callable[[], None]] = {}
_now = [""]


def register(name: str, clear: Callable[[], None]) -> None:
    _clear[name] = clear


@cache
def _settle() -> None:
    """Large arrays get pages of their own, which go back to the machine when they are freed."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # not this C library
        pass


def trim() -> None:
    """Gives memory that is free in the process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def use(name: str) -> None:
    """Empties all caches but that of ``name``."""
    _settle()
    if _now[0] == name:
        return
    _now[0] = name
    for k, clear in list(_clear.items()):
        if k != name:
            clear()
    trim()
