"""What an operator remembers in a Python worker between its tasks.

A worker serves the operators of a session one after the other, and what each of them
remembers (hashes of words, scores, a tokenizer) lives as long as the worker. It holds
one operator's memory at a time, so those of a pipeline's stages do not add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")

_held: dict[Hashable, object] = {}


def remembered(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gave for ``key``; made again when another key was asked for since."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Return freed memory to the system, as far as the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
