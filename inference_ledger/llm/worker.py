"""What a Python worker keeps between tasks: one thing at a time.

Workers are used again by later tasks and stages. A tokenizer's dictionary or a language
model is worth keeping for the next task of the same stage, but not while another
operator needs the memory.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_KEPT: dict[tuple, object] = {}


def kept(key: tuple, build: Callable[[], object]):
    """The object of ``key``, built if the worker does not hold it; all others are let go."""
    if key not in _KEPT:
        release()
        _KEPT[key] = build()
    return _KEPT[key]


def release() -> None:
    """Let go of what is kept, and give free memory back to the machine."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # another C library: it keeps its own counsel
        pass
