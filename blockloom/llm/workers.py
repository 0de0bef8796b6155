"""What a Python worker keeps from task to task: one thing at a time.

Spark uses workers again for later stages. A cache that a stage has filled
would stay beside that of the next, so whoever comes next drops it and gives
the memory back.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

_held: tuple[Any, Any] = (None, None)


def _give_back() -> None:
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trim() -> None:
    """Gives back what a finished task has freed; a worker waits beside the executor's next stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _give_back()


def keep(owner: Any, make: Callable[[], Any]) -> Any:
    """The owner's cache, made on its first task in this worker; any other one is dropped."""
    global _held
    if _held[0] != owner:
        _held = (None, None)
        _give_back()
        _held = (owner, make())
    return _held[1]


def clear() -> None:
    """Drops what another stage has left."""
    global _held
    if _held[0] is not None:
        _held = (None, None)
        _give_back()
