"""Memory of Python workers, which Spark keeps between tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_caches: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Return freed memory to the system, as far as the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def holds(name: str, clear: Callable[[], None]) -> None:
    """A worker keeps the cache of one operator at a time: ``clear`` empties it when another one begins."""
    if name not in _caches:
        for other in _caches.values():
            other()
        _caches.clear()
    _caches[name] = clear


def tidy(run, clear: Callable[[], None] | None = None):
    """An Arrow batch function that, at its end, gives back the memory that idle workers would keep; after ``clear``."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if clear is not None:
                clear()
            _give_back()

    return wrapped
