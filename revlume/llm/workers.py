"""Memory of Python workers, which Spark keeps from one stage to the next."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow


def give_back() -> None:
    """Return what the worker has freed to the system: a stage's arrays and tables would else stay reserved in the
    stages after it."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def freed(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` over a task's batches, with ``give_back`` at the task's end."""

    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run
