"""What a Python worker does at the end of a task, as Spark keeps idle workers alive."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system, so that idle workers do not hold what their last task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)
