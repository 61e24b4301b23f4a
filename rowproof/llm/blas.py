"""Threads of numpy's matrix products inside tasks."""

from __future__ import annotations

import ctypes
from functools import cache
from pathlib import Path

import numpy as np

# The names under which numpy's builds export the call.
SETTERS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


@cache
def one_thread() -> None:
    """Matrix products of this process use one thread: Spark runs a task per core already, and
    threads that wait for each other on small products burn the other tasks' time. Does nothing
    where numpy brings no OpenBLAS of its own."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)
                return
