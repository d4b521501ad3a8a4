"""One core for a task: numpy's matrix library starts a thread for each core it sees, and they wait for each other busily."""

from __future__ import annotations

import ctypes
from functools import cache

# Names under which builds of the matrix library export the setter.
_SETTERS = ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_")


@cache
def one_thread() -> bool:
    """Keep this process's matrix products to one thread; whether a library was found that can be told so. Call inside a task."""
    import numpy  # noqa: F401  loads the library

    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return False
    found = False
    for path in paths:
        library = ctypes.CDLL(path)
        for name in _SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)
                found = True
    return found
