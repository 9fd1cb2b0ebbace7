"""One BLAS thread in a worker that shares its machine with others.

A thread pool is sized when its library is loaded, which a forked worker can't undo by its environment, so loaded
libraries are told by their own call as well.
"""

from __future__ import annotations

import ctypes
import os

#: Environment variables and calls that set the threads of linear-algebra libraries; fixed values.
VARIABLES = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")
CALLS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads", "MKL_Set_Num_Threads")


def one_blas_thread() -> list[str]:
    """Returns the libraries that were told; those loaded later read the environment."""
    os.environ.update(dict.fromkeys(VARIABLES, "1"))
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "blas" in line or "mkl_rt" in line}
    except OSError:  # not Linux
        return []
    told = []
    for path in sorted(p for p in paths if p.startswith("/")):
        lib = ctypes.CDLL(path)
        for call in CALLS:
            if hasattr(lib, call):
                getattr(lib, call)(1)
                told.append(path)
                break
    return told
