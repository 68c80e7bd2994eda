"""Gaussian-process analytics on Spark DataFrames."""

import os

# Spark's tasks share the cores; a linear-algebra library that starts a thread per core in each of them only waits.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")


def one_blas_thread() -> None:
    """For a NumPy that was imported before: its threads don't outlive the start of Spark's JVM, and calls wait for them."""
    import ctypes

    try:
        with open("/proc/self/maps") as f:
            libraries = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in libraries:
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def attach(spark):
    """Lets the session's Python workers find this package where it lies; on a cluster ship it with --py-files instead."""
    one_blas_thread()
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark
