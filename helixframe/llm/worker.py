"""Memory of Python workers: one serves many tasks of many operators, so none may leave much behind."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows that Spark sends a worker at once.
BATCH_BYTES = 4 << 20
#: glibc's numbers of the two settings, and the size from which arrays go back to the system when they are freed.
MMAP_THRESHOLD, TRIM_THRESHOLD, MMAP_BYTES = -3, -1, 2 << 20

_libc: ctypes.CDLL | None = None
_kept: dict[str, dict] = {}


def left_by(module: str) -> dict:
    """What a module's tasks leave for its next ones; it is empty again once a task of another module has run here."""
    return _kept.setdefault(module, {})


def _forget(module: str) -> None:
    for own, held in _kept.items():
        if own != module:
            held.clear()


def _settle() -> None:
    global _libc
    if _libc is None:
        _libc = ctypes.CDLL(None)
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(_libc, "mallopt"):
            _libc.mallopt(MMAP_THRESHOLD, MMAP_BYTES)
            _libc.mallopt(TRIM_THRESHOLD, MMAP_BYTES)


def _trim() -> None:
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def released(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` over the batches of a task; what it freed goes back to the system at the task's end."""
    module = run.__module__

    @functools.wraps(run)
    def wrapped(batches: Iterable) -> Iterator:
        # Functions of this module alone: Spark sends ``wrapped`` with what it names, and a library can't be sent.
        _settle()
        _forget(module)
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def bound_batches(spark: SparkSession) -> None:
    """Rows go to workers BATCH_BYTES at a time, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if size > BATCH_BYTES or size <= 0:
        spark.conf.set(key, str(BATCH_BYTES))
