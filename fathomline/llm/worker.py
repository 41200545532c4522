"""What the Arrow functions of this package share: slices of bounded size, and state kept from task to task."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that a function turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str | int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes in a text column, one row at least; empty batches give none.

    Spark's batches are bounded by rows or tens of MB; Python objects made of a whole one can take many times that.
    """
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def bounded_batches(spark: SparkSession) -> None:
    """Ask Spark for Arrow batches of SLICE_BYTES where the session allows larger ones. The setting stays with the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > SLICE_BYTES:
        spark.conf.set(name, str(SLICE_BYTES))


def worker_cache(owner: str) -> dict:
    """A dictionary of this process. Functions come to workers by value, so module globals do not last.

    One operator owns it at a time; the next one starts with an empty dictionary, so state does not pile up. Every
    operator's function calls this first, also one that keeps nothing, which frees what its predecessor held.
    """
    held = sys.modules.setdefault("_fathomline_worker", types.ModuleType("_fathomline_worker")).__dict__
    if held.get("owner") != owner:
        held.clear()
        held["owner"] = owner
        gc.collect()
    give_back()  # what the task before has left
    return held


def give_back() -> None:
    """Return freed memory to the system, as allocators keep it else: a worker serves one operator after another, a driver one fit after another."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
