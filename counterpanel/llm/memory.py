"""Memory of Python workers, which outlive the tasks that filled them."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

BATCH_ROWS = 2000  # rows of a text table sent to a Python worker at a time
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def hand_back() -> None:
    """Give free memory back to the system, as far as its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, which hands free memory back when a task ends: idle
    workers of one stage stay beside those of the next."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return task
