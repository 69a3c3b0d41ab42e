"""Sizes of the Arrow batches that Python steps get."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = "1000"
BYTES = str(8 << 20)


def small_batches(spark: SparkSession) -> None:
    """Batches of texts of at most a thousand rows or 8 MB, as results can be many times as large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)


def released(f: Callable) -> Callable:
    """``f``, giving back after each call what it no longer needs: idle Python workers stay as small as they began."""

    @functools.wraps(f)
    def run(*given):
        out = f(*given)
        release_memory()
        return out

    return run


def release_memory() -> None:
    """Give memory that this Python worker no longer needs back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
