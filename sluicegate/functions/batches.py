"""Batches of rows that go to Python workers: small, and what they took is given back."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch: a batch of long texts stands in memory on both sides, in several forms.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes: they are read when a plan runs, which is after an operator returns."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def give_back() -> None:
    """Return this process's freed memory to the system: workers outlive tasks, and idle ones wait beside busy ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def tidy(run):
    """``run``, a function over batches, followed by ``give_back``."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
