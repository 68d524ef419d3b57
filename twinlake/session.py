"""Session settings that operators rely on."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound the bytes of the batches that Python workers get, unless the session's user has set a bound: the
    default of 64 MB a batch, held several times in each worker and its JVM, is most of a small executor."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, most)


def give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)
