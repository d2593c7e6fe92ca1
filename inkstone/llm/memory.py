"""Bounds on what tasks and their Python workers hold."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that Spark sends to a Python worker at a time. Texts are long, so its own default of 10,000 would be tens of MB in
#: the JVM, in Arrow and in Python at once.
BATCH = 1_000
#: Rows that Spark's reader of Parquet decodes at a time. Its own default of 4,096 makes arrays of texts of tens of MB in each
#: task, for which the heap grows and is then kept.
READ_BATCH = 256
_MOST = {"spark.sql.execution.arrow.maxRecordsPerBatch": (BATCH, "10000"), "spark.sql.parquet.columnarReaderBatchSize": (READ_BATCH, "4096")}


def modest_batches(spark: SparkSession) -> None:
    """Sets the session's batch sizes to ``BATCH`` and ``READ_BATCH`` unless they are smaller already. Results do not depend on them."""
    for key, (most, default) in _MOST.items():
        if not 0 < int(spark.conf.get(key, default)) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives memory that is free back to the system: workers are kept for later tasks, of other kinds too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
