"""A bound on what a Python worker is handed at once."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: texts in one Arrow batch: at 64 KB a text, 64 MB
TEXTS = 1000


def small_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """Hold the session's Arrow batches to ``rows`` rows; a smaller setting stays. The default of 10,000 long texts does
    not fit in a worker, and results do not depend on it."""
    now = int(spark.conf.get(_ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(_ROWS, str(rows))


def give_back() -> None:
    """At the end of a task: return what it freed to the system, as the worker process lives on through other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
