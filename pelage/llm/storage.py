"""Written steps between shuffles."""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame

from pelage.session import materialize

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows that go to a Python worker at once; texts make them large.
BATCH_ROWS = 2_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, in small batches; the shuffle files behind the write go with it.

    Spark otherwise keeps the files of finished shuffles until the driver's
    JVM happens to collect their handles.
    """
    spark = df.sparkSession
    settings = {_CLEANUP: "true", _BATCH: str(min(BATCH_ROWS, int(spark.conf.get(_BATCH, "10000"))))}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        return materialize(df, name)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def small_batches(spark) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows, for results that are used outside ``stored``."""
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(spark.conf.get(_BATCH, "10000")))))


def give_back() -> None:
    """Returns freed memory of this Python process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(task):
    """A task function that gives its memory back to the system when it ends; an idle Python worker keeps it otherwise."""
    @wraps(task)
    def run(*args, **kwargs):
        try:
            yield from task(*args, **kwargs)
        finally:
            give_back()

    return run
