"""Arrow batches that are small both ways, so that a Python worker's memory doesn't depend on how many rows a batch may have."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch on its way to Python, unless the session has a limit of its own, and of one on its way back.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def limited(spark: SparkSession | None) -> None:
    """Batches to Python are small in this session from now on, unless it has a limit of its own."""
    if spark is not None and not spark._jsparkSession.sessionState().conf().contains(_LIMIT):
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def lean(run: Callable) -> Callable:
    """For functions of ``mapInArrow``: results leave in small batches, and as a worker serves one stage after another, what a task freed goes back to the system when it ends."""

    @functools.wraps(run)
    def inner(batches):
        try:
            for out in run(batches):
                rows = max(1, out.num_rows * BATCH_BYTES // max(1, out.nbytes))
                for at in range(0, max(1, out.num_rows), rows):
                    yield out.slice(at, rows)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches both ways."""
    limited(df.sparkSession)
    return df.mapInArrow(lean(run), schema)
