"""Values that a Python worker keeps over its tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _home() -> types.ModuleType:
    return sys.modules.setdefault("_scholargraph_worker", types.ModuleType("_scholargraph_worker"))


def let_go(but: str = "") -> None:
    """Lets go what operators other than `but` (a module) have kept: workers outlive the steps of a pipeline, and one that
    begins with another operator's tables in memory may not have room for its own."""
    home = _home()
    if getattr(home, "owner", but) != but:
        vars(home).clear()
        release()
    home.owner = but


def kept(name: str, version: str, make: Callable[[], Any]) -> Any:
    """The value under `name`, made once a worker for each `version`; the value of an earlier version is let go, and so
    are those of other operators."""
    let_go(make.__module__)
    home = _home()
    got = getattr(home, name, None)
    if got is None or got[0] != version:
        setattr(home, name, None)
        got = (version, make())
        setattr(home, name, got)
    return got[1]


def release() -> None:
    """Gives freed memory back to the system. A worker that waits for its next task would keep what arrays of the last one
    took, beside a heap that needs the room; where the C library cannot do it, nothing happens."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends at most `rows` rows to a worker at once. The executor holds the batch that it sends, and the
    buffers that this has outgrown, beside its heap; for rows that are whole texts the usual 10,000 are far too many."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)
