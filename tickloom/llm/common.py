"""Helpers that the training-data operators share: Python workers, words and table access."""

from __future__ import annotations

import ctypes
import gc
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.scratch import clear_scratch, cut, drop, scratch_root  # noqa: F401
from tickloom.workers import ship

#: Code points that separate words: the space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

T = TypeVar("T")


#: What one Arrow batch of texts may hold, in rows and bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Seconds after which a Python worker that does nothing forgets what it held.
IDLE_SECONDS = 5.0


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound what one Arrow batch of long texts may hold in a Python worker. The two Arrow
    settings stay in the session, as plans read them only when they run."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_held: dict[str, object] = {}
_used = [0.0]
_lock = threading.Lock()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def _watch() -> None:
    while True:
        time.sleep(IDLE_SECONDS / 2)
        with _lock:
            idle = _held and time.monotonic() - _used[0] > IDLE_SECONDS
            if idle:
                _held.clear()
        if idle:
            trim()


def held(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one thing at a time, as stages of different operators
    share the workers and their memory, and nothing once the worker has been idle for a while."""
    with _lock:
        _used[0] = time.monotonic()
        if name in _held:
            return _held[name]
        _held.clear()
        if not any(t.name == "tickloom-idle" for t in threading.enumerate()):
            threading.Thread(target=_watch, name="tickloom-idle", daemon=True).start()
    trim()
    made = make()
    with _lock:
        _held[name] = made
    return made


def batches_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows; marks the worker as busy at each, and returns freed memory at the end."""
    for b in batches:
        _used[0] = time.monotonic()
        if b.num_rows:
            yield b
    trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under their role's name; any other column, clashing or not, is left out."""
    return df.select(*[df[f"`{c}`"].alias(role) for role, c in columns.items()])


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, -(-rows // per_partition))


def word_count(text):
    """Number of words of a string column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
