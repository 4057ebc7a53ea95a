"""Shared helpers: tables kept in the cluster's shared folder, and joins on null-safe keys."""

from __future__ import annotations

import ctypes
import sys
import time
import types
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.session import shared_dir, shuffles_released

#: The white space that separates words; every other character belongs to a word.
WHITE = " \t\n\x0b\x0c\r"
#: Seconds after which a process gives up what `once` holds and no task has asked for.
HELD_S = 20

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the shared folder and read from there, so that a lost executor loses nothing.

    The shuffle files of the write go with its end.
    """
    path = shared_dir(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; extra ones may be called anything."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def crc_of(column: Column) -> Column:
    """crc32 of a value written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def once(key: Hashable, make: Callable[[], object]) -> object:
    """`make()`, called once per Python process.

    The package's functions reach the executors by value, so its modules' own variables last one task only.
    Spark keeps Python workers for many tasks; what is costly to make or to learn is held by the process.
    """
    kept = _held()
    value = kept[key][0] if key in kept else make()
    kept[key] = value, time.monotonic()
    return value


def _held() -> dict[Hashable, tuple[object, float]]:
    """By key: what `once` holds, and when it was last asked for."""
    holder = sys.modules.setdefault("_wardline_once", types.ModuleType("_wardline_once"))
    return holder.__dict__.setdefault("kept", {})


def _give_back() -> None:
    """Memory that nothing uses goes back to the system; Arrow and the C library would keep it for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not the GNU library.
        pass


def lean(work: Work) -> Work:
    """`work` for a Python worker that other tasks use before and after.

    What earlier tasks made by `once` and no task has asked for in HELD_S is given up first, and the memory that
    `work` has left free is given back at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, now = _held(), time.monotonic()
        old = [k for k, (_, used) in kept.items() if now - used > HELD_S]
        for k in old:
            del kept[k]
        if old:
            _give_back()
        yield from work(batches)
        for k, (value, used) in kept.items():
            if used >= now:
                kept[k] = value, time.monotonic()
        _give_back()

    return run


def rows_of(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A frame of a few rows that stand in the plan; made from Python's rows, it would start Python workers to read them."""
    columns = list(zip(*rows)) or [[] for _ in schema]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
