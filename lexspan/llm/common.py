"""Small helpers shared by the operators: table access, staged tables, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.staging import discard, shared_dir, staged

__all__ = ["ARROW_BYTES", "ARROW_ROWS", "discard", "lower_ascii", "partitions", "release", "retained", "scoped", "shared_dir", "small", "staged", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows that a task turns into Python objects at a time. Texts are whole, so a batch stays small even where texts are long.
ARROW_ROWS = 400
ARROW_BYTES = 4 << 20


_scoped: dict[int, SparkSession] = {}
_retained: list[dict] = []


def retained() -> dict:
    """A dictionary of large tables that a Python worker keeps from task to task, until ``release``."""
    _retained.append({})
    return _retained[-1]


def release() -> None:
    """Drop what other operators have kept in this Python worker: the stages of a pipeline share workers, and their tables would add up."""
    if any(_retained):
        for x in _retained:
            x.clear()
        gc.collect()


def scoped(spark: SparkSession) -> SparkSession:
    """A session of the same application with the settings of ``spark``, but for small Arrow batches: the caller's session stays as it is."""
    own = _scoped.get(id(spark))
    if own is None or own.sparkContext is not spark.sparkContext:
        own = _scoped[id(spark)] = spark.newSession()
    small_ones = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}
    for key, value in {**spark.conf.getAll, **small_ones}.items():
        if own.conf.get(key, None) != value and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name, in a session of its own settings; only Spark's reader touches the path."""
    return scoped(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes, one row at least; slices copy nothing.

    Spark's own limits belong to the session; this one holds within one function, whatever they are.
    """
    for b in batches:
        n = max(1, min(rows, size * max(b.num_rows, 1) // max(b.nbytes, 1)))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
