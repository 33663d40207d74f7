"""Vectors as whole numbers: which rows count, and their components scaled and rounded down, exact in 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole components stay below this, so that squares of differences add up within 64 bits over 64 components.
LIMIT = 1 << 27
#: Rows that are worked on at a time.
BLOCK_ROWS = 8192


def whole(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has exactly ``dim`` components, none of them null, NaN or infinite."""
    v = F.col(f"`{vector}`")
    return df.filter((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def scaled(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """A row of ``dim`` whole numbers floor(scale * x) for each vector; a component beyond LIMIT is an error, as sums wouldn't be exact."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component times {scale} is beyond {LIMIT}")
    return x.astype(np.int64).reshape(-1, dim)


def merged(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``: vectors are short, and work on few at a time is mostly overhead."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each of ``c``; exact: by a product of matrices where doubles hold every sum."""
    if not len(x):
        return np.zeros((0, len(c)), np.int64)
    most = int(max(np.abs(x).max(), np.abs(c).max()))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], axis=1)
