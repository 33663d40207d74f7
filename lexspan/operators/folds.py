"""Folds in Python over the rows of a group, for many small groups: a task takes its groups from sorted batches, not one call each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(df: DataFrame, keys: list[str], fold: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """What ``fold`` makes of the rows of each group of ``keys``, in no given order; null keys are a group. One group's rows are held at a time."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        of: tuple | None = None
        for b in batches:
            out: list[dict] = []
            for r in b.to_pylist():
                key = tuple(r[k] for k in keys)
                if group and key != of:
                    out += fold(group)
                    group = []
                of = key
                group.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if group:
            yield pa.RecordBatch.from_pylist(fold(group), schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def picked(df: DataFrame, key: str, order: list[str], pick: Callable[[pa.Table], list[int]]) -> DataFrame:
    """Of each group of ``key`` the rows whose places ``pick`` gives, of the group in the order of ``order``, nulls last. One group's rows are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # of the group that the next batch may go on with

        def chosen() -> list[pa.RecordBatch]:
            group = pa.Table.from_batches(open_)
            open_.clear()
            return group.take(pick(group)).to_batches()

        of = None
        for b in batches:
            keys = b.column(key).to_pylist()
            if not keys:
                continue
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            if open_ and keys[0] != of:
                yield from chosen()
            if ends:
                open_.append(b.slice(0, ends[0]))
                yield from chosen()
                whole = pa.Table.from_batches([b])
                places = [i + j for i, k in zip(ends, ends[1:], strict=False) for j in pick(whole.slice(i, k - i))]
                if places:
                    yield from whole.take(places).to_batches()
            open_.append(b.slice(ends[-1] if ends else 0))
            of = keys[-1]
        if open_:
            yield from chosen()

    return df.repartition(key).sortWithinPartitions(key, *[F.col(f"`{c}`").asc_nulls_last() for c in order]).mapInArrow(run, df.schema)
