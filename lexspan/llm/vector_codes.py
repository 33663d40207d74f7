"""Vector code compression: product codes, whose nearest entries are found by partial-distance search.

A vector is cut into equal parts, and each part is replaced by the number of its codebook's nearest
entry. Entries are searched a block at a time. Components are added in the order of their variance over the
codebook, the largest first, for all rows and entries of the block at once; whatever exceeds, strictly,
the best complete distance that its row has so far is dropped by a mask before the next component. Distances are whole
numbers, so equal ones are seen as equal and the lower number wins, as in a full search.

A round of training is one pass over the vectors, without a shuffle of them: each task adds up its parts by entry, and those sums, a
row an entry and task, are aggregated; the driver holds codebooks alone. Rows with a null vector, a null or
non-finite component or another number of components have no code. Repeated rows are vectors each. With
fewer rows than entries there are as many entries as rows; null ids come last among the first rows. A
component of 2**27 or more after scaling is an error, as sums would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import staged
from lexspan.llm.vector_grid import merged, scaled, whole

PARTS, ENTRIES, ROUNDS, SCALE, DIM = 16, 64, 2, 256, 64
#: Entries that are searched before the best distance is looked at again.
BLOCK = 16


class Codebooks(NamedTuple):
    """``entries``: by part and number, the whole components."""

    entries: np.ndarray
    scale: int

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the number of its nearest entry, the lowest of equals; its squared distance; and how many squares were added up."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    by_first = np.argsort(book[:, 0], kind="stable")
    index = by_first[np.minimum(np.searchsorted(book[by_first, 0], x[:, 0]), len(book) - 1)]
    best = ((x - book[index]) ** 2).sum(1)
    squares = x.size
    for at in range(0, len(book), BLOCK):
        block = book[at : at + BLOCK]
        far = (x[:, :1] - block[:, 0]) ** 2
        squares += far.size
        rows, cols = np.nonzero(far <= best[:, None])
        far = far[rows, cols]
        for d in range(1, x.shape[1]):
            far = far + (x[rows, d] - block[cols, d]) ** 2
            squares += len(rows)
            on = far <= best[rows]
            rows, cols, far = rows[on], cols[on], far[on]
        if not len(rows):
            continue
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])  # rows are in order, and in a row its entries
        least = np.minimum.reduceat(far, start)
        hit = np.flatnonzero(far == np.repeat(least, np.diff(np.r_[start, len(rows)])))
        hit = hit[np.r_[True, rows[hit][1:] != rows[hit][:-1]]]
        r, to = rows[hit], cols[hit] + at
        better = (least < best[r]) | (to < index[r])  # what is left is never beyond the best
        index[r[better]], best[r[better]] = to[better], least[better]
    return index, best, squares


def _parts(x: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = books.shape[2]
    return ((x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books))


def train(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM) -> Codebooks | None:
    """Codebooks that start as the parts of the first vectors by id and are moved to their parts' means, rounded down; None without vectors."""
    width = dim // parts
    if dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
    kept = whole(df, vector, dim).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    books = scaled(pa.array([r["v"] for r in first]), dim, scale).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    named = [f"s{i}" for i in range(width)]

    for _ in range(rounds):

        def added(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for b in merged(batches):
                for p, (x, book) in enumerate(_parts(scaled(b.column("v"), dim, scale), books)):
                    index = nearest(x, book)[0]
                    count[p] += np.bincount(index, minlength=len(book))
                    np.add.at(total[p], index, x)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (p, e, count[p, e], *total[p, e].T)], ["part", "entry", "n", *named])

        schema = ", ".join(f"{c} long" for c in ("part", "entry", "n", *named))
        sums = kept.select("v").mapInArrow(added, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in named])
        books = books.copy()
        for r in sums.collect():
            books[r["part"], r["entry"]] = [r[s] // r["n"] for s in named]
    return Codebooks(books, scale)


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """``df`` without its vectors and without the rows that have no code, with the entries' numbers as two hex digits each and the squared distance to what they stand for.

    Columns of ``df`` that have the name of a new one give way to it.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c not in (vector, code, error)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])
    target = to_arrow_schema(schema)
    dim, scale, entries = books.dim, books.scale, books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches):
            found = [nearest(x, book)[:2] for x, book in _parts(scaled(b.column(vector), dim, scale), entries)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            columns = [*[b.column(c) for c in kept], pa.array([r.tobytes().hex() for r in codes]), pa.array(sum(e for _, e in found), pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return whole(df, vector, dim).select(*[F.col(f"`{c}`") for c in (*kept, vector)]).mapInArrow(run, schema)


def decode(df: DataFrame, books: Codebooks, code: str = "code", vector: str = "embedding") -> DataFrame:
    """``df`` with the vectors that its codes stand for, at their first scale: what compression keeps. A null code gives a null vector."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x) / books.scale) for x in e]) for e in book]) for book in books.entries.tolist()])
    number = lambda p: F.conv(F.substring(f"`{code}`", 2 * p + 1, 2), 16, 10).cast("int")
    parts = [entries[p][number(p)] for p in range(len(books.entries))]
    return df.withColumn(vector, F.when(F.col(f"`{code}`").isNotNull(), F.concat(*parts)))


def coded(df: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of rows (vec_id, embedding, label); errors are summed by label before they are joined, null labels together."""
    rows = df.select("vec_id", "embedding", "label")
    books = train(rows)
    if books is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    made = staged(encode(rows, books), "codes")
    by = made.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return made.join(by, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle() -> str:
    """Full searches in DuckDB."""
    width = DIM // PARTS
    names = [f"x{i}" for i in range(width)]
    d = " + ".join(f"(t.{x} - c.{x}) * (t.{x} - c.{x})" for x in names)
    down = lambda x: f"(sum({x}) - ((sum({x}) % count(*)) + count(*)) % count(*)) // count(*)"
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f"""
a{r} AS MATERIALIZED (SELECT rid, part, {", ".join(f"any_value({x}) AS {x}" for x in names)}, CAST(min(s) % {ENTRIES} AS BIGINT) AS entry, CAST(min(s) // {ENTRIES} AS BIGINT) AS d
  FROM (SELECT t.*, CAST({d} AS HUGEINT) * {ENTRIES} + c.entry AS s FROM cut t JOIN c{r} c ON t.part = c.part) GROUP BY rid, part),"""
        if r < ROUNDS:
            rounds += f"""
u{r} AS (SELECT part, entry, {", ".join(f"CAST({down(x)} AS BIGINT) AS {x}" for x in names)} FROM a{r} GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, {", ".join(f"coalesce(u.{x}, c.{x}) AS {x}" for x in names)} FROM c{r} c LEFT JOIN u{r} u ON u.part = c.part AND u.entry = c.entry),"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT rid, part, {", ".join(f"v[part * {width} + {i + 1}] AS {x}" for i, x in enumerate(names))} FROM kept, unnest(range({PARTS})) AS t(part)),
heads AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS entry FROM (SELECT rid, vec_id, embedding FROM kept ORDER BY vec_id NULLS LAST, embedding LIMIT {ENTRIES})),
c0 AS MATERIALIZED (SELECT part, entry, {", ".join(names)} FROM cut JOIN heads USING (rid)),{rounds}
codes AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg({" || ',' || ".join(names)}, ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN codes USING (rid)"""
