"""Nearest vectors: a stated query set against all rows, exactly in blocks, or through an index of lists.

``nearest`` deals queries and rows into blocks of bounded size; each two blocks meet in one task, which keeps the best
of its rows for each query, and those are ranked again: exact, and its shuffle grows with rows times query blocks.

``Index`` deals every row to the nearest of some centroids, fitted on a bounded sample of rows, and a query meets the lists of its
nearest centroids alone. A list is divided into blocks where it is long, so equal or crowded vectors never make one task.
Nothing but the sample and the centroids is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

QUERY_BLOCK, ROW_BLOCK = 1_024, 8_192
#: Similarities to codes that a task holds at once; choosing among them takes about four times their bytes.
NEAR_CELLS = 1 << 20

#: The index: rows that centroids are fitted on at most, lists at most, rounds of fitting, and what share of the sample's neighbours
#: the lists that a query meets must hold, measured on so many of its rows.
SAMPLE, LISTS, ROUNDS, RECALL, ASKED = 50_000, 4_096, 8, 0.96, 500

_BEST = "query_id long, vec_id long, similarity double"


def _comparing(k: int, by_label: bool) -> Callable[[pa.Table], pa.Table]:
    """Of a group of queries and rows (asks, vec_id, embedding, label): the best rows for each query, itself left out, of equal ones the least id."""

    def compare(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids, labels = group.column("vec_id").to_numpy(), group.column("label").to_numpy(zero_copy_only=False)
        x = np.array(group.column("embedding").to_pylist(), np.float64)
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        theirs = theirs[np.argsort(ids[theirs], kind="stable")]
        if not len(mine) or not len(theirs):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        parts = []
        for i in range(0, len(mine), QUERY_BLOCK):
            some = mine[i : i + QUERY_BLOCK]
            near = np.round(x[some] @ x[theirs].T, 6)
            near[ids[some][:, None] == ids[theirs][None, :]] = -np.inf
            if by_label:
                near[labels[some][:, None] != labels[theirs][None, :]] = -np.inf
            best = np.argsort(-near, axis=1, kind="stable")[:, :k]  # rows are in order of id
            value = np.take_along_axis(near, best, 1)
            ok = np.isfinite(value)
            parts.append(pa.table({"query_id": pa.array(np.repeat(ids[some], best.shape[1])[ok.ravel()]), "vec_id": pa.array(ids[theirs][best][ok]), "similarity": pa.array(value[ok])}))
        return pa.concat_tables(parts)

    return compare


def _usable(x: DataFrame) -> DataFrame:
    return x.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "embedding", "label")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, by_label: bool = False) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` rows of ``vectors`` (vec_id, embedding, label) most like each query, not itself.

    With ``by_label`` only rows of the query's label count, which is decided before the best are taken. Of equal
    similarities, to six places, the least id comes first. Rows without an embedding are left out.
    """
    vectors, queries = _usable(vectors), _usable(queries)
    n_q, n_v = (max(1, -(-x.count() // size)) for x, size in ((queries, QUERY_BLOCK), (vectors, ROW_BLOCK)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    asked = queries.select(F.lit(True).alias("asks"), "*", block(n_q).alias("q"), all_of(n_v).alias("v"))
    rows = vectors.select(F.lit(False).alias("asks"), "*", all_of(n_q).alias("q"), block(n_v).alias("v"))
    return _ranked(asked.unionByName(rows).groupBy("q", "v").applyInArrow(_comparing(k, by_label), _BEST), k)


def _centroids(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Directions that rows gather round: begun at rows spread over the sample, moved to the mean of those nearest, ``rounds`` times."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        for j in range(lists):
            mine = x[at == j]
            if len(mine):
                c[j] = mine.mean(axis=0)
        n = np.linalg.norm(c, axis=1, keepdims=True)
        c /= np.where(n > 0, n, 1)
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """How many lists a query must meet for a share of RECALL of its ``k`` nearest in the sample: few where vectors gather, all but all where they don't."""
    asked = np.unique(np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int))
    at, need = np.argmax(x @ c.T, axis=1), []
    for i in asked:
        near = x @ x[i]
        near[i] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(len(c), int)
        place[np.argsort(-(c @ x[i]), kind="stable")] = np.arange(len(c))
        need += place[at[best]].tolist()
    return int(np.quantile(need, RECALL, method="higher")) + 1 if need else 1


@dataclass
class Index:
    """Every usable row of a table with its list, and how many lists a query meets."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int

    @classmethod
    def fit(cls, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
        """Centroids from at most about ``sample`` rows, drawn by hash; as many as the square root of the rows, LISTS at most. All rows are indexed."""
        vectors = _usable(vectors)
        n = vectors.count()
        lists = max(1, min(lists or round(n**0.5), LISTS, n))
        part = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)))) if n > sample else vectors
        x = np.array([r["embedding"] for r in part.select("embedding").orderBy("vec_id").toLocalIterator()], np.float64)  # ``sample`` rows
        c = _centroids(x, min(lists, len(x)), ROUNDS) if len(x) else np.zeros((0, 0))
        return cls(_listed(vectors, c, 1), c, _probes(x, c, 10) if len(x) else 1)

    def search(self, queries: DataFrame, k: int = 10, by_label: bool = False) -> DataFrame:
        """As ``nearest``, from the lists nearest to each query; exact within these lists."""
        asked = _listed(_usable(queries), self.centroids, self.probes)
        blocks = self.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("blocks"))  # a row a list
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        a = asked.join(F.broadcast(blocks), "list").select(F.lit(True).alias("asks"), "vec_id", "embedding", "label", "list", every)
        r = self.rows.join(F.broadcast(blocks), "list").select(F.lit(False).alias("asks"), "vec_id", "embedding", "label", "list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"))
        return _ranked(a.unionByName(r).groupBy("list", "block").applyInArrow(_comparing(k, by_label), _BEST), k)


def _listed(vectors: DataFrame, centroids: np.ndarray, lists: int) -> DataFrame:
    """Rows once for each of the ``lists`` nearest centroids, as ``list``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(centroids):
                continue
            near = np.array(b.column("embedding").to_pylist(), np.float64) @ centroids.T
            at = np.argsort(-near, axis=1, kind="stable")[:, :lists]
            rows = pa.Table.from_batches([b]).take(pa.array(np.repeat(np.arange(b.num_rows), at.shape[1])))
            yield from rows.append_column("list", pa.array(at.ravel().astype(np.int32))).combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{fields}, list int")


#: Codes: components of a part, entries of a part's book, rows that books are fitted on at most, and how many candidates for each of ``k`` are compared exactly, a share of the rows at most.
PART, ENTRIES, CODE_SAMPLE, RERANK, RERANK_SHARE = 4, 256, 20_000, 20, 8


def _books(x: np.ndarray, part: int, entries: int, rounds: int) -> np.ndarray:
    """By part and number the means that parts of ``x`` gather round; the last part is filled up with zeros."""
    parts = -(-x.shape[1] // part)
    x = np.pad(x, ((0, 0), (0, parts * part - x.shape[1]))).reshape(len(x), parts, part)
    books = x[np.linspace(0, len(x) - 1, min(entries, len(x))).astype(int)].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = x[:, p]
            at = np.argmin((book * book).sum(1) - 2 * mine @ book.T, axis=1)
            n = np.bincount(at, minlength=len(book))
            total = np.stack([np.bincount(at, weights=mine[:, d], minlength=len(book)) for d in range(part)], axis=1)
            book[n > 0] = total[n > 0] / n[n > 0][:, None]
    return books


def _decoded(codes: list[bytes], books: np.ndarray, dim: int) -> np.ndarray:
    at = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), len(books))
    return np.concatenate([book[at[:, p]] for p, book in enumerate(books)], axis=1)[:, :dim]


@dataclass
class Codes:
    """Every usable row of a table as a product code: a byte a part, with how far the code is from the vector.

    A search reads codes, a sixteenth of the vectors, and only what these can't rule out is compared by its vector: the best few for each
    query, or, above a threshold, exactly those that may reach it, since by a code's distance a similarity is bounded on both sides.
    """

    vectors: DataFrame
    rows: DataFrame
    books: np.ndarray
    dim: int
    n: int

    @classmethod
    def fit(cls, vectors: DataFrame, sample: int = CODE_SAMPLE) -> Codes:
        """Books from at most about ``sample`` rows (vec_id, embedding), drawn by hash; all rows are coded."""
        kept = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
        n = kept.count()
        part = kept.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(n, 1)))) if n > sample else kept
        x = np.array([r["embedding"] for r in part.select("embedding").orderBy("vec_id").toLocalIterator()], np.float64)  # ``sample`` rows
        dim = x.shape[1] if len(x) else 0
        books = _books(x, PART, ENTRIES, ROUNDS) if len(x) else np.zeros((0, 1, PART))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not dim:
                    continue
                y = np.array(b.column("embedding").to_pylist(), np.float64)
                cut = np.pad(y, ((0, 0), (0, len(books) * PART - dim))).reshape(len(y), len(books), PART)
                at = np.stack([np.argmin((book * book).sum(1) - 2 * cut[:, p] @ book.T, axis=1) for p, book in enumerate(books)], axis=1).astype(np.uint8)
                codes = [r.tobytes() for r in at]
                off = np.linalg.norm(y - _decoded(codes, books, dim), axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(codes, pa.binary()), pa.array(off)], ["vec_id", "code", "off"])

        kind = kept.schema["vec_id"].dataType.simpleString()
        return cls(kept.select("vec_id", "embedding"), kept.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, code binary, off double"), books, dim, n)

    def _met(self, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """(query_id, vec_id, near): of each two blocks of queries (query_id, embedding) and codes the pairs that ``choose`` takes by (similarities to codes, distances of codes, lengths of queries)."""
        q = queries.filter(F.col("embedding").isNotNull() & F.col("query_id").isNotNull())
        n_q, n_v = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-self.n // (4 * ROW_BLOCK)))
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        asked = q.select("query_id", "embedding", F.lit(None).cast(self.rows.schema["vec_id"].dataType).alias("vec_id"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("off"), block("query_id", n_q).alias("q"), all_of(n_v).alias("v"))
        rows = self.rows.select(F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast(q.schema["embedding"].dataType).alias("embedding"), "vec_id", "code", "off", all_of(n_q).alias("q"), block("vec_id", n_v).alias("v"))
        books, dim = self.books, self.dim

        def compare(group: pa.Table) -> pa.Table:
            mine, theirs = group.filter(pa.compute.is_valid(group.column("query_id"))), group.filter(pa.compute.is_valid(group.column("code")))
            parts = [pa.table({"query_id": mine.column("query_id").slice(0, 0), "vec_id": theirs.column("vec_id").slice(0, 0), "near": pa.array([], pa.float64())})]
            if mine.num_rows and theirs.num_rows:
                theirs = theirs.sort_by("vec_id")
                coded, off = _decoded(theirs.column("code").to_pylist(), books, dim), theirs.column("off").to_numpy()
                step = max(1, NEAR_CELLS // theirs.num_rows)
                for i in range(0, mine.num_rows, step):
                    some = mine.slice(i, step)
                    x = np.array(some.column("embedding").to_pylist(), np.float64)
                    near = x @ coded.T
                    r, c = np.nonzero(choose(near, off, np.linalg.norm(x, axis=1)))
                    parts.append(pa.table({"query_id": some.column("query_id").take(pa.array(r)), "vec_id": theirs.column("vec_id").take(pa.array(c)), "near": pa.array(near[r, c])}))
            return pa.concat_tables(parts).combine_chunks()

        kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for name, df in (("query_id", q), ("vec_id", self.rows))]
        return asked.unionByName(rows).groupBy("q", "v").applyInArrow(compare, ", ".join([*kinds, "near double"]))

    def _exact(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, vec_id, similarity) of pairs by their vectors, to six places."""
        from lexspan.functions.scoring import dot

        met = pairs.join(queries.select("query_id", F.col("embedding").alias("a")), "query_id").join(self.vectors.select("vec_id", F.col("embedding").alias("b")), "vec_id")
        return met.select("query_id", "vec_id", F.round(dot(F.col("a"), F.col("b")), 6).alias("similarity"))

    def search(self, queries: DataFrame, k: int = 10, rerank: int | None = None) -> DataFrame:
        """(query_id, vec_id, similarity, rank): the ``k`` best of the ``rerank`` rows that look nearest to a query (vec_id, embedding) by their codes, itself left out."""
        m = max(k, min(rerank or RERANK * k, max(self.n // RERANK_SHARE, 1)))
        q = queries.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), "embedding")

        def choose(near: np.ndarray, off: np.ndarray, length: np.ndarray) -> np.ndarray:
            if near.shape[1] <= m + 1:
                return np.ones_like(near, bool)
            out = np.zeros_like(near, bool)
            np.put_along_axis(out, np.argpartition(-near, m, axis=1)[:, : m + 1], True, 1)  # one more, as a query may be among its own
            return out

        w = W.partitionBy("query_id").orderBy(F.col("near").desc(), "vec_id")
        best = self._met(q, choose).filter("query_id <> vec_id").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= m)
        return _ranked(self._exact(best.select("query_id", "vec_id"), q), k)

    def nearest_within(self, queries: DataFrame, least: float) -> DataFrame:
        """(query_id, vec_id, similarity): for each query (query_id, embedding) the row most like it, the least id of equals, if it is ``least`` at least. Exact: codes only rule out."""

        def choose(near: np.ndarray, off: np.ndarray, length: np.ndarray) -> np.ndarray:
            room = off[None, :] * length[:, None] + 2e-6  # and rounding to six places
            return (near + room >= least) & (near + room >= (near - room).max(axis=1, keepdims=True))

        found = self._exact(self._met(queries, choose).select("query_id", "vec_id"), queries).filter(F.col("similarity") >= least)
        best = found.groupBy("query_id").agg(F.min_by(F.struct("vec_id", "similarity"), F.struct(-F.col("similarity"), "vec_id")).alias("b"))
        return best.select("query_id", "b.vec_id", "b.similarity")
