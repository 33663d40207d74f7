"""Centroid clustering with Drake's adaptive bounds.

Each vector keeps the numbers of its next nearest centroids with a lower bound for each, and one lower
bound for all the remaining centroids. When centroids have moved, bounds are moved by as much, and then

* a vector whose upper bound is below all of them keeps its centroid without any distance;
* otherwise the distance to its own centroid is taken, then those to the listed centroids whose bounds
  don't exceed it; whatever isn't listed is still beyond the remainder bound;
* where the remainder bound doesn't exceed it either, the order can't be certified, and all are rescanned.

How many bounds are kept adapts: a round that needed fewer lets the next one keep fewer, between an
eighth and a quarter of the centroids. Bounds are doubles with room for their rounding, distances are
whole numbers, and a bound only certifies if it is strictly larger: ties are always decided by distances,
the smaller number first. So the result is that of plain rounds.

A round is one pass over the vectors that Spark divides; its sums by centroid are partial aggregates, and
a row a centroid goes to the driver, however many vectors one centroid has. Rows with vectors of another length, a null vector, or a
null or non-finite component have no row in the result; repeated rows are vectors each; with fewer vectors than centroids
there are as many centroids as vectors; a null id starts no centroid unless too few others are there. A
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

from lexspan.llm.common import discard, staged
from lexspan.llm.vector_grid import merged, scaled, squared, whole

CENTROIDS, ROUNDS, SCALE, DIM, SEED = 16, 3, 64, 64, "1"
_SLACK = 1e-12
_STATE = "id long, v array<int>, cluster int, up double, near array<int>, low array<double>, rest double, needed int, distances int"


class Bounds(NamedTuple):
    """Of each vector: its centroid, an upper bound for the distance to it, listed centroids with lower bounds, and the remainder bound."""

    cluster: np.ndarray
    up: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray


def rescan(x: np.ndarray, c: np.ndarray, kept: int) -> Bounds:
    """Bounds from all distances; of equal ones the smaller number is nearer."""
    d = squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = root[:, kept + 1] * (1 - _SLACK) if len(c) > kept + 1 else np.full(len(x), np.inf)
    return Bounds(order[:, 0], root[:, 0] * (1 + _SLACK), order[:, 1 : kept + 1], root[:, 1 : kept + 1] * (1 - _SLACK), rest)


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


def moved(x: np.ndarray, c: np.ndarray, drift: np.ndarray, old: Bounds, kept: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """Bounds after centroids have moved by ``drift``, how many listed bounds each vector needed, and how many distances it took."""
    n, k = len(x), len(c)
    loose = (old.low + drift[old.near] + 1) * _SLACK
    low = old.low - drift[old.near] - loose
    most = drift.max()
    rest = old.rest - most - np.where(np.isfinite(old.rest), (old.rest + most + 1) * _SLACK, 0)
    order = np.argsort(low, axis=1, kind="stable")
    near, low = np.take_along_axis(old.near, order, 1), np.take_along_axis(low, order, 1)
    if low.shape[1] > kept:  # what is listed no longer belongs to the remainder
        rest = np.minimum(rest, low[:, kept])
        near, low = near[:, :kept], low[:, :kept]
    cluster = old.cluster.copy()
    up = old.up + drift[cluster] + (old.up + drift[cluster] + 1) * _SLACK
    needed, distances = np.zeros(n, np.int64), np.zeros(n, np.int64)
    near, low = near.copy(), low.copy()

    least = np.minimum(rest, low.min(1)) if low.shape[1] else rest
    i = np.flatnonzero(up >= least)
    if len(i):
        own = _own(x[i], c[cluster[i]])
        up[i] = np.sqrt(own.astype(np.float64)) * (1 + _SLACK)
        distances[i] = 1
        doubtful = low[i] <= up[i, None]
        needed[i] = doubtful.sum(1)
        rows, cols = np.nonzero(doubtful)  # listed centroids that may be nearer
        if len(rows):
            exact = _own(x[i[rows]], c[near[i[rows], cols]])
            low[i[rows], cols] = np.sqrt(exact.astype(np.float64)) * (1 - _SLACK)
            distances[i] += needed[i]
            start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            ranked = np.lexsort((near[i[rows], cols], exact, rows))[start]  # the nearest of each, the smaller number of equals
            at, col, best = i[rows[ranked]], cols[ranked], exact[ranked]
            mine = own[rows[ranked]]
            swap = (best < mine) | ((best == mine) & (near[at, col] < cluster[at]))
            at, col, best, mine = at[swap], col[swap], best[swap], mine[swap]
            cluster[at], near[at, col] = near[at, col], cluster[at].copy()
            low[at, col] = np.sqrt(mine.astype(np.float64)) * (1 - _SLACK)
            up[at] = np.sqrt(best.astype(np.float64)) * (1 + _SLACK)
        again = i[up[i] >= rest[i]]
        if len(again):
            full = rescan(x[again], c, low.shape[1])
            cluster[again], up[again], near[again], low[again], rest[again] = full
            needed[again], distances[again] = low.shape[1], k
    return Bounds(cluster, up, near, low, rest), needed, distances


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1), kind), a.shape[1]).cast(pa.list_(kind)) if a.shape[1] else pa.array([[]] * len(a), pa.list_(kind))


def _state(ids: pa.Array, x: np.ndarray, b: Bounds, needed: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    columns = {
        "id": ids,
        "v": _lists(x, pa.int32()),
        "cluster": pa.array(b.cluster, pa.int32()),
        "up": pa.array(b.up),
        "near": _lists(b.near, pa.int32()),
        "low": _lists(b.low, pa.float64()),
        "rest": pa.array(b.rest),
        "needed": pa.array(needed, pa.int32()),
        "distances": pa.array(distances, pa.int32()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _read(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, Bounds]:
    flat = lambda name: b.column(name).flatten().to_numpy(zero_copy_only=False)
    one = lambda name: b.column(name).to_numpy(zero_copy_only=False)
    n = b.num_rows
    return flat("v").astype(np.int64).reshape(n, dim), Bounds(one("cluster").astype(np.int64), one("up"), flat("near").astype(np.int64).reshape(n, -1), flat("low").reshape(n, -1), one("rest"))


class Clusters(NamedTuple):
    """``rows``: (id, cluster, distance); the final centroids; and what each pass took: distances, of how many, and bounds kept."""

    rows: DataFrame
    centroids: list[list[int]]
    passes: list[tuple[int, int, int]]


def starts(kept: DataFrame, k: int, scale: int, dim: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors of the smallest hashes of seed and id, in that order; rows that share an id go by their components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select("v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in scaled(pa.array([r["v"]]), dim, scale)[0]] for r in first]


def cluster(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: str = SEED, made: list[str] | None = None) -> Clusters:
    """Rounds of assignment and update from hashed starts, then one more assignment. Staged tables that still are read go to ``made``."""
    spark = df.sparkSession
    kept = whole(df, vector, dim).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    c = np.array(starts(kept, k, scale, dim, seed), np.int64).reshape(-1, dim)
    most, least = max(1, k // 4), max(1, k // 8)
    bounds, drift, passes, before = min(most, max(len(c) - 1, 0)), np.zeros(len(c)), [], []
    if not len(c):
        return Clusters(spark.createDataFrame([], "id long, cluster int, distance long"), [], [])

    def first(batches: Iterator[pa.RecordBatch], c=c, bounds=bounds) -> Iterator[pa.RecordBatch]:
        for b in merged(batches):
            x = scaled(b.column("v"), dim, scale)
            yield _state(b.column("id"), x, rescan(x, c, bounds), np.full(len(x), bounds), np.full(len(x), len(c)))

    def sums(state: DataFrame) -> tuple[np.ndarray, int]:
        by = state.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distances").alias("distances"), F.max("needed").alias("needed"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(dim)]).alias("s")).collect()
        new = c.copy()
        for r in by:
            new[r["cluster"]] = [s // r["n"] for s in r["s"]]
        passes.append((sum(r["distances"] for r in by), len(c) * sum(r["n"] for r in by), bounds))
        return new, max((r["needed"] for r in by), default=0)

    state = None
    for _ in range(rounds):

        def again(batches: Iterator[pa.RecordBatch], c=c, drift=drift, bounds=bounds) -> Iterator[pa.RecordBatch]:
            for b in merged(batches):
                x, old = _read(b, dim)
                yield _state(b.column("id"), x, *moved(x, c, drift, old, bounds))

        written: list[str] = []
        state = staged(kept.mapInArrow(first, _STATE) if state is None else state.mapInArrow(again, _STATE), "bounds", written)
        discard(spark, before)
        before = written
        new, needed = sums(state)
        drift = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
        c, bounds = new, min(bounds, max(min(least, len(c) - 1), needed))

    def last(batches: Iterator[pa.RecordBatch], c=c, drift=drift, bounds=bounds, unbounded=state is None) -> Iterator[pa.RecordBatch]:
        for b in merged(batches):
            if unbounded:
                x = scaled(b.column("v"), dim, scale)
                to = rescan(x, c, bounds).cluster
            else:
                x, old = _read(b, dim)
                to = moved(x, c, drift, old, bounds)[0].cluster
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(to, pa.int32()), pa.array(_own(x, c[to]), pa.int64())], ["id", "cluster", "distance"])

    rows = staged((kept if state is None else state).mapInArrow(last, "id long, cluster int, distance long"), "clusters", made)
    discard(spark, before)
    return Clusters(rows, [[int(x) for x in one] for one in c], passes)


def report(found: Clusters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): what the clusters add up to beside each vector; one row a centroid is broadcast."""
    spark = found.rows.sparkSession
    by = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(by.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    each = spark.createDataFrame([(j, s, total, sha[j]) for j, s in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.withColumnRenamed("id", "vec_id").join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """Plain rounds in DuckDB: every distance of every vector each time."""
    d = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f"""
a{r} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, CAST(min(s) % {CENTROIDS} AS INTEGER) AS cluster, CAST(min(s) // {CENTROIDS} AS BIGINT) AS distance
  FROM (SELECT rid, vec_id, v, CAST({d} AS HUGEINT) * {CENTROIDS} + j AS s FROM kept, c{r}) GROUP BY rid),"""
        if r < ROUNDS:
            rounds += f"""
u{r} AS MATERIALIZED (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
  SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, {DIM} + 1)) AS t(i) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(u{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN u{r} ON u{r}.cluster = c{r}.j),"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS j, v AS c FROM (
  SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {CENTROIDS})),{rounds}
by_cluster AS (SELECT cluster, sum(distance) AS s FROM a{ROUNDS} GROUP BY cluster)
SELECT vec_id, a.cluster, distance, CAST(s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(distance) FROM a{ROUNDS}) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN by_cluster USING (cluster) JOIN c{ROUNDS} ON j = a.cluster"""
