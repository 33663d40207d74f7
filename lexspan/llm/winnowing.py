"""Document fingerprints by winnowing.

Rolling hashes of all K-grams of code points; in each window of W of them the least is chosen, of equal
ones the rightmost; chosen hashes are kept with their positions. Any stretch of W + K - 1 code points
that two texts share leaves a common hash in both, and its positions say where.

A text of less than two such stretches keeps all its K-grams, and one of less than 2 K - 1 code points all
grams of two lengths: the largest power of two in its longer half, and twice that. So a text that keeps its
first half always shares a hash with what it was. Empty and null texts have none. Likeness is the Jaccard
index of two texts' sets of hashes, 1 for two empty ones. Equal texts, equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.llm.common import partitions, small

K = 8
WINDOW = 8  # at most 255, as gaps are written in a byte
RANGE_BYTES, MOST_RANGES = 32 << 20, 10_000  # of text in a range, which is one task; and ranges at most

_BASE = 0x9E3779B97F4A7C15  # fixed value: an odd multiplier
_LOWEST = -(1 << 63)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams, k a power of two: spans are doubled by joining neighbours."""
    h, factor, span = points.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while span < k:
            h = h[:-span] * np.uint64(factor) + h[span:]
            factor, span = factor * factor % (1 << 64), span * 2
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(32)


def _all_grams(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of all k-grams of a short text; if it is too short for these, of all grams of two lengths."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    half = 1 << ((n + 1) // 2).bit_length() - 1
    found = [gram_hashes(points, x) for x in ([k] if half >= k else [half, 2 * half]) if x <= n]
    positions = np.concatenate([np.arange(len(h)) for h in found])
    order = np.argsort(positions, kind="stable")
    return np.concatenate(found)[order], positions[order]


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) < 2 * (k + window - 1):
        return _all_grams(points, k)
    h = gram_hashes(points, k)
    last = np.uint64((1 << 32) - 1)
    least = h << np.uint64(32) | (last - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is least
    span = 1
    while span * 2 <= window and len(least) > span:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    chosen = least[np.r_[True, least[1:] != least[:-1]]]
    return chosen >> np.uint64(32), (last - (chosen & last)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two arrays of hashes as sets."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    all_ = len(a) + len(b) - both
    return both / all_ if all_ else 1.0


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Ten hexadecimal digits for each: eight of the hash, two of the gap from the position before, at first from 0."""
    if not len(hashes):
        return ""
    rows = np.empty(len(hashes), np.dtype([("hash", ">u4"), ("gap", "u1")]))
    rows["hash"], rows["gap"] = hashes, np.diff(positions, prepend=0)
    return rows.tobytes().hex(" ", 5)


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``hashes`` array<long> and ``positions`` array<long>, which replace columns of these names."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c not in ("hashes", "positions")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("hashes", "positions")])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [winnow(x or "") for x in b.column(text).to_pylist()]
            columns = [b.column(c).cast(target.field(c).type) for c in kept]
            columns += [pa.array([x[i].astype(np.int64) for x in found], pa.list_(pa.int64())).cast(target.field(c).type) for i, c in enumerate(("hashes", "positions"))]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.select(*kept).mapInArrow(run, schema)


def _range_of(place: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the descending bounds the place (id, tie) is below: found in blocks of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    point = lambda x: F.struct(F.lit(x[0]).cast("long").alias("id"), F.lit(x[1]).cast("long").alias("tie"))
    size = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    heads = F.array(*[point(b[0]) for b in blocks])
    inner = F.array(*[F.array(*map(point, b)) for b in blocks])
    block = F.size(F.filter(heads, lambda x: place < x))
    return F.when(block == 0, 0).otherwise((block - 1) * size + F.size(F.filter(F.element_at(inner, F.greatest(block, F.lit(1))), lambda x: place < x)))


def _bounds(ids: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Descending bounds of about equal numbers of rows; an id that fills several ranges is divided by the hash of the text."""
    if ranges < 2:
        return []
    cuts = Counter(int(x) for x in ids.stat.approxQuantile("id", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)))
    return [(x, (1 << 63) - 1 - ((1 << 64) // n) * j) for x in sorted(cuts, reverse=True) for n in (cuts[x],) for j in range(n)]


def ranges_of(df: DataFrame) -> int:
    """Ranges of about RANGE_BYTES of text, two for each shuffle partition at least; MOST_RANGES at most, which are larger then: their bounds stand in the plan, and a range is sorted with spills and streamed."""
    size = df.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(2 * partitions(df.sparkSession), min(MOST_RANGES, -(-size // RANGE_BYTES)))


def with_next(df: DataFrame, ranges: int) -> DataFrame:
    """Rows (doc_id, text) dealt by ranges of doc_id, descending, and sorted; each range also gets the first row after it, as a copy.

    After the last row comes the first. Ids that are null come last; rows of equal ids go by the hash of the text, then the text.
    A range is a partition of its own.
    """
    body = F.coalesce("text", F.lit(""))
    at = F.struct(F.coalesce("doc_id", F.lit(_LOWEST)).cast("long").alias("id"), F.xxhash64(body).alias("tie"))
    keyed = df.select("doc_id", body.alias("text"), at.alias("at"))
    narrow = df.select(at.alias("at"))
    bounds = _bounds(narrow.select("at.id"), ranges)
    here = _range_of(F.col("at"), bounds)
    # one row a range: its first place, and the range before it, round in a circle
    heads = narrow.select("at", here.alias("range")).groupBy("range").agg(F.max("at").alias("at"))
    before = F.coalesce(F.lag("range").over(W.orderBy("range")), F.max("range").over(W.partitionBy()))
    heads = heads.select("at", before.alias("to"))
    rows = keyed.join(F.broadcast(heads), "at", "left").select("doc_id", "text", "at", F.explode(F.array_compact(F.array(F.struct(here.alias("range"), F.lit(0).alias("copy")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("range"), F.lit(1).alias("copy")))))).alias("place"))
    rows = rows.select("doc_id", "text", "at", F.col("place.range").cast("int").alias("range"), "place.copy")
    return rows.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "copy", F.col("at").desc(), "text").drop("at")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with its edited text and its next one; only one row and its successor are held."""
    held, place = None, None
    for b in small(batches):
        out: list[tuple] = []
        for doc_id, text, at, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "range", "copy")), strict=True):
            if copy and held is None:
                continue  # a copy of equal id after the first
            now = (doc_id, text, winnow(text))
            if held is not None and at == place:
                out.append(_compared(held, now))
            held, place = (None if copy else now), at
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], _NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited_text(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(one: tuple, two: tuple) -> tuple:
    doc_id, text, (hashes, positions) = one
    edited = edited_text(text, two[1])
    other = winnow(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(hashes, positions), written(*other), likeness(hashes, other[0]), likeness(hashes, two[2][0]))


def edits(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): its fingerprint, that of its edited text, and their likeness and that to the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in _pairs(batches):
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, types, strict=True)], _NAMES)

    return with_next(df, ranges_of(df)).mapInArrow(run, schema)
