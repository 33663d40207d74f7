"""Joins of spans within documents. Spans are dealt into bins of BIN characters, so that a long document's spans
meet only near each other; each pair is found in exactly one bin, where the later of the two starts."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BIN = 1024


def _binned(df: DataFrame, prefix: str, touching: bool) -> DataFrame:
    last = F.greatest(F.col("end") - (0 if touching else 1), F.col("start"))
    named = df.select("doc_id", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "doc_id"], F.sequence(F.floor(F.col("start") / BIN), F.floor(last / BIN)).alias("bins"))
    return named.withColumn("bin", F.explode("bins")).drop("bins")


def overlap_join(a: DataFrame, b: DataFrame, touching: bool = False) -> DataFrame:
    """Pairs of spans (start, end) of one doc_id that overlap; with ``touching`` those, too, that only meet."""
    x, y = _binned(a, "a", touching), _binned(b, "b", touching)
    meets = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) if touching else (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))
    once = F.col("bin") == F.floor(F.greatest("a_start", "b_start") / BIN)
    return x.join(y, ["doc_id", "bin"]).filter(meets & once).drop("bin")


def containment_join(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (a in b)."""
    return overlap_join(inner, outer).filter((F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end")))


def best_container(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """For each span the first sentence that contains it, else the one that overlaps it most, else nothing."""
    met = overlap_join(spans, sentences)
    inside = (F.col("a_start") >= F.col("b_start")) & (F.col("a_end") <= F.col("b_end"))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    w = W.partitionBy("doc_id", "a_start", "a_end").orderBy(inside.desc(), F.when(inside, 0).otherwise(-shared), "b_start")
    best = met.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("doc_id", F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_start").alias("sentence_start"), F.col("b_end").alias("sentence_end"))
    return spans.join(best, ["doc_id", "start", "end"], "left")


def best_in(start: int, end: int, outer: list[tuple[int, int]]) -> tuple[int, int] | tuple[None, None]:
    """As ``best_container``, of one span and the spans ``outer`` of its text, which are in order and don't overlap."""
    ranked = []
    for i in range(bisect_right(outer, start, key=lambda x: x[1]), len(outer)):
        a, b = outer[i]
        if a >= end:
            break
        inside = a <= start and end <= b
        ranked.append((not inside, 0 if inside else max(a, start) - min(b, end), a, b))
    return min(ranked)[2:] if ranked else (None, None)
