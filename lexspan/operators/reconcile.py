"""Two sources of concept candidates reconciled, and what follows from it for annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.functions.scoring import boosted

FLOOR = 0.60
SIMILAR = 0.85


def _keyed(df: DataFrame, side: str, *more: str) -> DataFrame:
    """One row for each (text, iri), an empty iri for none: the confidence of its last row by ``ord``, and its first row's place and confidence."""
    rows = df.select(F.lower("text").alias("text"), F.coalesce("iri", F.lit("")).alias("iri"), "confidence", "ord", *more)
    last = lambda c: F.max_by(c, "ord").alias(f"{side}_{c}")
    return rows.groupBy("text", "iri").agg(*[last(c) for c in ("confidence", *more)], F.min("ord").alias(f"{side}_first_ord"), F.min_by("confidence", "ord").alias(f"{side}_first_confidence"))


def _agreed(r: DataFrame, m: DataFrame) -> DataFrame:
    return r.join(m, ["text", "iri"]).select("text", "iri", F.lit("both_agree").alias("category"), boosted(F.greatest("r_confidence", "m_confidence")).alias("confidence"))


def _left(side: DataFrame, done: DataFrame) -> DataFrame:
    return side.join(done.select("text", "iri"), ["text", "iri"], "left_anti")


def _alone(r: DataFrame, m: DataFrame, floor: float) -> DataFrame:
    """What has no partner: the ruler's only from ``floor`` on."""
    ruler = r.filter(F.col("r_confidence") >= floor).select("text", "iri", F.lit("ruler_only").alias("category"), F.col("r_confidence").alias("confidence"))
    return ruler.unionByName(m.select("text", "iri", F.lit("llm_only").alias("category"), F.col("m_confidence").alias("confidence")))


def reconcile(ruler: DataFrame, model: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(text, iri, category, confidence) of two sides (text, iri, confidence, ord): equal pairs are boosted; a side's row without an iri
    agrees with the other's first row of its text that has no partner yet; what is left stays alone."""
    r, m = _keyed(ruler, "r"), _keyed(model, "m")
    agree = _agreed(r, m)
    r, m = _left(r, agree), _left(m, agree)

    def met(bare: DataFrame, named: DataFrame, b: str, n: str) -> DataFrame:
        # a text has one row without an iri at most, and then the other side has none
        first = named.groupBy("text").agg(F.min_by(F.struct("iri", f"{n}_first_confidence"), f"{n}_first_ord").alias("p"))
        both = bare.filter("iri = ''").select("text", f"{b}_confidence").join(first, "text")
        return both.select("text", F.col("p.iri").alias("iri"), F.lit("both_agree").alias("category"), boosted(F.greatest(f"{b}_confidence", F.col(f"p.{n}_first_confidence"))).alias("confidence"))

    by_ruler, by_model = met(r, m, "r", "m"), met(m, r, "m", "r")
    bare = lambda x: x.select("text", F.lit("").alias("iri"))
    r = _left(r, bare(by_ruler).union(by_model.select("text", "iri")))
    m = _left(m, bare(by_model).union(by_ruler.select("text", "iri")))
    return agree.unionByName(by_ruler).unionByName(by_model).unionByName(_alone(r, m, floor))


def triaged(ruler: DataFrame, model: DataFrame, floor: float = FLOOR, similar: float = SIMILAR) -> DataFrame:
    """As ``reconcile``, of sides that also have ``similarity`` of text and label and ``overlap`` of text and definition; conflicts are decided.

    What is left of a text after equal pairs meets in order, one by one. Without one of the iris the pair agrees on the other. With
    two the better similarity above ``similar`` wins, the ruler's on a tie, and lifts the confidence; else the larger overlap; else both stay.
    """
    r, m = _keyed(ruler, "r", "similarity", "overlap"), _keyed(model, "m", "similarity", "overlap")
    agree = _agreed(r, m)
    r, m = _left(r, agree), _left(m, agree)
    nth = lambda x, s: x.withColumn("nth", F.row_number().over(W.partitionBy("text").orderBy(f"{s}_first_ord")))
    met = nth(r, "r").withColumnRenamed("iri", "r_iri").join(nth(m, "m").withColumnRenamed("iri", "m_iri"), ["text", "nth"])
    named = (F.col("r_iri") != "") & (F.col("m_iri") != "")
    merged = met.filter(~named).select("text", F.when(F.col("r_iri") != "", F.col("r_iri")).otherwise(F.col("m_iri")).alias("iri"), F.lit("both_agree").alias("category"), boosted(F.greatest("r_confidence", "m_confidence")).alias("confidence"))
    best = F.greatest("r_similarity", "m_similarity")
    by_overlap = F.when((F.col("r_overlap") > F.col("m_overlap")) & (F.col("r_overlap") > 0), "r").when((F.col("m_overlap") > F.col("r_overlap")) & (F.col("m_overlap") > 0), "m").otherwise("both")
    winner = F.when(best > similar, F.when(F.col("r_similarity") >= F.col("m_similarity"), "r").otherwise("m")).otherwise(by_overlap)
    side = lambda s: F.when(F.col("winner").isin(s, "both"), F.struct(F.col(f"{s}_iri").alias("iri"), F.when(best > similar, F.greatest(f"{s}_confidence", f"{s}_similarity")).otherwise(F.col(f"{s}_confidence")).alias("confidence")))
    decided = met.filter(named).withColumn("winner", winner).select("text", F.explode(F.array_compact(F.array(side("r"), side("m")))).alias("x")).select("text", "x.iri", F.lit("conflict_resolved").alias("category"), "x.confidence")
    r = _left(r, met.select("text", F.col("r_iri").alias("iri")))
    m = _left(m, met.select("text", F.col("m_iri").alias("iri")))
    return agree.unionByName(merged).unionByName(decided).unionByName(_alone(r, m, floor))


def annotation_states(annotations: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Annotations with a category and state: by (text, iri), those without an iri by text alone, the stronger category first."""
    strength = F.when(F.col("category") == "both_agree", 0).when(F.col("category") == "conflict_resolved", 1).when(F.col("category") == "llm_only", 2).otherwise(3)
    exact = reconciled.select(F.col("text").alias("key"), "iri", F.col("category").alias("exact"))
    loose = reconciled.groupBy(F.col("text").alias("key")).agg(F.min_by("category", strength).alias("loose"))
    a = annotations.withColumn("key", F.lower("text")).withColumn("iri", F.coalesce("iri", F.lit("")))
    a = a.join(exact, ["key", "iri"], "left").join(loose, "key", "left")
    found = F.coalesce("exact", F.when(F.col("iri") == "", F.col("loose")))
    state = F.when(found.isin("both_agree", "conflict_resolved"), "confirmed").when(found.isNull(), "rejected").otherwise("preliminary")
    return a.withColumn("category", found).withColumn("state", state).drop("key", "exact", "loose")
