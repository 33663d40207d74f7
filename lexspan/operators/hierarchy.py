"""Concept hierarchies as joins level by level, each level bounded by its depth limit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.staging import discard, staged

PATH_LIMIT, WALK_LIMIT = 10, 20
#: Children of one parent that are a side of a block of pairs; and tasks that blocks are dealt to at most.
PART, MOST_TASKS = 2048, 20_000


def closure(edges: DataFrame, limit: int = WALK_LIMIT) -> DataFrame:
    """(iri, ancestor, depth) from (child, parent): all ancestors at their least depth; cycles end where they meet themselves.

    Each level is a table of its own, so the plan stays flat however deep the hierarchy is.
    """
    spark, made = edges.sparkSession, []
    level = edges.select(F.col("child").alias("iri"), F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1))
    found = level = staged(level, "closure", made)
    up = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("above")).distinct()
    for depth in range(2, limit + 1):
        level = staged(level.join(up, "ancestor").select("iri", F.col("above").alias("ancestor")).filter("iri <> ancestor").distinct().join(found, ["iri", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure", made)
        if level.isEmpty():
            break
        found = found.unionByName(level)
    whole = staged(found, "ancestors")
    discard(spark, made)
    return whole


def paths(edges: DataFrame, limit: int = PATH_LIMIT, first_parent: bool = True) -> DataFrame:
    """(iri, path): from the root to the concept, by the first parent (``ord`` least), or a path for each immediate parent."""
    w = W.partitionBy("child").orderBy("ord", "parent")
    first = edges.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("child", "parent")
    every = edges.select("child").union(edges.select("parent")).distinct().withColumnRenamed("child", "iri")
    start = (first if first_parent else edges.select("child", "parent").distinct()).withColumnRenamed("child", "iri")
    at = every.join(start, "iri", "left").select("iri", F.col("parent").alias("top"), F.when(F.col("parent").isNull(), F.array("iri")).otherwise(F.array("parent", "iri")).alias("path"))
    step = first.select(F.col("child").alias("top"), F.col("parent").alias("above"))
    for _ in range(limit - 2):
        at = at.join(step, "top", "left").select("iri", F.when(F.array_contains("path", F.col("above")), None).otherwise(F.col("above")).alias("top"), F.when(F.col("above").isNull() | F.array_contains("path", F.col("above")), F.col("path")).otherwise(F.concat(F.array("above"), "path")).alias("path"))
    return at.select("iri", "path").distinct()


def first_parents(edges: DataFrame) -> DataFrame:
    """(iri, parent): each child's first parent, by ``ord``."""
    w = W.partitionBy("child").orderBy("ord", "parent")
    return edges.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select(F.col("child").alias("iri"), "parent")


def _parts(edges: DataFrame) -> tuple[DataFrame, int]:
    """(parent, parts): in how many parts a parent's children are dealt; and in how many tasks all pairs of children are."""
    sizes = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    tasks = min(max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PART**2)), MOST_TASKS)
    return sizes.select("parent", F.ceil(F.col("n") / PART).alias("parts")), tasks


def siblings(edges: DataFrame) -> DataFrame:
    """(iri, sibling): other children of the first parent.

    The pairs are as many as the squares of the families: they are made in blocks, two parts of a family each, and none is shuffled.
    """
    parts, tasks = _parts(edges)
    deal = lambda df, key, own, other: df.join(parts, "parent").withColumn(own, F.pmod(F.xxhash64(key), "parts")).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).repartition(tasks, "parent", "a", "b").drop("parts")
    every = edges.select("parent", F.col("child").alias("sibling")).distinct()
    return deal(first_parents(edges), "iri", "a", "b").join(deal(every, "sibling", "b", "a"), ["parent", "a", "b"]).filter("iri <> sibling").select("iri", "sibling")


def with_parents(df: DataFrame, edges: DataFrame, said: DataFrame) -> DataFrame:
    """Rows (iri, ...) with what ``said`` (parent, ...) says of their first parents; of a large family some parts of rows meet a copy of it each."""
    parts, tasks = _parts(edges)
    spread = edges.sparkSession.sparkContext.defaultParallelism  # parts of rows without a parent
    rows = df.join(first_parents(edges), "iri", "left").join(parts, "parent", "left").withColumn("part", F.pmod(F.xxhash64("iri"), F.coalesce("parts", F.lit(spread)))).drop("parts")
    copies = said.join(parts, "parent").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return rows.repartition(tasks, "parent", "part").join(copies.repartition(tasks, "parent", "part"), ["parent", "part"], "left").drop("parent", "part")


def branch_of(edges: DataFrame, roots: DataFrame, limit: int = WALK_LIMIT) -> DataFrame:
    """(iri, branch): the nearest ancestor, itself included, that is a root (iri, branch), of equally near ones the least; else Unknown.

    Roots' names go down level by level, and a concept takes the first that reaches it: each edge is looked at once, whatever the closure's size.
    """
    spark, made = edges.sparkSession, []
    every = edges.select(F.col("child").alias("iri")).union(edges.select("parent")).distinct()
    down = edges.select(F.col("parent").alias("iri"), F.col("child").alias("below")).distinct()
    named = roots.groupBy("iri").agg(F.min("branch").alias("branch"))
    found = level = staged(named.join(every, "iri", "left_semi").select("iri", F.col("iri").alias("root")), "branch", made)
    for _ in range(limit):
        level = level.join(down, "iri").groupBy(F.col("below").alias("iri")).agg(F.min("root").alias("root")).join(found, "iri", "left_anti")
        level = staged(level, "branch", made)
        if level.isEmpty():
            break
        found = found.unionByName(level)
    met = staged(found.join(named.withColumnRenamed("iri", "root"), "root").select("iri", "branch"), "branches")
    discard(spark, made)
    return every.join(met, "iri", "left").select("iri", F.coalesce("branch", F.lit("Unknown")).alias("branch"))
