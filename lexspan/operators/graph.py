"""Graphs around concepts: breadth-first search from many starts at once, with typed edges.

A step joins the frontiers of all starts with the edges, so the number of steps is that of levels, not of
starts. A start never has more than ``most`` nodes, so neither has its frontier; what a step finds beyond that is
counted and dropped, the first by iri staying; with None for ``most`` all stay. Nodes are taken in phases: ancestors up to the roots, descendants, see-also nodes of all
these, and the ancestors of see-also nodes. Within a phase nearer nodes come first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.staging import discard, staged

#: Nodes of a graph, see-also links of a node, levels of a walk to the roots, levels down.
MOST, ALSO, UP, DOWN = 200, 5, 50, 2


class Graph(NamedTuple):
    """``nodes`` (start, iri, depth), ``edges`` (start, source, target, edge_type), ``totals`` (start, n_nodes, n_found, truncated)."""

    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame


class _Search:
    """Nodes so far (start, iri, depth), and how many new ones each step found, kept or not (start, n), as staged tables."""

    def __init__(self, starts: DataFrame, most: int | None) -> None:
        self.most, self.made = most, []
        self.nodes = staged(starts.select("start", F.col("start").alias("iri"), F.lit(0).alias("depth")), "graph", self.made)
        self.found: DataFrame | None = None

    def taken(self, found: DataFrame) -> DataFrame:
        """Of (start, iri, depth) those that are nodes or become nodes, with ``new``: a start takes as many as it has room for."""
        known = self.nodes.select("start", "iri", F.lit(True).alias("known"))
        met = found.join(known, ["start", "iri"], "left")
        fresh = met.filter("known IS NULL")
        if self.most is not None:
            room = self.nodes.groupBy("start").agg((F.lit(self.most) - F.count(F.lit(1))).alias("room"))
            # the rank's bound lets each task keep its own first ones before the shuffle
            ranked = fresh.withColumn("rank", F.row_number().over(W.partitionBy("start").orderBy("iri"))).filter(F.col("rank") <= self.most)
            fresh = ranked.join(room, "start").filter("rank <= room")
        fresh = fresh.select("start", "iri", "depth", F.lit(True).alias("new"))
        old = met.filter("known").select("start", "iri", "depth", F.lit(False).alias("new"), F.lit(0).cast("long").alias("n"))
        count = met.filter("known IS NULL").groupBy("start").agg(F.count(F.lit(1)).alias("n")).select("start", F.lit(None).cast("string").alias("iri"), F.lit(None).cast("int").alias("depth"), F.lit(False).alias("new"), "n")
        level = staged(old.unionByName(fresh.withColumn("n", F.lit(0).cast("long"))).unionByName(count), "graph", self.made)
        found = level.filter("iri IS NULL").select("start", "n")
        self.found = found if self.found is None else self.found.unionByName(found)
        self.nodes = self.nodes.unionByName(level.filter("new").select("start", "iri", "depth"))
        return level.filter("iri IS NOT NULL").drop("n")

    def walk(self, begin: DataFrame, steps: DataFrame, levels: int, sign: int, walked: DataFrame | None = None) -> DataFrame:
        """(start, iri, level) that is walked from (start, iri) along ``steps`` (iri, to), ``begin`` at level 0 included, nothing of ``walked`` again."""
        front = begin.select("start", "iri", F.lit(0).alias("level"))
        every = front
        seen = front.select("start", "iri") if walked is None else front.select("start", "iri").unionByName(walked.select("start", "iri"))
        for level in range(1, levels + 1):
            found = front.join(steps, "iri").select("start", F.col("to").alias("iri")).distinct().join(seen, ["start", "iri"], "left_anti")
            front = self.taken(found.withColumn("depth", F.lit(sign * level))).select("start", "iri", F.lit(level).alias("level"))
            if front.isEmpty():
                break
            every, seen = every.unionByName(front), seen.unionByName(front.select("start", "iri"))
        return every


def explore(edges: DataFrame, see_also: DataFrame, starts: DataFrame, up: int = UP, down: int = DOWN, also: int = ALSO, most: int | None = MOST) -> Graph:
    """The graph of each start (iri), along (child, parent) and the first ``also`` links (a, b, ord) of each node; a see-also edge goes from the lesser iri to the greater.

    Depths are below 0 upwards, 0 for see-also nodes, and an ancestor of a see-also node has its distance from the nearest of these. The ends
    of edges are taken to exist. Repeated rows count once; a null iri is no concept; cycles end where they meet what has been walked.
    """
    steps = edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()
    ups, downs = steps.select(F.col("child").alias("iri"), F.col("parent").alias("to")), steps.select(F.col("parent").alias("iri"), F.col("child").alias("to"))
    links = see_also.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.min("ord").alias("ord"))
    links = links.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("ord", "b"))).filter(F.col("rank") <= also).select(F.col("a").alias("iri"), F.col("b").alias("to"))
    mine = starts.select(F.col("iri").alias("start")).filter("start IS NOT NULL").distinct()
    search = _Search(mine, most)
    begin = search.nodes.select("start", "iri")

    above = search.walk(begin, ups, up, -1)
    below = search.walk(begin, downs, down, 1)
    pairs = staged(search.nodes.select("start", "iri").join(links, "iri").select("start", "iri", "to"), "graph", search.made)
    linked = search.taken(pairs.select("start", F.col("to").alias("iri")).distinct().withColumn("depth", F.lit(0)))
    around = search.walk(linked.filter("new").select("start", "iri"), ups, up, -1, walked=above)

    here = search.nodes.select("start", "iri")
    at = lambda walked, column: walked.select("start", F.col("iri").alias(column)).distinct()
    climbed = at(above, "target").union(at(around, "target")).distinct().join(steps.select(F.col("child").alias("target"), F.col("parent").alias("source")), "target").select("start", "source", "target")
    descended = at(below.filter(F.col("level") < down), "source").join(steps.select(F.col("parent").alias("source"), F.col("child").alias("target")), "source").select("start", "source", "target")
    is_a = climbed.unionByName(descended).distinct().withColumn("edge_type", F.lit("subClassOf"))
    seen = pairs.select("start", F.least("iri", "to").alias("source"), F.greatest("iri", "to").alias("target")).distinct().withColumn("edge_type", F.lit("seeAlso"))
    both = is_a.unionByName(seen).join(here.withColumnRenamed("iri", "source"), ["start", "source"], "left_semi").join(here.withColumnRenamed("iri", "target"), ["start", "target"], "left_semi")
    out_nodes, out_edges = staged(search.nodes, "graph-nodes"), staged(both.select("start", "source", "target", "edge_type"), "graph-edges")
    found = staged(search.found.groupBy("start").agg(F.sum("n").alias("n")), "graph-found")
    discard(edges.sparkSession, search.made)
    count = out_nodes.groupBy("start").agg(F.count(F.lit(1)).alias("n_nodes")).join(found, "start", "left")
    n_found = 1 + F.coalesce("n", F.lit(0))
    totals = count.select("start", "n_nodes", n_found.alias("n_found"), (n_found > F.col("n_nodes")).alias("truncated"))
    return Graph(out_nodes, out_edges, totals)


def described(nodes: DataFrame, concepts: DataFrame, roots: DataFrame, branches: DataFrame) -> DataFrame:
    """Nodes with what is said of them: label, definition, branch (iri, branch) with its colour, and whether they are the focus or a root (iri)."""
    from lexspan.functions.text import iri_hash
    from lexspan.operators.concepts import color

    said = concepts.select("iri", F.coalesce("label", iri_hash(F.col("iri"))).alias("label"), "definition")
    met = nodes.join(said, "iri", "left").join(branches, "iri", "left").join(roots.select("iri", F.lit(True).alias("root")).distinct(), "iri", "left")
    met = met.withColumn("branch", F.coalesce("branch", F.lit("Unknown")))
    return met.select("start", "iri", "depth", "label", "definition", "branch", color(F.col("branch")).alias("branch_color"), (F.col("iri") == F.col("start")).alias("is_focus"), F.coalesce("root", F.lit(False)).alias("is_branch_root"))
