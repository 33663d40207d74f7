"""Concepts in detail: roots, relatives by label, batches looked up by key, counts by branch.

``concepts`` has iri, label, definition, preferred_label, parents array<string>, see_also array<string>, alternatives array<string>,
examples array<string>, deprecated boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.constants import BRANCHES, EXCLUDED_BRANCHES, FALLBACK_COLOR
from lexspan.functions.text import iri_hash
from lexspan.operators import hierarchy

THING = "http://www.w3.org/2002/07/owl#Thing"
BATCH = 100


def color(branch: Column) -> Column:
    """A branch's colour by its display name."""
    return F.coalesce(*[F.when(branch == name, c) for name, c in BRANCHES.values()], F.lit(FALLBACK_COLOR))


def visible_branches(excluded: tuple[str, ...] = EXCLUDED_BRANCHES) -> list[str]:
    """The names that models are told of, sorted."""
    return sorted(name for name, _ in BRANCHES.values() if name not in excluded)


def edges(concepts: DataFrame) -> DataFrame:
    """(child, parent, ord) between concepts that exist; the top of all is none."""
    each = concepts.select(F.col("iri").alias("child"), F.posexplode("parents").alias("ord", "parent"))
    return each.join(concepts.select(F.col("iri").alias("parent")), "parent", "left_semi").select("child", "parent", "ord")


def roots(concepts: DataFrame, known: DataFrame) -> DataFrame:
    """(iri, branch): the known roots under their names, and concepts directly under the top alone under their labels."""
    own = concepts.filter(F.col("parents") == F.array(F.lit(THING))).join(known, "iri", "left_anti")
    return known.select("iri", "branch").unionByName(own.select("iri", F.coalesce("label", iri_hash(F.col("iri"))).alias("branch")))


def _named(df: DataFrame, concepts: DataFrame, name: str) -> DataFrame:
    """(iri, name): arrays of (label, iri) of what ``df`` (iri, other) points to, by label; what doesn't exist is skipped."""
    known = concepts.select(F.col("iri").alias("other"), F.coalesce("label", iri_hash(F.col("iri"))).alias("label"))
    return df.join(known, "other").groupBy("iri").agg(F.array_sort(F.collect_set(F.struct("label", F.col("other").alias("iri")))).alias(name))


def _near(concepts: DataFrame, e: DataFrame) -> DataFrame:
    """(iri, all_parents, children, related): each an array of (label, iri), by label, or null."""
    pairs = {
        "all_parents": e.select(F.col("child").alias("iri"), F.col("parent").alias("other")),
        "children": e.select(F.col("parent").alias("iri"), F.col("child").alias("other")),
        "related": concepts.select("iri", F.explode("see_also").alias("other")),
    }
    out = concepts.select("iri")
    for name, df in pairs.items():
        out = out.join(_named(df, concepts, name), "iri", "left")
    return out


def _with_siblings(df: DataFrame, concepts: DataFrame, e: DataFrame) -> DataFrame:
    """Rows with ``siblings``: their first parents' children but themselves. The lists, as long as the family for each of it, are made last and never shuffled."""
    family = _named(e.select(F.col("parent").alias("iri"), F.col("child").alias("other")), concepts, "family").withColumnRenamed("iri", "parent")
    met = hierarchy.with_parents(df, e, family)
    lists = met.withColumn("siblings", F.filter("family", lambda x: x["iri"] != F.col("iri"))).drop("family")
    empty = F.array().cast("array<struct<label:string,iri:string>>")
    return lists.withColumns({c: F.coalesce(c, empty) for c in ("all_parents", "children", "siblings", "related")})


def relatives(concepts: DataFrame) -> DataFrame:
    """(iri, all_parents, children, siblings, related): each an array of (label, iri), by label."""
    e = edges(concepts)
    return _with_siblings(_near(concepts, e), concepts, e).select("iri", "all_parents", "children", "siblings", "related")


def detail(concepts: DataFrame, known: DataFrame) -> DataFrame:
    """All that is said of each concept: names, branch with colour, relatives, and a path for each parent, by labels."""
    e = edges(concepts)
    branch = hierarchy.branch_of(e, roots(concepts, known))
    labels = concepts.select(F.col("iri").alias("step"), F.coalesce("label", iri_hash(F.col("iri"))).alias("name"))
    steps = hierarchy.paths(e, first_parent=False).select("iri", F.col("path").alias("ids"), F.posexplode("path").alias("place", "step")).join(labels, "step")
    named = steps.groupBy("iri", "ids").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    paths = named.groupBy("iri").agg(F.array_sort(F.collect_list(F.array_join("names", " > "))).alias("hierarchy_paths"))
    own = F.coalesce("label", iri_hash(F.col("iri")))
    preferred = F.when(F.lower(F.coalesce("preferred_label", F.lit(""))) != F.lower(F.coalesce("label", F.lit(""))), F.nullif(F.col("preferred_label"), F.lit("")))
    base = concepts.select("iri", iri_hash(F.col("iri")).alias("iri_hash"), own.alias("label"), "definition", preferred.alias("preferred_label"), F.col("alternatives").alias("synonyms"), "examples", F.coalesce("deprecated", F.lit(False)).alias("deprecated"))
    met = base.join(branch, "iri", "left").join(_near(concepts, e), "iri").join(paths, "iri", "left")
    met = met.withColumn("branch", F.coalesce("branch", F.lit("Unknown"))).withColumn("branch_color", color(F.col("branch")))
    return _with_siblings(met.withColumn("hierarchy_paths", F.coalesce("hierarchy_paths", F.array(F.col("label")))), concepts, e)


def typed(concepts: DataFrame) -> DataFrame:
    """Concepts as plain rows: empty texts are null, lists empty; a preferred label stays only if it differs from the label in more than case."""
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    some = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    preferred = F.when(F.lower("preferred_label") != F.lower(F.coalesce("label", F.lit(""))), F.nullif(F.col("preferred_label"), F.lit(""))).alias("preferred_label")
    return concepts.select("iri", iri_hash(F.col("iri")).alias("iri_hash"), blank("label"), preferred, blank("definition"), some("alternatives"), some("examples"), F.slice(some("parents"), 1, 1).alias("first_parent"))


def lookup(concepts: DataFrame, keys: list[str], most: int = BATCH) -> DataFrame:
    """Concepts by the last part of their iri; unknown keys give no row. All keys are answered: those of more than a batch of ``most`` by a join in place of a list in the plan."""
    asked = list(dict.fromkeys(keys))
    if len(asked) <= most:
        return concepts.filter(iri_hash(F.col("iri")).isin(*asked)) if asked else concepts.limit(0)
    named = concepts.sparkSession.createDataFrame([(k,) for k in asked], "asked string")
    return concepts.join(named, iri_hash(F.col("iri")) == F.col("asked"), "left_semi")


def by_label(concepts: DataFrame, text: str, prefix: bool = False) -> DataFrame:
    """Concepts whose label is the text, or begins with it, ignoring case."""
    low = F.lower("label")
    return concepts.filter(F.startswith(low, F.lit(text.lower())) if prefix else low == text.lower())


def branch_counts(concepts: DataFrame, known: DataFrame, excluded: tuple[str, ...] = EXCLUDED_BRANCHES) -> DataFrame:
    """(branch, color, n_concepts) of branches that aren't left out."""
    found = concepts.select("iri").join(hierarchy.branch_of(edges(concepts), roots(concepts, known)), "iri", "left").withColumn("branch", F.coalesce("branch", F.lit("Unknown")))
    return found.filter(~F.col("branch").isin(*excluded)).groupBy("branch").agg(F.count(F.lit(1)).alias("n_concepts")).select("branch", color(F.col("branch")).alias("color"), "n_concepts")
