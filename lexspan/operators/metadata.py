"""What a document's annotations say about it: context lists, promoted fields, type labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.functions.constants import DOCUMENT_TYPES, FAMILIES, FIELD_CUES
from lexspan.functions.text import lookback

def promoted(annotations: DataFrame, docs: DataFrame, cues: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, field, value): each annotation, in order, fills at most one field, the first still empty whose cue stands before it."""
    cues = cues or FIELD_CUES
    before = annotations.join(docs.select("doc_id", F.col("text").alias("full")), "doc_id").withColumn("cue", lookback(F.col("full"), F.col("start"))).drop("full")
    fits = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(c) for c in found]), lambda c: F.contains(F.col("cue"), c)), F.lit(i)) for i, found in enumerate(cues.values())]))
    rows = before.withColumn("fits", fits).filter(F.size("fits") > 0)
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", "fits"))).alias("a"))  # one document's annotations
    zero = F.expr("CAST(map() AS map<int,string>)")
    step = lambda m, a: F.coalesce(F.when(F.size(F.filter(a["fits"], lambda i: ~F.map_contains_key(m, i))) > 0, F.map_concat(m, F.create_map(F.get(F.filter(a["fits"], lambda i: ~F.map_contains_key(m, i)), F.lit(0)), a["text"]))), m)
    names = F.array(*[F.lit(x) for x in cues])
    return ordered.select("doc_id", F.explode(F.aggregate("a", zero, step)).alias("i", "value")).select("doc_id", F.get(names, F.col("i")).alias("field"), "value")


def type_label(links: Column, branch: Column, source: Column, families: dict[str, list[str]] | None = None) -> Column:
    """The first family whose keyword a class link's label holds, links in order; else the branch, else the source."""
    none = F.lit(None).cast("string")

    def family(link: Column) -> Column:
        return F.coalesce(*[F.when(F.lower(link).rlike("|".join(keys)), name) for name, keys in (families or FAMILIES).items()], none)

    hits = F.filter(F.transform(links, family), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.when(branch != "", branch), source)


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equal counts the one seen first by ``order``."""
    each = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    w = W.partitionBy(*keys).orderBy(F.col("n").desc(), "seen")
    return each.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select(*keys, value, "n")


#: How many of each go into a document's context, and what confidence counts as high.
NAMES, WEAK, TRIPLES, CONCEPTS, WEAK_CONCEPTS, HIGH = 20, 20, 30, 20, 15, 0.80


def entities_by_type(individuals: DataFrame) -> DataFrame:
    """(doc_id, type, names): distinct names of confident individuals (doc_id, name, type, confidence, start) by type, in order of place; a name counts where it stands first."""
    w = W.partitionBy("doc_id", "name").orderBy("start", "type")
    first = individuals.withColumn("rank", F.row_number().over(w)).filter("rank = 1").filter(F.col("confidence") >= HIGH)
    return first.groupBy("doc_id", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]).alias("names"))


def weak_entities(individuals: DataFrame) -> DataFrame:
    """(doc_id, name, type, confidence) of the others, the confidence to two places."""
    w = W.partitionBy("doc_id", "name").orderBy("start", "type")
    first = individuals.withColumn("rank", F.row_number().over(w)).filter("rank = 1").filter(F.col("confidence") < HIGH)
    return first.select("doc_id", "name", "type", F.round("confidence", 2).alias("confidence"))


def top_labels(concepts: DataFrame, most: int = CONCEPTS) -> DataFrame:
    """(doc_id, labels): the first distinct labels of confident concepts (doc_id, label, confidence, place), at most ``most``."""
    first = concepts.filter((F.col("confidence") >= HIGH) & (F.col("label") != "")).groupBy("doc_id", "label").agg(F.min("place").alias("place"))
    return first.groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), 1, most).alias("labels"))


def histogram(annotations: DataFrame, top: int = 30) -> DataFrame:
    """A report of the ``top`` concepts as ``label [branch]`` with their counts and the first sixty characters of a definition, the first by iri."""
    each = annotations.groupBy("label", "branch").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.left("definition", F.lit(60)), "iri").alias("definition"))
    return each.select(F.concat("label", F.lit(" ["), "branch", F.lit("]")).alias("concept"), "n", "definition").orderBy(F.col("n").desc(), "concept").limit(top)


def top_counts(annotations: DataFrame, column: str, top: int) -> DataFrame:
    """A report of the most frequent values of a column."""
    return annotations.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(top)


def page_count(elements: DataFrame) -> DataFrame:
    """(doc_id, n_pages) of elements (doc_id, page) whose pages count from 0; without pages null."""
    return elements.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))


def areas(answers: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, area, confidence, rank): areas that a model names with enough confidence, the best first."""
    w = W.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "area")
    return answers.filter(F.col("confidence") >= least).withColumn("rank", F.row_number().over(w))


def catalogued(types: DataFrame, catalogue: dict[str, list[str]] = DOCUMENT_TYPES) -> DataFrame:
    """(doc_id, document_type, field) of documents (doc_id, document_type): the type as the catalogue writes it, and its field; null for one that isn't there."""
    known = F.create_map(*[F.lit(x) for f, ts in catalogue.items() for t in ts for x in (t.lower(), f"{f}|{t}")])
    met = types.withColumn("found", F.split(known[F.lower(F.btrim("document_type"))], r"\|"))
    return met.select("doc_id", F.get("found", F.lit(1)).alias("document_type"), F.get("found", F.lit(0)).alias("field"))


def context_block(c: DataFrame) -> DataFrame:
    """(doc_id, block): what a model is told of a document, from (doc_id, entities map<string,array<string>>, weak array<struct<name,type,confidence>>, relations, concepts array<string>, and perhaps areas array<struct<area,confidence>>, header, footer string); empty parts are left out."""
    part = lambda title, lines: F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n")))
    named = F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    weak = F.transform(F.slice("weak", 1, WEAK), lambda w: F.format_string('  "%s" (%s, %.2f)', w["name"], w["type"], w["confidence"]))
    relations = F.transform(F.slice("relations", 1, TRIPLES), lambda r: F.concat(F.lit("  "), r))
    concepts = F.when(F.size("concepts") > 0, F.concat(F.lit("CONCEPTS:\n  "), F.array_join(F.slice("concepts", 1, CONCEPTS), ", ")))
    more = []
    if "areas" in c.columns:
        more.append(part("AREAS OF LAW:", F.transform("areas", lambda a: F.concat(F.lit("  "), a["area"], F.lit(" ("), F.round(a["confidence"] * 100).cast("int").cast("string"), F.lit("%)")))))
    for name, title in (("header", "HOW IT BEGINS:"), ("footer", "HOW IT ENDS:")):
        if name in c.columns:
            more.append(F.when(F.col(name) != "", F.concat(F.lit(f"{title}\n"), name)))
    return c.select("doc_id", F.concat_ws("\n\n", part("NAMED ENTITIES:", named), part("ENTITIES IN DOUBT:", weak), part("RELATIONSHIPS:", relations), concepts, *more).alias("block"))
