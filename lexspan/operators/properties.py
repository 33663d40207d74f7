"""Properties of an ontology: labels indexed, matched in texts, merged with other finds, and looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.functions.constants import PROPERTY_STOP
from lexspan.functions.text import split_camel, strip_namespace
from lexspan.operators import lexicon, overlap
from lexspan.operators.confidence import property_confidence


def clean(props: DataFrame, prefixes: list[str]) -> DataFrame:
    """``props`` (iri, label, alternatives array<string>, ...) with ``clean_label`` and ``clean_alternatives``: without namespace, camel case as words; deprecated ones left out."""
    kept = props.filter(~F.contains("label", F.lit("DEPRECATED")) & ~F.startswith("label", F.lit("ZZZ:")))
    plain = lambda c: split_camel(strip_namespace(c, prefixes))
    return kept.withColumn("clean_label", plain(F.col("label"))).withColumn("clean_alternatives", F.filter(F.transform(F.coalesce("alternatives", F.array().cast("array<string>")), plain), lambda x: x != ""))


def index(props: DataFrame, prefixes: list[str], lemmas: DataFrame | None = None) -> DataFrame:
    """(label_key, iri, match_type): each admitted label's property, a preferred label before an alternative one, of equal ones the last iri.

    ``lemmas`` (label_key, lemma) are base forms: one stands for its one-word label of more than three letters unless it is a label itself.
    """
    c = clean(props, prefixes)
    every = c.select("iri", F.col("clean_label").alias("label_key"), F.lit("preferred").alias("match_type")).unionByName(c.select("iri", F.explode("clean_alternatives").alias("label_key"), F.lit("alternative").alias("match_type")))
    w = W.partitionBy("label_key").orderBy(lexicon.precedence(F.col("match_type")), F.col("iri").desc())
    admitted = every.filter((F.length("label_key") > 2) & ~F.col("label_key").isin(*PROPERTY_STOP))
    found = admitted.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select("label_key", "iri", "match_type")
    if lemmas is None:
        return found
    single = found.filter(~F.contains("label_key", F.lit(" ")) & (F.length("label_key") > 3)).join(lemmas, "label_key")
    new = single.filter((F.col("lemma") != F.col("label_key")) & (F.length("lemma") > 2) & ~F.col("lemma").isin(*PROPERTY_STOP))
    new = new.join(found.select(F.col("label_key").alias("lemma")), "lemma", "left_anti")
    first = new.groupBy("lemma").agg(F.min_by("iri", "label_key").alias("iri"))
    return found.unionByName(first.select(F.col("lemma").alias("label_key"), "iri", F.lit("lemma").alias("match_type")))


def match(docs: DataFrame, labels: DataFrame, resolve: bool = True) -> DataFrame:
    """(doc_id, start, end, text, iri, match_type, confidence, source) of an ``index``'s labels in texts, overlaps resolved."""
    found = lexicon.match(docs, labels, resolve=resolve)
    return found.select("doc_id", "start", "end", F.col("surface").alias("text"), "iri", "match_type", property_confidence(F.col("match_type"), F.col("label_key")).alias("confidence"), F.lit("automaton").alias("source"))


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """Finds of two sources as one: of equal spans the more confident, of two that cross the longer, contained ones both."""
    return overlap.resolve(found.unionByName(more, allowMissingColumns=True), "confidence")


def with_ends(found: DataFrame, model: DataFrame) -> DataFrame:
    """Properties (doc_id, start, end, ..., lineage array<string>) whose place a model has named a domain or range for: that goes to the lineage."""
    said = model.groupBy("doc_id", "start", "end").agg(F.min("domain").alias("domain"), F.min("range").alias("range"))
    note = F.concat(F.lit("model: "), F.coalesce("domain", F.lit("?")), F.lit(" -> "), F.coalesce("range", F.lit("?")))
    met = found.join(said, ["doc_id", "start", "end"], "left")
    hit = F.col("domain").isNotNull() | F.col("range").isNotNull()
    return met.withColumn("lineage", F.when(hit, F.concat("lineage", F.array(note))).otherwise(F.col("lineage"))).drop("domain", "range")


def lookup(props: DataFrame, iris: DataFrame) -> DataFrame:
    """Properties by iri; unknown ones give no row."""
    return props.join(iris.select("iri").distinct(), "iri", "left_semi")
