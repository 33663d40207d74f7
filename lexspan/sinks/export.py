"""Annotations in the formats that other tools read: projections first, then Spark's writers.

``annotations`` has one row for each annotation and concept: doc_id, ann_id, start, end, text, iri, label,
branch, confidence, state. Rejected ones are left out unless asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.functions.text import escape_markup
from lexspan.operators.intervals import containment_join

FIELDS = ("doc_id", "ann_id", "start", "end", "text", "iri", "label", "branch", "confidence", "state")


def shown(annotations: DataFrame, include_dismissed: bool = False) -> DataFrame:
    return annotations if include_dismissed else annotations.filter("state <> 'rejected'")


def csv_rows(a: DataFrame) -> DataFrame:
    return a.select("doc_id", "ann_id", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "text", "iri", "label", "branch", F.format_string("%.4f", "confidence").alias("confidence"), "state")


def json_lines(a: DataFrame) -> DataFrame:
    return a.select("doc_id", "ann_id", F.to_json(F.struct(*FIELDS)).alias("line"))


def json_ld(a: DataFrame) -> DataFrame:
    body = F.struct(
        F.lit("http://www.w3.org/ns/anno.jsonld").alias("@context"),
        F.concat(F.lit("urn:annotation:"), "ann_id").alias("id"),
        F.lit("Annotation").alias("type"),
        F.struct(F.col("iri").alias("source"), F.lit("classifying").alias("purpose")).alias("body"),
        F.struct(F.col("doc_id").cast("string").alias("source"), F.struct(F.lit("TextPositionSelector").alias("type"), "start", "end").alias("selector")).alias("target"),
    )
    return a.select("doc_id", "ann_id", F.to_json(body).alias("line"))


def bulk_lines(a: DataFrame, index: str = "annotations") -> DataFrame:
    """A search index's bulk format: an action and a document."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col("ann_id").alias("_id")).alias("index")))
    return a.select("doc_id", "ann_id", F.concat_ws("\n", action, F.to_json(F.struct(*FIELDS))).alias("line"))


def document_nodes(ids: DataFrame) -> DataFrame:
    """(id, kind, label) of distinct documents (doc_id)."""
    return ids.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.lit("Document").alias("kind"), F.col("doc_id").cast("string").alias("label"))


def concept_nodes(a: DataFrame) -> DataFrame:
    """(id, kind, label) of the concepts of annotations. Rows alike are put together by hash before labels are compared, which sorts."""
    return a.select("iri", "label").distinct().groupBy("iri").agg(F.min("label").alias("label")).select(F.col("iri").alias("id"), F.lit("Concept").alias("kind"), "label")


def contained(a: DataFrame) -> DataFrame:
    """(source, relation, target), each once: the concepts of each document."""
    each = a.select("doc_id", "iri").distinct()
    return each.select(F.concat(F.lit("doc:"), "doc_id").alias("source"), F.lit("CONTAINS_CONCEPT").alias("relation"), F.col("iri").alias("target"))


def graph(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label), each once, and relations (source, relation, target) whose ends exist."""
    nodes = document_nodes(a.select("doc_id").distinct()).unionByName(concept_nodes(a))
    return nodes, contained(a).join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def turtle(a: DataFrame) -> DataFrame:
    """(subject, predicate, object) and the Turtle line, for each annotation's type, body, target and confidence."""
    subject = F.concat(F.lit("<urn:annotation:"), "ann_id", F.lit(">"))
    facts = F.array(
        F.struct(F.lit("rdf:type").alias("p"), F.lit("oa:Annotation").alias("o")),
        F.struct(F.lit("oa:hasBody").alias("p"), F.concat(F.lit("<"), "iri", F.lit(">")).alias("o")),
        F.struct(F.lit("oa:hasTarget").alias("p"), F.concat(F.lit("<urn:document:"), "doc_id", F.lit("#char="), "start", F.lit(","), "end", F.lit(">")).alias("o")),
        F.struct(F.lit("ex:confidence").alias("p"), F.format_string("\"%.4f\"^^xsd:decimal", "confidence").alias("o")),
    )
    rows = a.select("doc_id", "ann_id", subject.alias("subject"), F.explode(facts).alias("f"))
    return rows.select("doc_id", "ann_id", "subject", F.col("f.p").alias("predicate"), F.col("f.o").alias("object"), F.concat_ws(" ", "subject", "f.p", "f.o", F.lit(".")).alias("line"))


def standoff(a: DataFrame) -> DataFrame:
    """Text-bound standoff lines, numbered by document in order."""
    w = W.partitionBy("doc_id").orderBy("start", "end", "iri", "ann_id")
    kind = F.regexp_replace(F.coalesce("branch", F.lit("Concept")), "[^A-Za-z0-9]", "_")
    n = F.row_number().over(w)
    return a.select("doc_id", "ann_id", F.concat(F.lit("T"), n, F.lit("\t"), kind, F.lit(" "), "start", F.lit(" "), "end", F.lit("\t"), F.regexp_replace("text", r"\s+", " ")).alias("line"))


def highlighted(docs: DataFrame, a: DataFrame) -> DataFrame:
    """Documents as HTML, annotated stretches marked: the text is cut at all borders first, then each piece escaped."""
    tier = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.6, "mid").when(F.col("confidence") >= 0.45, "low").otherwise("faint")
    spans = a.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", tier.alias("tier")))).alias("spans"))
    borders = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length("text")), F.transform("spans", lambda s: s["start"]), F.transform("spans", lambda s: s["end"]))))
    met = docs.join(spans, "doc_id").withColumn("borders", borders)
    piece = lambda x, i: F.substring(F.col("text"), x + 1, F.get("borders", i + 1) - x)
    mark = lambda x, i: F.get(F.filter("spans", lambda s: (s["start"] <= x) & (s["end"] >= F.get(F.col("borders"), i + 1))), F.lit(0))["tier"]
    one = lambda x, i: F.when(mark(x, i).isNull(), escape_markup(piece(x, i))).otherwise(F.concat(F.lit('<mark class="'), mark(x, i), F.lit('">'), escape_markup(piece(x, i)), F.lit("</mark>")))
    return met.select("doc_id", F.array_join(F.transform(F.slice("borders", 1, F.size("borders") - 1), one), "").alias("html"))


def rag_chunks(chunks: DataFrame, a: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, start, end) with the annotations that lie wholly in them."""
    inside = containment_join(a.select("doc_id", "start", "end", "iri", "label"), chunks.select("doc_id", "start", "end", "chunk_index"))
    held = inside.groupBy("doc_id", F.col("b_chunk_index").alias("chunk_index")).agg(F.array_sort(F.collect_list(F.struct(F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("a_iri").alias("iri")))).alias("entities"))
    return chunks.join(held, ["doc_id", "chunk_index"], "left").withColumn("n_entities", F.coalesce(F.size("entities"), F.lit(0)))


def statistics(a: DataFrame) -> DataFrame:
    """Per document: annotations, distinct concepts, and counts by state and confidence."""
    return a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_annotations"), F.countDistinct("iri").alias("n_concepts"), F.count_if(F.col("state") == "confirmed").alias("n_confirmed"), F.count_if(F.col("state") == "rejected").alias("n_rejected"), F.count_if(F.col("confidence") >= 0.8).alias("n_high"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def feedback_rows(f: DataFrame) -> DataFrame:
    """Feedback with its lineage as JSON in a cell."""
    return f.select("id", "rating", "stage", "comment", "iri", "label", F.to_json("lineage").alias("lineage"), "created_at")


def job_json(a: DataFrame) -> DataFrame:
    """One object per document: its annotations in order and their statistics; fields that are null are left out."""
    each = a.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ann_id", "text", "iri", "label", "branch", "confidence", "state"))).alias("annotations"))  # one document's
    return each.join(statistics(a), "doc_id").select("doc_id", F.to_json(F.struct("doc_id", "annotations", F.struct("n_annotations", "n_concepts", "n_confirmed", "n_rejected", "n_high", "mean_confidence").alias("statistics"))).alias("line"))


def _text(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], None]:
    return lambda a, path: f(a).select("line").write.text(path)


#: Writers by format: each takes annotations and a path.
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "csv": lambda a, path: csv_rows(a).write.option("header", True).csv(path),
    "json": _text(job_json),
    "jsonl": _text(json_lines),
    "jsonld": _text(json_ld),
    "parquet": lambda a, path: a.select(*FIELDS).write.parquet(path),
    "xml": lambda a, path: a.select(*FIELDS).write.format("xml").option("rowTag", "annotation").option("rootTag", "annotations").save(path),
    "elasticsearch": _text(bulk_lines),
    "neo4j": lambda a, path: [x.write.json(f"{path}/{n}") for n, x in zip(("nodes", "relations"), graph(a), strict=True)],
    "rdf": _text(turtle),
    "brat": _text(standoff),
}

#: Writers that need the documents or their chunks as well.
TEXT_WRITERS: dict[str, Callable[[DataFrame, DataFrame, str], None]] = {
    "html": lambda a, docs, path: highlighted(docs, a).write.parquet(path),
    "rag": lambda a, chunks, path: rag_chunks(chunks, a).write.json(path),
}


def register(name: str, write: Callable[[DataFrame, str], None]) -> None:
    WRITERS[name] = write


def export(annotations: DataFrame, name: str, path: str, include_dismissed: bool = False) -> None:
    if name not in WRITERS:
        raise KeyError(f"no writer for {name}; there are {', '.join(sorted(WRITERS))}")
    WRITERS[name](shown(annotations, include_dismissed), path)
