"""The stages of annotation as plans: each takes tables and gives tables, and composes operators.

Models are functions that are passed in; every stage that asks one also works on a table of its answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.functions.constants import EXCLUDED_BRANCHES, PATTERN_STOP, PHRASE_STOP
from lexspan.operators import confidence, extract, lexicon, metadata, models, overlap, properties, search, vectors
from lexspan.operators.intervals import containment_join
from lexspan.sources import ontology
from lexspan.staging import discard, staged


def model_concepts(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, text, iri, confidence, state, lineage): where a document says what a model named (doc_id, text, iri, confidence, ord).

    Of one text in any case the most confident naming counts, the earliest of equals; each document is searched for its own alone.
    """
    best = answers.groupBy("doc_id", F.lower("text").alias("label_key")).agg(F.max_by(F.struct("iri", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b"))
    own = lexicon.match_own(docs, best.select("doc_id", "label_key", "b.iri", "b.confidence")).withColumnRenamed("surface", "text").drop("label_key")
    return own.withColumn("state", F.lit("preliminary")).withColumn("lineage", F.array(F.lit("model: named")))


def early_individuals(docs: DataFrame, labels: DataFrame, recognised: DataFrame | None = None) -> DataFrame:
    """Individuals of texts: citations, what patterns find, and recognised spans (doc_id, start, end, text, tag), merged, with the iri of each class link.

    ``labels`` are (label, iri, branch); links become array<struct<label, iri>>.
    """
    names, more = [n for n in extract.EXTRACTORS if n != "citation"], None
    if recognised is not None:
        rows, more = extract.as_individuals(extract.entities(recognised), F.lit("ner"), F.col("class")), "more"
        docs = docs.join(extract.gathered(rows), "doc_id", "left")
    found = extract.found_individuals(docs, names, more=more, cited=True)
    return linked(found, labels)


def linked(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Individuals whose ``links`` are labels, with the iri of each label that is known, ignoring case; their order stays."""
    known = labels.groupBy(F.lower("label").alias("key")).agg(F.min("iri").alias("iri"))
    found = staged(found, "individuals")  # read twice: for the lists of links that there are, and for the rows
    each = found.select("links").distinct().select("links", F.posexplode("links").alias("place", "label")).withColumn("key", F.lower("label")).join(known, "key", "left")
    named = each.groupBy("links").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "iri"))), lambda x: F.struct(x["label"].alias("label"), x["iri"].alias("iri"))).alias("named"))
    return found.join(named, "links", "left").select(*[c for c in found.columns if c != "links"], F.col("named").alias("links"))


def model_individuals(existing: DataFrame, answers: DataFrame, chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """Individuals merged with what a model named in chunks: (doc_id, chunk_index, name, mention, class_label, confidence).

    A name or mention that an individual within the chunk has adds the class to it; another mention is looked for in the chunk's text
    (doc_id, chunk_index, text, chunk_start), and becomes an individual where it stands. ``existing`` is as ``extract.individuals`` takes it.
    """
    placed = models.in_chunk(answers.join(chunks, ["doc_id", "chunk_index"]))
    inside = chunks.select("doc_id", "chunk_index", F.col("chunk_start").alias("cs"), (F.col("chunk_start") + F.length("text")).alias("ce"))
    asked = answers.join(inside, ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", F.lower("name").alias("n"), F.lower("mention").alias("m"), "class_label", "cs", "ce")
    made: list[str] = []
    e = staged(existing.withColumn("row", F.xxhash64("doc_id", "start", "end", "name")), "existing", made)  # read three times, found once
    met = e.join(asked, "doc_id").filter((F.col("end") > F.col("cs")) & (F.col("start") < F.col("ce")) & ((F.lower("name") == F.col("n")) | (F.lower("mention") == F.col("m"))))
    more = met.groupBy("row").agg(F.array_sort(F.collect_set("class_label")).alias("more"))
    old = e.join(more, "row", "left").withColumn("links", F.array_distinct(F.concat("links", F.coalesce("more", F.array().cast("array<string>"))))).drop("row", "more")
    used = met.select("doc_id", "chunk_index", "n", "m").distinct()
    new = placed.withColumn("n", F.lower("name")).withColumn("m", F.lower("mention")).join(used, ["doc_id", "chunk_index", "n", "m"], "left_anti")
    new = new.select("doc_id", "name", "mention", F.col("start").cast("int"), F.col("end").cast("int"), F.lit("model").alias("source"), F.array("class_label").alias("links"))
    whole = linked(extract.individuals(old.unionByName(new, allowMissingColumns=True)), labels)
    discard(existing.sparkSession, made)
    return whole


def early_properties(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Properties of texts, overlaps merged."""
    return overlap.resolve(properties.match(docs, index), "confidence")


def model_properties(existing: DataFrame, answers: DataFrame, pos: DataFrame) -> DataFrame:
    """Properties merged with a model's finds (doc_id, start, end, text, iri, confidence), then lowered where one word is a noun by ``pos`` (doc_id, start, end, pos)."""
    found = properties.merged(existing, answers.withColumn("match_type", F.lit("model")).withColumn("source", F.lit("model")))
    return confidence.property_penalty(found.join(pos, ["doc_id", "start", "end"], "left"))


def resolution(reconciled: DataFrame, ruler: DataFrame, model: DataFrame, concepts: DataFrame, excluded: tuple[str, ...] = EXCLUDED_BRANCHES) -> DataFrame:
    """Concepts (doc_id, text, iri, label, branches, confidence, source, backups) of each document's reconciled rows (doc_id, text, iri, confidence).

    A document without any takes the ruler's rows, then the model's whose text, in any case, the ruler doesn't have. Rows without an
    answer, or with one of an excluded branch, are left out; branches that stand for others are replaced.
    """
    none = ruler.select("doc_id").union(model.select("doc_id")).distinct().join(reconciled.select("doc_id").distinct(), "doc_id", "left_anti")
    of = lambda df, name: df.select("doc_id", "text", "iri", "confidence", F.lit(name).alias("source"))
    alone = of(ruler, "entity_ruler").join(none, "doc_id", "left_semi")
    low = F.lower("text").alias("low")
    more = of(model, "llm").join(none, "doc_id", "left_semi").withColumn("low", F.lower("text")).join(alone.select("doc_id", low).distinct(), ["doc_id", "low"], "left_anti").drop("low")
    rows = of(reconciled, "reconciled").unionByName(alone).unionByName(more)
    asked = rows.select("text", "iri", "confidence").distinct()  # each question is answered once
    answer = search.resolve(asked, concepts, excluded=excluded).filter("iri IS NOT NULL")
    keyed = rows.select("doc_id", "text", F.coalesce("iri", F.lit("")).alias("asked_iri"), F.col("confidence").alias("asked_confidence"), "source")
    out = keyed.join(answer, ["text", "asked_iri", "asked_confidence"]).drop("asked_iri", "asked_confidence")
    branch = F.when(F.col("branch").isNotNull(), F.array("branch")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("branches", ontology.actual_branches(branch)).drop("branch")


#: What a resolved row says, beside its document: empty texts and lists are null.
RESOLVED = ["text", "iri", "label", "definition", "confidence", "source", "branch_color", "hierarchy_path", "iri_hash", "notes", "editorial_note", "comment", "description", "history_note", "country"]
RESOLVED_LISTS = ["branches", "examples", "see_also", "alternatives", "translations"]


def resolved_rows(resolved: DataFrame, concepts: DataFrame) -> DataFrame:
    """Resolved rows with what the ontology says of their concepts, in one fixed set of columns, confirmed."""
    said = resolved.join(concepts.drop(*[c for c in resolved.columns if c != "iri"]), "iri", "left").withColumn("iri_hash", T.iri_hash(F.col("iri")))
    text = lambda c: (F.nullif(F.col(c), F.lit("")) if c in said.columns and said.schema[c].dataType.typeName() == "string" else F.col(c) if c in said.columns else F.lit(None).cast("string")).alias(c)
    some = lambda c: (F.when(F.size(c) > 0, F.col(c)) if c in said.columns else F.lit(None).cast("array<string>")).alias(c)
    deprecated = F.when(F.col("deprecated"), F.lit(True)).alias("deprecated") if "deprecated" in said.columns else F.lit(None).cast("boolean").alias("deprecated")
    return said.select("doc_id", *map(text, RESOLVED), *map(some, RESOLVED_LISTS), deprecated, F.lit("confirmed").alias("state"))


def in_context(resolved: DataFrame, docs: DataFrame, embed=models.hashed_embedding) -> DataFrame:
    """Resolved rows (doc_id, text, definition, confidence) blended with how near the text's first sentence around them is to their definition."""
    whole = resolved.join(docs.select("doc_id", F.col("text").alias("full")), "doc_id", "left")
    at = F.call_function("locate", F.lower("text"), F.lower("full"))
    before = F.substring("full", F.lit(1), at - 1)
    start = F.length(before) - F.length(F.substring_index(before, ".", -1))
    after = F.substring(F.col("full"), start + 1, F.length("full"))
    length = F.call_function("locate", F.lit("."), after, at - start + F.length("text"))
    sentence = F.when(at > 0, F.btrim(F.when(length > 0, F.substring(after, F.lit(1), length)).otherwise(after))).otherwise(F.col("text"))
    rows = whole.withColumn("sentence", sentence).drop("full")
    texts = rows.select(F.col("sentence").alias("said")).union(rows.select("definition")).filter("said IS NOT NULL").distinct()
    vectors = models.embedded(texts.withColumn("key", F.col("said")), "said", "key", embed)
    side = lambda n, v: vectors.select(F.col("key").alias(n), F.col("embedding").alias(v))
    met = rows.join(side("sentence", "a"), "sentence", "left").join(side("definition", "b"), "definition", "left")
    near = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return confidence.in_context(met.withColumn("near", near), "near").drop("a", "b", "near")


def phrases(docs: DataFrame, known: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(doc_id, start, end, phrase): runs of two to four words of a text that begin or end in no known span (doc_id, start, end) and aren't all common words.

    Runs are of words apart by one space; their places are the text's.
    """
    each = docs.select("doc_id", F.col("text"), F.split("text", " ").alias("w"))
    starts = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice("w", F.lit(1), i), " ")) + 1))
    runs = None
    for n in range(low, high + 1):
        run = each.filter(F.size("w") >= n).select("doc_id", "w", F.posexplode(F.slice(starts, F.lit(1), F.size("w") - n + 1)).alias("i", "start")).select("doc_id", "start", F.array_join(F.slice("w", F.col("i") + 1, F.lit(n)), " ").alias("phrase"), F.slice("w", F.col("i") + 1, F.lit(n)).alias("parts"))
        runs = run if runs is None else runs.unionByName(run)
    stop = [*PATTERN_STOP, *PHRASE_STOP]
    some = runs.filter(F.exists("parts", lambda w: (w != "") & ~F.lower(w).isin(stop))).select("doc_id", F.col("start").cast("int"), (F.col("start") + F.length("phrase")).cast("int").alias("end"), "phrase")
    # a run is out if its first character lies in a known span, or its last
    first = some.select("doc_id", F.col("start"), (F.col("start") + 1).alias("end"), F.col("end").alias("stop"))
    last = some.select("doc_id", (F.col("end") - 1).alias("start"), "end", F.col("start").alias("from"))
    boxes = known.select("doc_id", "start", "end").distinct()
    hit_first = containment_join(first, boxes).select("doc_id", F.col("a_start").alias("start"), F.col("a_stop").alias("end"))
    hit_last = containment_join(last, boxes).select("doc_id", F.col("a_from").alias("start"), F.col("a_end").alias("end"))
    return some.join(hit_first.union(hit_last).distinct(), ["doc_id", "start", "end"], "left_anti")


def semantic_matches(found: DataFrame, labels: DataFrame, embed=models.hashed_embedding, least: float = 0.80) -> DataFrame:
    """(doc_id, start, end, phrase, iri, similarity): phrases whose nearest label (label, iri) is at least that near; of equally near ones the first by iri.

    Distinct phrases are embedded once and compared with the labels' codes; what a code's distance can't rule out is compared by its vector.
    """
    known = models.embedded(labels.select("iri", "label"), "label", "iri", embed).withColumnRenamed("iri", "vec_id")
    asked = found.select("phrase").distinct()
    queries = models.embedded(asked.withColumn("text", F.col("phrase")), "text", "phrase", embed).withColumnRenamed("phrase", "query_id")
    best = vectors.Codes.fit(known).nearest_within(queries, least)
    return found.join(best.withColumnRenamed("query_id", "phrase").withColumnRenamed("vec_id", "iri"), "phrase").select("doc_id", "start", "end", "phrase", "iri", "similarity")


def document_metadata(docs: DataFrame, answers: DataFrame, individuals: DataFrame, spans: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, document_type, confidence, fields map<string,string>, entities map<string,array<string>>).

    The type is that of ``known`` (doc_id, document_type, confidence) where there is one, else a model's answer (doc_id, answer, error); fields are
    promoted from spans (doc_id, start, end, text) by the cues before them; entities are the confident individuals by type.
    """
    said = models.document_type(answers).select("doc_id", "document_type", "confidence")
    if known is not None:
        said = known.select("doc_id", "document_type", "confidence").unionByName(said.join(known, "doc_id", "left_anti"))
    fields = metadata.promoted(spans, docs).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    entities = metadata.entities_by_type(individuals).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "names")))).alias("entities"))
    return docs.select("doc_id").join(said, "doc_id", "left").join(fields, "doc_id", "left").join(entities, "doc_id", "left")



#: Characters of a text's beginning and end that a model is shown.
HEADER, FOOTER = 1000, 500


def document_context(docs: DataFrame, individuals: DataFrame, relations: DataFrame, concepts: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, block): what a model is told of each document (doc_id, text): its individuals (doc_id, name, type, confidence, start), certain and in doubt, triples (doc_id, place,
    subject, predicate, object), concepts (doc_id, label, confidence, place), areas of law (doc_id, area, confidence), and how its text begins and, if it is longer than that, ends.

    Each part is aggregated by document and joined; what a document lacks is left out of its block.
    """
    gathered = lambda df, name, x: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(x)).alias(name))
    entities = metadata.entities_by_type(individuals).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "names")))).alias("entities"))
    weak = gathered(metadata.weak_entities(individuals), "weak", F.struct("name", "type", "confidence"))
    said = relations.select("doc_id", "place", F.concat_ws(" ", F.nullif("subject", F.lit("")), "predicate", "object").alias("line"))
    related = said.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("relations"))
    ranked = metadata.areas(areas).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "area", "confidence"))), lambda x: F.struct(x["area"].alias("area"), x["confidence"].alias("confidence"))).alias("areas"))
    text = F.coalesce("text", F.lit(""))
    ends = docs.select("doc_id", F.left(text, F.lit(HEADER)).alias("header"), F.when(F.length(text) > HEADER, F.right(text, F.least(F.length(text) - HEADER, F.lit(FOOTER)))).alias("footer"))
    out = ends.join(entities, "doc_id", "left").join(weak, "doc_id", "left").join(related, "doc_id", "left").join(metadata.top_labels(concepts).withColumnRenamed("labels", "concepts"), "doc_id", "left").join(ranked, "doc_id", "left")
    out = out.withColumn("entities", F.coalesce("entities", F.create_map().cast("map<string,array<string>>"))).withColumn("weak", F.coalesce("weak", F.array().cast("array<struct<name:string,type:string,confidence:double>>")))
    return metadata.context_block(out)
