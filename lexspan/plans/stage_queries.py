"""The stages of annotation over whole tables, each with DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions import scoring, text
from lexspan.functions.constants import DOCUMENT_TYPES
from lexspan.operators import annotations as ann
from lexspan.operators import confidence, extract, feedback, hierarchy, metadata, models, overlap, properties, search, triples
from lexspan.plans import bindings as b
from lexspan.plans import stages
from lexspan.plans.registry import query
from lexspan.sinks import export

# Individuals, properties and triples by stages


@query()
def early_individuals(spark, sf):
    labels = spark.createDataFrame([("court", "urn:class/court", "b"), ("DATE", "urn:class/date", "b"), ("Statute", "urn:class/statute", "b")], "label string, iri string, branch string")
    docs = b.sentences(spark, sf)
    recognised = docs.filter("doc_id % 4 = 1").selectExpr("doc_id", "0 AS start", "8 AS end", "'Jane Doe' AS text", "'PERSON' AS tag")
    return stages.early_individuals(docs, labels, recognised)


#: A model's answers on one chunk a sentence: the court by name, in other words, and someone whom no pattern finds.
def _model_people(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = b.sentences(spark, sf)
    chunks = docs.selectExpr("doc_id", "0 AS chunk_index", "text", "0 AS chunk_start")
    said = F.array(F.struct(F.lit("united states district court").alias("name"), F.lit("that court").alias("mention"), F.lit("Tribunal").alias("class_label")), F.struct(F.lit("the buyer").alias("name"), F.lit("buyer").alias("mention"), F.lit("Person").alias("class_label")), F.struct(F.lit("nobody").alias("name"), F.lit("nobody").alias("mention"), F.lit("Person").alias("class_label")))
    answers = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.explode(said).alias("x"), F.lit(0.7).alias("confidence")).select("doc_id", "chunk_index", "x.*", "confidence")
    return docs, chunks, answers


@query(
    f"""SELECT o_orderkey AS doc_id, unnest({b.expected("court")}) AS mention, CASE WHEN o_orderkey % 4 = 0 THEN 'Court|Tribunal' ELSE 'Court' END AS links, 'regex' AS source FROM orders
UNION ALL SELECT o_orderkey, unnest({b.expected("date")}), 'Date', 'regex' FROM orders UNION ALL SELECT o_orderkey, 'buyer', 'Person', 'model' FROM orders WHERE o_orderkey % 4 = 0"""
)
def model_individuals(spark, sf):
    docs, chunks, answers = _model_people(spark, sf)
    existing = extract.found_individuals(docs, ["court", "date"]).drop("n_merged")
    labels = spark.createDataFrame([("x", "u")], "label string, iri string")
    found = stages.model_individuals(existing, answers, chunks, labels)
    return found.select("doc_id", "mention", F.array_join(F.transform("links", lambda x: x["label"]), "|").alias("links"), "source")


@query(
    """SELECT o_orderkey AS doc_id, x.text, x.match_type, x.confidence, x.source FROM orders, unnest([{'text': 'buyer', 'match_type': 'preferred', 'confidence': 0.73::DOUBLE, 'source': 'automaton', 'every': 4}, {'text': 'shall pay', 'match_type': 'preferred', 'confidence': 0.90, 'source': 'automaton', 'every': 4},
{'text': 'shall pay $', 'match_type': 'model', 'confidence': 0.95, 'source': 'model', 'every': 8}]) AS t(x) WHERE o_orderkey % x.every = 0"""
)
def model_properties(spark, sf):
    """The longer of two that contain each other and the shorter both stay; a model names the longer in some documents."""
    docs = b.sentences(spark, sf)
    index = spark.createDataFrame([("buyer", "urn:p/1", "preferred"), ("shall pay", "urn:p/2", "preferred")], "label_key string, iri string, match_type string")
    existing = stages.early_properties(docs, index)
    at = F.call_function("locate", F.lit("shall pay"), F.col("text")) - 1
    answers = docs.filter("doc_id % 8 = 0").select("doc_id", at.cast("int").alias("start"), (at + 11).cast("int").alias("end"), F.lit("shall pay $").alias("text"), F.lit("urn:p/2").alias("iri"), F.lit(0.95).alias("confidence"))
    pos = existing.select("doc_id", "start", "end", F.when(F.col("text") == "buyer", "NOUN").otherwise("VERB").alias("pos"))
    found = stages.model_properties(existing, answers, pos)
    return found.select("doc_id", "text", "match_type", "confidence", "source")


_TRIPLES = ["l_orderkey AS doc_id", "concat(l_orderkey, '-', l_linenumber) AS triple_id", "concat('Customer ', l_partkey % 7) AS subject", "CASE WHEN l_suppkey % 2 = 0 THEN 'was Paid By' ELSE 'sold' END AS predicate", "concat('Part ', l_partkey) AS object", "CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_linenumber * 45 AS INT) END AS subject_start", "CAST(l_linenumber * 45 + 20 AS INT) AS subject_end", "CAST(l_linenumber * 45 + 25 AS INT) AS object_start", "CAST(l_linenumber * 45 + 30 AS INT) AS object_end"]
_ONE_LINE = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)"


@query(
    f"""WITH {b.ANNOTATIONS_SQL}, t AS (SELECT {", ".join(x.replace("concat(l_orderkey", "concat(CAST(l_orderkey AS VARCHAR)") for x in _TRIPLES)} FROM {_ONE_LINE}),
people AS (SELECT l_orderkey AS doc_id, 'customer ' || (min(l_partkey) % 7) AS mention, 'i' || l_orderkey AS ind_id FROM lineitem GROUP BY l_orderkey), props AS (SELECT l_orderkey AS doc_id, 'paid by' AS text, 'urn:rel/' || (min(l_suppkey) % 3) AS iri FROM lineitem GROUP BY l_orderkey),
ends AS (SELECT doc_id, triple_id, 'subject' AS role, subject_start AS s, subject_end AS e FROM t WHERE subject_start IS NOT NULL UNION ALL SELECT doc_id, triple_id, 'object', object_start, object_end FROM t),
con AS (SELECT n.doc_id, triple_id, role, min_by(iri, (a."start", iri)) AS iri FROM ends n JOIN annotations a ON a.doc_id = n.doc_id AND s <= a."end" AND a."start" <= e WHERE state <> 'rejected' GROUP BY ALL)
SELECT t.doc_id, t.triple_id, cs.iri AS subject_concept, p1.ind_id AS subject_individual, co.iri AS object_concept, p2.ind_id AS object_individual, r.iri AS predicate_iri FROM t LEFT JOIN con cs ON cs.doc_id = t.doc_id AND cs.triple_id = t.triple_id AND cs.role = 'subject' LEFT JOIN con co ON co.doc_id = t.doc_id AND co.triple_id = t.triple_id AND co.role = 'object'
LEFT JOIN people p1 ON p1.doc_id = t.doc_id AND contains(lower(t.subject), lower(p1.mention)) LEFT JOIN people p2 ON p2.doc_id = t.doc_id AND contains(lower(t.object), lower(p2.mention)) LEFT JOIN props r ON r.doc_id = t.doc_id AND contains(lower(t.predicate), lower(r.text))"""
)
def enriched_triples(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    t = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey")).selectExpr(*_TRIPLES)
    each = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    people = each.selectExpr("doc_id", "concat('customer ', p % 7) AS mention", "concat('i', doc_id) AS ind_id", "0 AS start")
    found = each.selectExpr("doc_id", "'paid by' AS text", "concat('urn:rel/', s % 3) AS iri", "0 AS start")
    return triples.enriched(t, b.annotations(spark, sf), people, found).select("doc_id", "triple_id", "subject_concept", "subject_individual", "object_concept", "object_individual", "predicate_iri")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN 'made,model: urn:d -> ' || CASE WHEN l_orderkey % 2 = 0 THEN 'urn:r' ELSE '?' END ELSE 'made' END AS lineage FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def property_ends(spark, sf):
    rows = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS n", "l_linenumber * 10 AS start", "l_linenumber * 10 + 5 AS end").distinct().withColumn("lineage", F.array(F.lit("made")))
    said = rows.filter("n = 1").select("doc_id", "start", "end", F.lit("urn:d").alias("domain"), F.when(F.col("doc_id") % 2 == 0, "urn:r").alias("range"))
    return properties.with_ends(rows, said).select("doc_id", "n", F.array_join("lineage", ",").alias("lineage"))


# Model answers


@query(
    r"""WITH low AS (SELECT doc_id, w, w[doc_id % 7 + 1] AS own FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents)),
said AS (SELECT doc_id, w, 'the' AS said, CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.6 END AS confidence FROM low WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, w, 'license', 0.5 FROM low WHERE doc_id % 3 = 2 UNION ALL SELECT doc_id, w, own, 0.3 FROM low WHERE own IS NOT NULL)
SELECT doc_id, said, CAST(max(confidence) AS DOUBLE) AS confidence, CAST(len(list_filter(any_value(w), lambda x: x = said)) AS BIGINT) AS n FROM said WHERE len(list_filter(w, lambda x: x = said)) > 0 GROUP BY doc_id, said"""
)
def model_concepts(spark, sf):
    """A model's namings differ from document to document, and one is the document's own: each is searched for its own."""
    docs = b.texts(spark, sf)
    named = lambda where, *rows: docs.filter(where).select("doc_id", F.explode(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(i).alias("iri"), F.lit(c).alias("confidence"), F.lit(o).alias("ord")) for t, i, c, o in rows])).alias("x")).select("doc_id", "x.*")
    answers = named("doc_id % 3 <> 2 AND doc_id % 2 = 0", ("The", "u:1", 0.4, 0), ("the", "u:2", 0.9, 1), ("THE", "u:3", 0.9, 2)).unionByName(named("doc_id % 3 <> 2 AND doc_id % 2 = 1", ("the", "u:1", 0.6, 0))).unionByName(named("doc_id % 3 = 2", ("license", "u:4", 0.5, 0)))
    own = F.get(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), (F.col("doc_id") % 7).cast("int"))
    of_own = docs.select("doc_id", own.alias("text"), F.concat(F.lit("u:own/"), F.col("doc_id").cast("string")).alias("iri"), F.lit(0.3).alias("confidence"), F.lit(3).alias("ord")).filter("text IS NOT NULL")
    return stages.model_concepts(answers.unionByName(of_own), docs).groupBy("doc_id", F.lower("text").alias("said"), "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(p_name) AS text, max_by(p_brand, (p_size, -p_partkey)) AS iri, CAST(max(p_size) AS DOUBLE) AS confidence FROM part GROUP BY 1")
def best_per_text(spark, sf):
    rows = b.table(spark, sf, "part").selectExpr("p_name AS text", "p_brand AS iri", "CAST(p_size AS DOUBLE) AS confidence", "p_partkey AS ord")
    return models.best_per_text(rows).select(F.col("key").alias("text"), "iri", "confidence")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Lease' WHEN 1 THEN 'Complaint' WHEN 2 THEN 'Answer' ELSE 'Unknown' END AS document_type, CAST(CASE doc_id % 6 WHEN 0 THEN 0.8 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS DOUBLE) AS confidence FROM documents")
def document_types(spark, sf):
    said = F.array(F.lit('```json\n{"document_type": "Lease", "confidence": 0.8}\n```'), F.lit("Complaint "), F.lit('{"document_type": "Answer"}'), F.lit("{broken"), F.lit(""), F.lit(None).cast("string"))
    rows = b.table(spark, sf, "documents").select("doc_id", F.get(said, (F.col("doc_id") % 6).cast("int")).alias("answer"), F.when(F.col("doc_id") % 6 == 5, "failed").alias("error"))
    return models.document_type(rows)


@query("SELECT user_id AS doc_id, event_type AS area, value / 100 AS confidence, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS INT) AS rank FROM (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY ALL) WHERE value / 100 >= 0.5")
def areas_of_law(spark, sf):
    rows = b.table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("area")).agg((F.max("value") / 100).alias("confidence"))
    return metadata.areas(rows)


@query(
    """SELECT p_partkey, 'Which areas of law is this document about? Answer as a JSON array of {area, confidence}.' || chr(10) || 'Type: ' || p_type || chr(10) || 'Concepts: ' || CASE WHEN p_size % 2 = 0 THEN 'none' ELSE p_name || ', ' || p_brand END AS area,
'Does the type fit what was found? Answer as JSON {severity, message}.' || chr(10) || 'Type: unknown' || chr(10) || 'Branches: ' || p_brand || chr(10) || 'Labels: ' || p_name AS fit, CASE p_size % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
'Name the individuals in this text, each as JSON {name, mention, class_ids, class_labels, confidence}. Annotations: ' || p_brand || ': ' || p_type || chr(10) || chr(10) || p_name AS individual, 'Name the relations in this text, each as JSON {mention, domain, range, confidence}. Found already: ' || p_type || chr(10) || chr(10) || p_name AS property,
'Name the concepts in this text, each as JSON {text, branch, confidence}. Branches: A, B.' || chr(10) || chr(10) || p_name AS concept, 'Score from 0 to 1 how well each candidate fits the text; answer as a JSON object.' || chr(10) || 'Candidates: ' || p_type || '; ' || p_brand || chr(10) || chr(10) || p_name AS rerank,
'Concept: ' || p_name || chr(10) || 'Sentence: ' || p_type || chr(10) || 'Which of these branches? ' || p_brand AS branch FROM part"""
)
def prompts(spark, sf):
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    none = F.array().cast("array<string>")
    grave = F.get(F.array(*[F.lit(x) for x in (" HIGH", "Medium", "low", "", None)]), F.col("p_size") % 5)
    return b.table(spark, sf, "part").select(
        "p_partkey",
        models.area_prompt(kind, F.when(F.col("p_size") % 2 == 0, none).otherwise(F.array(name, brand))).alias("area"),
        models.check_prompt(F.lit(None).cast("string"), F.array(brand), F.array(name)).alias("fit"),
        F.coalesce(models.severity(grave), F.lit("info")).alias("severity"),
        models.individual_prompt(name, F.array(F.concat_ws(": ", brand, kind))).alias("individual"),
        models.property_prompt(name, F.array(kind)).alias("property"),
        models.concept_prompt(name, ["B", "A"]).alias("concept"),
        models.rerank_prompt(name, F.array(kind, brand)).alias("rerank"),
        models.branch_prompt(name, kind, F.array(brand)).alias("branch"),
    )


_TYPES = [t for types in DOCUMENT_TYPES.values() for t in types]
_FIELDS = [f for f, types in DOCUMENT_TYPES.items() for _ in types]


@query(f"WITH catalogue(n, field, document_type) AS (VALUES {', '.join(f"({i}, '{f}', '{t}')" for i, (f, t) in enumerate(zip(_FIELDS, _TYPES, strict=True)))}) SELECT doc_id, document_type, field FROM documents LEFT JOIN catalogue ON doc_id % {len(_TYPES) + 1} = n")
def document_catalogue(spark, sf):
    """The field of law of each document's type, in any case, by the catalogue; a type that it doesn't have has none."""
    kind = F.get(F.array(*[F.lit(t.upper()) for t in _TYPES]), (F.col("doc_id") % (len(_TYPES) + 1)).cast("int"))
    return metadata.catalogued(b.table(spark, sf, "documents").select("doc_id", kind.alias("document_type")))


# Confidence


@query(
    """WITH a AS (SELECT p_partkey AS item_id, p_size / 50.0 AS c, CASE p_partkey % 4 WHEN 0 THEN 'VERB' WHEN 1 THEN 'NOUN' WHEN 2 THEN 'ADV' END AS pos, CASE p_partkey % 5 WHEN 0 THEN 'Filing Process' WHEN 1 THEN 'Document / Artifact' WHEN 2 THEN '' WHEN 3 THEN 'Service' END AS branch FROM part),
v AS (SELECT *, least(1.0, c * 0.7 + 0.4 * 0.3) AS blended, CASE WHEN pos = 'VERB' AND branch = 'Filing Process' THEN 0.05 WHEN pos = 'VERB' AND branch = 'Document / Artifact' THEN -0.05 WHEN pos = 'NOUN' AND branch = 'Document / Artifact' THEN 0.05 WHEN pos = 'NOUN' AND branch = 'Filing Process' THEN -0.05 ELSE 0 END AS more FROM a)
SELECT item_id, round(CASE WHEN item_id % 5 = 4 THEN c WHEN branch = '' THEN blended ELSE greatest(0, least(1, blended + more)) END, 6) AS confidence, CASE WHEN item_id % 5 = 4 THEN 'preliminary' WHEN branch = '' THEN 'rejected' ELSE 'confirmed' END AS state,
CASE WHEN item_id % 5 = 4 THEN '' WHEN branch = '' THEN 'no branch' ELSE 'branch ' || branch END AS lineage FROM v"""
)
def branch_judge(spark, sf):
    p = b.table(spark, sf, "part")
    nth = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % n).cast("int"))
    items = p.select(F.col("p_partkey").alias("item_id"), (F.col("p_size") / 50.0).alias("confidence"), F.lit("preliminary").alias("state"), F.array().cast("array<string>").alias("lineage"), nth(["VERB", "NOUN", "ADV", None], 4).alias("pos"))
    verdicts = p.filter("p_partkey % 5 < 4").select(F.col("p_partkey").alias("item_id"), nth(["Filing Process", "Document / Artifact", "", "Service"], 5).alias("branch"), F.lit(0.4).alias("score"))
    return confidence.judged(items, verdicts).select("item_id", F.round("confidence", 6).alias("confidence"), "state", F.array_join("lineage", ",").alias("lineage"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN p_size / 50.0 ELSE p_size / 50.0 * 0.6 + greatest(0, least(1, (p_partkey % 13 - 1) / 10.0)) * 0.4 END, 4) AS confidence FROM part")
def context_blend(spark, sf):
    rows = b.table(spark, sf, "part").selectExpr("p_partkey", "p_size / 50.0 AS confidence", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS definition", "CAST((p_partkey % 13 - 1) / 10.0 AS DOUBLE) AS near").withColumn("confidence", F.col("confidence").cast("double"))
    return confidence.in_context(rows, "near").select("p_partkey", F.round("confidence", 4).alias("confidence"))


@query()
def context_scores(spark, sf):
    """Concepts whose definition is a sentence of their own document, near or not."""
    docs = b.sentences(spark, sf)
    rows = docs.selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN 'BUYER' WHEN 1 THEN 'tenant' WHEN 2 THEN 'absent' ELSE 'Foo Bar' END AS text", "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'the buyer shall pay' ELSE 'the tenant owes dollars' END AS definition", "0.5D AS confidence")
    return stages.in_context(rows, docs).select("doc_id", "sentence", "confidence")


@query()
def semantic_matches(spark, sf):
    """Phrases of part names near a label that no exact match has."""
    docs = b.table(spark, sf, "part").selectExpr("p_partkey AS doc_id", "concat('the ', p_name, ' of ', p_type) AS text")
    labels = b.table(spark, sf, "part").selectExpr("concat('urn:', p_name) AS iri", "concat(split(p_name, ' ')[1], ' ', split(p_name, ' ')[0]) AS label").distinct()
    known = docs.filter("doc_id % 10 = 0").selectExpr("doc_id", "0 AS start", "length(text) AS end")
    return stages.semantic_matches(stages.phrases(docs, known), labels)


# Resolution


def _branched(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "part").selectExpr("concat('urn:part/', p_partkey) AS iri", "p_name AS label", "p_type AS definition", "CASE p_partkey % 4 WHEN 0 THEN 'Area of Law' WHEN 1 THEN 'Service' WHEN 2 THEN 'Document Metadata' END AS branch")


@query(
    """WITH c AS (SELECT 'urn:part/' || p_partkey AS iri, p_name AS label, CASE p_partkey % 4 WHEN 1 THEN 'Service' WHEN 2 THEN 'Actor / Player|Document / Artifact' ELSE '' END AS branches, p_partkey FROM part WHERE p_partkey % 4 > 0),
r AS (SELECT o_orderkey AS doc_id, 'reconciled' AS source, 0.7 AS confidence, o_custkey % 400 AS k FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'entity_ruler', 0.6, o_custkey % 400 FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, 'llm', 0.5, o_custkey % 300 + 1 FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0)
SELECT doc_id, source, c.iri, label, branches, CAST(confidence AS DOUBLE) AS confidence FROM r JOIN c ON p_partkey = k"""
)
def resolution(spark, sf):
    """Rows whose iris are known; a document of both sources keeps the model's rows of other texts only."""
    spark = b.sized(spark, sf, "orders", "part")
    o = b.table(spark, sf, "orders")
    rows = lambda where, text, k, sure: o.filter(where).selectExpr("o_orderkey AS doc_id", f"{text} AS text", f"concat('urn:part/', {k}) AS iri", f"CAST({sure} AS DOUBLE) AS confidence")
    reconciled = rows("o_orderkey % 3 = 0", "'zq'", "o_custkey % 400", 0.7)
    ruler = rows("o_orderkey % 3 < 2", "'zq'", "o_custkey % 400", 0.6)
    model = rows("o_orderkey % 3 = 1 AND o_orderkey % 2 = 0", "'zx'", "o_custkey % 300 + 1", 0.5).unionByName(rows("o_orderkey % 3 = 1", "'ZQ'", "1", 0.9))
    concepts = _branched(spark, sf)
    found = stages.resolution(reconciled, ruler, model, concepts)
    return found.select("doc_id", "source", "iri", "label", F.array_join("branches", "|").alias("branches"), "confidence")


@query()
def resolve_with_hints(spark, sf):
    """Names searched with a hint of a branch: what the hint puts first, and the others as backups."""
    spark = b.sized(spark, sf, "part")
    mentions = b.table(spark, sf, "part").select(F.lower("p_name").alias("text"), F.lit(None).cast("string").alias("iri"), F.lit(0.5).alias("confidence"), F.when(F.col("p_partkey") % 2 == 0, "serv").alias("hint")).distinct()
    return search.resolve(mentions, _branched(spark, sf), excluded=("Area of Law",)).select("text", "iri", "branch", "confidence", F.size("backups").alias("n_backups"))


@query("SELECT p_partkey AS doc_id, p_name AS text, 'urn:part/' || p_partkey AS iri, CAST(p_partkey AS VARCHAR) AS iri_hash, CASE WHEN p_size % 2 = 0 THEN p_type END AS definition, CASE WHEN p_size % 3 = 0 THEN p_brand END AS branches, CASE WHEN p_size % 5 = 0 THEN true END AS deprecated, 'confirmed' AS state FROM part")
def resolved_rows(spark, sf):
    p = b.table(spark, sf, "part")
    resolved = p.selectExpr("p_partkey AS doc_id", "p_name AS text", "concat('urn:part/', p_partkey) AS iri", "p_name AS label", "0.5D AS confidence", "CASE WHEN p_size % 3 = 0 THEN array(p_brand) ELSE CAST(array() AS array<string>) END AS branches")
    said = p.selectExpr("concat('urn:part/', p_partkey) AS iri", "CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS definition", "p_size % 5 = 0 AS deprecated")
    return stages.resolved_rows(resolved, said).select("doc_id", "text", "iri", "iri_hash", "definition", F.array_join("branches", "|").alias("branches"), "deprecated", "state")


# Document context


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "concat('Name ', l_partkey % 5) AS name", "CASE l_suppkey % 3 WHEN 0 THEN 'Persons' WHEN 1 THEN 'Courts' ELSE 'Dates' END AS type", "l_linenumber AS start").groupBy("doc_id", "name", "type", "start").count().withColumn("confidence", (F.col("start") % 7 + 3) / 10).drop("count")


_PEOPLE_SQL = "people AS (SELECT DISTINCT l_orderkey AS doc_id, 'Name ' || (l_partkey % 5) AS name, CASE l_suppkey % 3 WHEN 0 THEN 'Persons' WHEN 1 THEN 'Courts' ELSE 'Dates' END AS type, l_linenumber AS s, (l_linenumber % 7 + 3) / 10.0 AS confidence FROM lineitem), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY s, type) AS r FROM people) WHERE r = 1)"


@query(f"WITH {_PEOPLE_SQL} SELECT doc_id, type, string_agg(name, '|' ORDER BY s, name) AS names FROM firsts WHERE confidence >= 0.8 GROUP BY ALL")
def entities_by_type(spark, sf):
    return metadata.entities_by_type(_people(spark, sf)).select("doc_id", "type", F.array_join("names", "|").alias("names"))


@query(f"WITH {_PEOPLE_SQL} SELECT doc_id, name, type, CAST(round(confidence, 2) AS DOUBLE) AS confidence FROM firsts WHERE confidence < 0.8")
def weak_entities(spark, sf):
    return metadata.weak_entities(_people(spark, sf))


@query("WITH f AS (SELECT l_orderkey AS doc_id, 'part ' || (l_partkey % 40) AS label, min(l_linenumber) AS p FROM lineitem WHERE l_quantity / 50 >= 0.8 GROUP BY ALL) SELECT doc_id, array_to_string(list(label ORDER BY p, label)[1:20], '|') AS labels FROM f GROUP BY ALL")
def top_labels(spark, sf):
    rows = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "concat('part ', l_partkey % 40) AS label", "l_quantity / 50 AS confidence", "l_linenumber AS place")
    return metadata.top_labels(rows).select("doc_id", F.array_join("labels", "|").alias("labels"))


@query(f"WITH {b.ANNOTATIONS_SQL} SELECT label || ' [' || branch || ']' AS concept, count(*) AS n, min_by(left('defined as ' || iri, 60), iri) AS definition FROM annotations GROUP BY label, branch ORDER BY n DESC, concept LIMIT 30")
def concept_histogram(spark, sf):
    return metadata.histogram(b.annotations(spark, sf).withColumn("definition", F.concat(F.lit("defined as "), "iri")))


@query(f"WITH {b.ANNOTATIONS_SQL} SELECT * FROM (SELECT 'branch' AS what, branch AS value, count(*) AS n FROM annotations GROUP BY branch ORDER BY n DESC, branch LIMIT 10) UNION ALL SELECT * FROM (SELECT 'label', label, count(*) AS n FROM annotations GROUP BY label ORDER BY n DESC, label LIMIT 15)")
def top_branches_and_labels(spark, sf):
    a = b.annotations(spark, sf)
    top = lambda c, n: metadata.top_counts(a, c, n).select(F.lit(c).alias("what"), F.col(c).alias("value"), "n")
    return top("branch", 10).unionByName(top("label", 15))


@query("SELECT user_id AS doc_id, max(event_id % 50) + 1 AS n_pages FROM events GROUP BY ALL")
def page_counts(spark, sf):
    return metadata.page_count(b.table(spark, sf, "events").selectExpr("user_id AS doc_id", "event_id % 50 AS page"))


@query()
def document_metadata(spark, sf):
    docs = b.sentences(spark, sf)
    answers = docs.select("doc_id", F.lit("Lease").alias("answer"), F.lit(None).cast("string").alias("error"))
    known = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("Answer").alias("document_type"), F.lit(0.9).alias("confidence"))
    found = extract.extract(docs, ["money", "court"])
    people = found.select("doc_id", F.col("value").alias("name"), F.col("label").alias("type"), "confidence", "start")
    out = stages.document_metadata(docs, answers, people, found.select("doc_id", "start", "end", "text"), known)
    return out.select("doc_id", "document_type", "confidence", F.to_json("fields").alias("fields"), F.to_json("entities").alias("entities"))


@query(
    f"""WITH s AS (SELECT o_orderkey AS doc_id, {b.SENTENCE.replace("STRING", "VARCHAR")} AS text, * FROM orders), parts AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'NAMED ENTITIES:' || chr(10) || '  Courts: Court ' || o_custkey END AS named,
CASE WHEN o_orderkey % 3 = 1 THEN 'ENTITIES IN DOUBT:' || chr(10) || '  "Court ' || o_custkey || '" (Courts, 0.40)' END AS doubt, CASE WHEN o_orderkey % 2 = 0 THEN 'RELATIONSHIPS:' || chr(10) || '  Acme pay Customer ' || o_custkey || chr(10) || '  sue Acme' END AS related,
CASE WHEN o_orderkey % 5 < 4 THEN 'CONCEPTS:' || chr(10) || '  ' || CASE WHEN o_orderkey % 5 < 2 THEN 'lease, deed' ELSE 'lease' END END AS concepts, CASE WHEN o_orderkey % 7 < 5 THEN 'AREAS OF LAW:' || chr(10) || '  Tax (90%)' || CASE WHEN o_orderkey % 7 < 2 THEN chr(10) || '  Property (50%)' ELSE '' END END AS areas FROM s)
SELECT doc_id, md5(concat_ws(chr(10) || chr(10), named, doubt, related, concepts, areas, 'HOW IT BEGINS:' || chr(10) || left(text, 1000), CASE WHEN length(text) > 1000 THEN 'HOW IT ENDS:' || chr(10) || right(text, least(length(text) - 1000, 500)) END)) AS block_md5 FROM parts"""
)
def document_context(spark, sf):
    """What a model is told of each order's sentence, parts of it missing here and there."""
    docs, o = b.sentences(spark, sf), b.table(spark, sf, "orders").withColumn("doc_id", F.col("o_orderkey"))
    some = lambda where, *cols: o.filter(where).selectExpr("doc_id", *cols)
    people = some("doc_id % 3 < 2", "concat('Court ', o_custkey) AS name", "'Courts' AS type", "CASE WHEN doc_id % 3 = 0 THEN 0.9D ELSE 0.4D END AS confidence", "0 AS start")
    relations = some("doc_id % 2 = 0", "1 AS place", "'' AS subject", "'sue' AS predicate", "'Acme' AS object").unionByName(some("doc_id % 2 = 0", "0 AS place", "'Acme' AS subject", "'pay' AS predicate", "concat('Customer ', o_custkey) AS object"))
    concept = lambda where, label, sure, place: some(where, f"'{label}' AS label", f"{sure}D AS confidence", f"{place} AS place")
    concepts = concept("doc_id % 5 < 2", "deed", 0.8, 9).unionByName(concept("doc_id % 5 < 4", "lease", 0.95, 2)).unionByName(concept("true", "doubtful", 0.5, 0))
    area = lambda where, name, sure: some(where, f"'{name}' AS area", f"{sure}D AS confidence")
    areas = area("doc_id % 7 < 2", "Property", 0.5).unionByName(area("doc_id % 7 < 5", "Tax", 0.9)).unionByName(area("true", "Unlikely", 0.2))
    return stages.document_context(docs, people, relations, concepts, areas).select("doc_id", F.md5("block").alias("block_md5"))


# Feedback, jobs and history


_ENTRIES = ["event_id AS id", "user_id AS job_id", "event_id % 3 AS ann_id", "event_type AS rating", "ts AS created_at"]


@query("SELECT job_id, ann_id, id, rating FROM (SELECT event_id AS id, user_id AS job_id, event_id % 3 AS ann_id, event_type AS rating, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id % 7 = 3 AND event_id % 3 = 1) WHERE r = 1")
def feedback_by_annotation(spark, sf):
    f = b.table(spark, sf, "events").selectExpr(*_ENTRIES)
    keys = f.filter("job_id % 7 = 3 AND ann_id = 1").select("job_id", "ann_id")
    return feedback.by_annotation(f, keys).select("job_id", "ann_id", "id", "rating")


@query("SELECT event_id AS id, event_type AS rating FROM events WHERE user_id = 8")
def feedback_by_job(spark, sf):
    return feedback.by_job(b.table(spark, sf, "events").selectExpr(*_ENTRIES), 8).select("id", "rating")


@query("SELECT user_id AS job_id, max_by(event_type, event_id) AS rating, CAST(max(event_id) AS BIGINT) AS id FROM events WHERE event_id % 2 = 0 AND user_id % 5 <> 0 GROUP BY user_id HAVING user_id % 3 > 0 UNION ALL SELECT user_id, 'new', -1 FROM events WHERE user_id % 5 <> 0 AND user_id % 3 = 0 GROUP BY user_id")
def feedback_upsert(spark, sf):
    """Newer entries take the place of those with their key; then some keys are deleted."""
    e = b.table(spark, sf, "events")
    old = e.filter("event_id % 2 = 0").groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", "event_id").alias("rating"), F.max("event_id").alias("id"))
    new = e.filter("user_id % 3 = 0").select(F.col("user_id").alias("job_id"), F.lit("new").alias("rating"), F.lit(-1).cast("long").alias("id")).distinct()
    return ann.without(ann.upserted(old, new, "job_id"), e.filter("user_id % 5 = 0").select(F.col("user_id").alias("job_id")), "job_id")


@query(f"WITH {b.STACKED_SQL} SELECT ann_id, CAST(i AS INT) AS place, CASE i WHEN 0 THEN 'made' ELSE 'rejected' END AS event, n AS n_rows FROM (SELECT ann_id, unnest(CASE WHEN c = 'urn:line/3' AND state <> 'rejected' THEN [0, 1] ELSE [0] END) AS i, 1 AS n FROM stacked)")
def lineage_read(spark, sf):
    hit = F.exists("concepts", lambda c: c["iri"] == "urn:line/3")
    return ann.lineage_rows(ann.reject(b.stacked(spark, sf), hit)).withColumn("n_rows", F.lit(1))


@query(f"WITH {b.STACKED_SQL} SELECT ann_id, CASE WHEN k = 0 THEN 'old' WHEN k = 1 THEN b ELSE '' END AS branches FROM stacked")
def legacy_rows(spark, sf):
    rows = b.table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in b.STACKED.items()])
    branches = F.when(F.col("k") == 1, F.array("b")).when(F.col("k") == 2, F.array().cast("array<string>"))
    old = rows.select("ann_id", F.when(F.col("k") == 0, "old").when(F.col("k") == 1, "older").when(F.col("k") == 2, "").alias("branch"), branches.alias("branches"))
    return ann.migrated(old).select("ann_id", F.array_join("branches", "|").alias("branches"))


_LOG = "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'ingesting' WHEN 'purchase' THEN 'matching' WHEN 'signup' THEN 'completed' ELSE 'failed' END"
_PLACES = "CASE {0} WHEN 'pending' THEN 1 WHEN 'ingesting' THEN 2 WHEN 'matching' THEN 7 WHEN 'completed' THEN 12 ELSE 13 END"


@query(
    f"""WITH l AS (SELECT user_id AS job_id, ts, {_LOG} AS status, lag({_LOG}) OVER (PARTITION BY user_id ORDER BY ts, {_LOG}) AS before FROM events)
SELECT job_id, ts, status, before, CASE WHEN before IS NULL THEN true WHEN before IN ('completed', 'failed') THEN false ELSE {_PLACES.format("status")} > {_PLACES.format("before")} END AS forward FROM l WHERE status IS DISTINCT FROM before"""
)
def job_transitions(spark, sf):
    return feedback.transitions(b.table(spark, sf, "events").selectExpr("user_id AS job_id", "ts", f"{_LOG} AS status"))


@query("SELECT DISTINCT user_id AS job_id, ts, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS message FROM events")
def activity_log(spark, sf):
    e = b.table(spark, sf, "events")
    rows = lambda where, m: e.filter(where).select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("stage"), F.lit(m).alias("message"))
    log = rows("event_id % 3 = 0", "a")
    return feedback.logged(log, log.unionByName(rows("event_id % 3 > 0", "b")))


@query(f"WITH {b.ANNOTATIONS_SQL} SELECT count(*) FILTER (doc_id % 3 = 0) AS n_preferred, count(*) FILTER (doc_id % 3 = 1) AS n_alternative, count(*) FILTER (state = 'confirmed') AS n_confirmed, count(*) FILTER (state = 'rejected') AS n_rejected FROM annotations")
def stage_summary(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "preferred").when(F.col("doc_id") % 3 == 1, "alternative").otherwise("hidden")
    return feedback.stage_summary(b.annotations(spark, sf).withColumn("label_type", kind))


@query(
    f"""WITH {b.ANNOTATIONS_SQL}, old AS (SELECT doc_id, "start", "end", min(ann_id) AS ann_id FROM annotations GROUP BY doc_id, "start", "end")
SELECT o.doc_id, o."start", o."end", CASE WHEN o.doc_id % 3 < 2 THEN ann_id END AS ann_id, o.doc_id % 3 = 2 AS created FROM old o"""
)
def attached_matches(spark, sf):
    """Matches meet the annotation of their span and iri, else of their span and text; other ones are new."""
    # several lines can have one ann_id: all three columns come from one row, whenever the plan is run
    single = b.annotations(spark, sf).groupBy("doc_id", "start", "end").agg(F.min(F.struct("ann_id", "text", "iri")).alias("x")).select("doc_id", "start", "end", "x.*")
    text = F.when(F.col("doc_id") % 3 == 2, "other").otherwise(F.upper("text"))
    matches = single.select("doc_id", "start", "end", text.alias("text"), F.when(F.col("doc_id") % 3 == 0, F.col("iri")).otherwise("urn:other").alias("iri"))
    return ann.attach(matches, single).select("doc_id", "start", "end", "ann_id", "created")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'stupid') THEN 1 ELSE 0 END AS n FROM documents WHERE text IS NOT NULL")
def preliminary_merge(spark, sf):
    """Rows of one source that the other doesn't have, by document and text."""
    docs = b.table(spark, sf, "documents").filter("text IS NOT NULL")
    has = docs.filter(F.contains(F.lower("text"), F.lit("stupid"))).select("doc_id", F.lit(1).alias("n"))
    return ann.upserted(docs.select("doc_id", F.lit(0).alias("n")), has, "doc_id")



# Smaller parts


@query("SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_suppkey % 2 = 0 THEN 'urn:own' WHEN l_partkey % 3 < 2 THEN 'urn:class/' || (l_partkey % 3) END AS iri, CASE WHEN l_suppkey % 2 = 0 THEN 'Own' WHEN l_partkey % 3 < 2 THEN 'Branch ' || (l_partkey % 3) END AS branch FROM lineitem")
def class_links(spark, sf):
    """Links without an iri get that of their label."""
    links = b.table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS n", "concat('CLASS ', l_partkey % 3) AS label", "CASE WHEN l_suppkey % 2 = 0 THEN 'urn:own' WHEN l_suppkey % 3 = 0 THEN '' END AS iri", "CASE WHEN l_suppkey % 2 = 0 THEN 'Own' END AS branch")
    labels = spark.createDataFrame([(f"class {i}", f"urn:class/{i}", f"Branch {i}") for i in range(2)], "label string, iri string, branch string")
    return extract.filled_links(links, labels).select("doc_id", "n", "iri", "branch")


@query(
    """WITH s AS (SELECT 's' || s_suppkey AS iri, CAST(40 + s_suppkey % 50 AS DOUBLE) AS score FROM supplier), up AS (SELECT 's' || s_suppkey AS iri, 'n' || s_nationkey AS a, 1 AS d FROM supplier UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'q' AS query, iri, score FROM s UNION ALL SELECT 'q', a, round(max(score * pow(0.85, d)), 6) FROM s JOIN up USING (iri) WHERE score >= 50 GROUP BY a"""
)
def search_ancestors(spark, sf):
    """Scores of suppliers, and what their nations and regions get from them."""
    scored = b.table(spark, sf, "supplier").selectExpr("'q' AS query", "concat('s', s_suppkey) AS iri", "CAST(40 + s_suppkey % 50 AS DOUBLE) AS score")
    return search.with_ancestors(scored, hierarchy.closure(b.edges(spark, sf))).withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%widget%' THEN 0.5 ELSE 0 END::DOUBLE AS overlap FROM part")
def definition_overlap(spark, sf):
    """Words that a name shares with a definition of two words, over those of the larger set."""
    said = F.array(F.lit("ring"), F.lit("widget"))
    return b.table(spark, sf, "part").select("p_partkey", scoring.set_overlap(text.words(F.col("p_name")), said).alias("overlap"))


@query("SELECT p_partkey, greatest(0.3, least(0.85, 0.5 + 0.1 * (p_size % 6) - CASE WHEN p_partkey % 2 = 0 THEN 0.05 ELSE 0 END))::DOUBLE AS confidence FROM part")
def triple_scores(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", scoring.triple_confidence((F.col("p_size") % 6).cast("double"), F.col("p_partkey") % 2 == 0).alias("confidence"))


@query("SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS length FROM embeddings")
def unit_vectors(spark, sf):
    n = scoring.normalized(F.col("embedding"))
    return b.table(spark, sf, "embeddings").select("vec_id", F.round(scoring.dot(n, n), 6).alias("length"))


@query(
    """SELECT event_id AS id, event_type AS rating, CASE WHEN user_id % 5 > 0 THEN 'stage ' || (user_id % 5) END AS stage, NULL::VARCHAR AS comment, 'urn:' || user_id AS iri, 'label ' || user_id AS label, '[' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '{"stage":"a","detail":"' || event_type || '"}' END || ']' AS lineage, ts AS created_at FROM events"""
)
def feedback_export(spark, sf):
    e = b.table(spark, sf, "events")
    one = F.array(F.struct(F.lit("a").alias("stage"), F.col("event_type").alias("detail")))
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("rating"), F.expr("CASE WHEN user_id % 5 > 0 THEN concat('stage ', user_id % 5) END").alias("stage"), F.lit(None).cast("string").alias("comment"), F.concat(F.lit("urn:"), "user_id").alias("iri"), F.concat(F.lit("label "), "user_id").alias("label"), F.when(F.col("event_id") % 3 == 0, F.slice(one, 1, 0)).otherwise(one).alias("lineage"), F.col("ts").alias("created_at"))
    return export.feedback_rows(rows)


@query("SELECT o_orderkey AS doc_id, '42 U.S.C. § ' || o_orderkey AS text, 'Statute' AS class, 'https://www.law.cornell.edu/uscode/text/42/' || o_orderkey AS url FROM orders WHERE o_orderkey % 4 = 1")
def citations(spark, sf):
    return extract.citations(b.sentences(spark, sf)).select("doc_id", "text", "class", "url")


@query()
def same_concept_absorbed(spark, sf):
    a = b.annotations(spark, sf).withColumn("iri", F.when(F.col("start") % 5 > 0, F.concat(F.lit("urn:"), F.col("start") % 3))).withColumn("lineage", F.array(F.lit("made")))
    a = a.groupBy("doc_id", "ann_id").agg(*[F.min(c).alias(c) for c in ("start", "end", "iri", "confidence", "state", "lineage")])
    return overlap.absorbed(a).select("doc_id", "ann_id", "start", "end", "iri", F.array_join("lineage", "|").alias("lineage"))


@query(
    """SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'NAMED ENTITIES:' || chr(10) || '  Brand: ' || p_brand || ', x' || chr(10) || '  Name: ' || p_name || chr(10) || chr(10) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'ENTITIES IN DOUBT:' || chr(10) || '  "' || p_name || '" (Name, 0.50)' || chr(10) || chr(10) ELSE '' END
|| 'CONCEPTS:' || chr(10) || '  ' || p_type || ', ' || p_brand AS block FROM part"""
)
def context_blocks(spark, sf):
    p = b.table(spark, sf, "part")
    entities = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("Name"), F.array("p_name"), F.lit("Brand"), F.array("p_brand", F.lit("x")))).otherwise(F.expr("CAST(map() AS map<string,array<string>>)"))
    one = F.array(F.struct(F.col("p_name").alias("name"), F.lit("Name").alias("type"), F.lit(0.5).alias("confidence")))
    rows = p.select(F.col("p_partkey").alias("doc_id"), entities.alias("entities"), F.when(F.col("p_size") % 3 == 0, one).otherwise(F.slice(one, 1, 0)).alias("weak"), F.array().cast("array<string>").alias("relations"), F.array("p_type", "p_brand").alias("concepts"))
    return metadata.context_block(rows)
