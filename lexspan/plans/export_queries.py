"""Exports of all sections of a document's job, each with DuckDB's SQL for the same lines."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexspan.plans import bindings as b
from lexspan.plans.registry import query
from lexspan.sinks import sections

#: Columns of the three sections beside annotations, made from orders; lists follow below, in each dialect.
INDIVIDUAL = {
    "doc_id": "o_orderkey",
    "ind_id": "concat('i', CAST(o_orderkey AS STRING))",
    "name": "concat('Customer ', CAST(o_custkey AS STRING))",
    "mention": "concat(CASE WHEN o_custkey % 2 = 0 THEN 'Customer ' ELSE 'customer no. ' END, CAST(o_custkey AS STRING))",
    "kind": "CASE o_orderkey % 3 WHEN 0 THEN 'legal_citation' WHEN 1 THEN 'named_entity' ELSE 'other kind' END",
    "start": "CAST(o_orderkey % 50 AS INT)",
    "end": "CAST(o_orderkey % 50 + 10 AS INT)",
    "confidence": "CAST(o_orderkey % 100 AS DOUBLE) / 100",
    "source": "'regex'",
    "normal_form": "CASE WHEN o_orderkey % 4 = 0 THEN concat('Form ', CAST(o_custkey AS STRING)) END",
    "url": "CASE WHEN o_orderkey % 5 = 0 THEN concat('http://x/', CAST(o_custkey AS STRING)) END",
}
LINK_IRI = "CASE WHEN o_orderkey % 4 > 0 THEN concat('urn:part/', CAST(o_custkey % 200 AS STRING)) END"
LINK_LABEL = "CASE WHEN o_orderkey % 5 > 0 THEN concat('Class ', CAST(o_custkey % 7 AS STRING)) END"
PROPERTY = {
    "doc_id": "o_orderkey",
    "prop_id": "concat('p', CAST(o_orderkey AS STRING))",
    "text": "'paid by'",
    "iri": "CASE WHEN o_orderkey % 7 > 0 THEN concat('urn:rel/', CAST(o_custkey % 9 AS STRING)) END",
    "label": "CASE WHEN o_orderkey % 7 > 0 THEN concat('Relation ', CAST(o_custkey % 9 AS STRING)) END",
    "start": "CAST(o_orderkey % 40 + 60 AS INT)",
    "end": "CAST(o_orderkey % 40 + 67 AS INT)",
    "confidence": "CAST(o_orderkey % 90 AS DOUBLE) / 100",
    "source": "'automaton'",
    "match_type": "CASE WHEN o_orderkey % 2 = 0 THEN 'preferred' END",
    "inverse_of": "CASE WHEN o_orderkey % 6 = 0 THEN 'urn:rel/inverse' END",
}
TRIPLE = {
    "doc_id": "o_orderkey",
    "triple_id": "concat('t', CAST(o_orderkey AS STRING))",
    "subject": "concat('Customer ', CAST(o_custkey AS STRING))",
    "predicate": "'agrees with'",
    "object": "concat('Order ', CAST(o_orderkey AS STRING))",
    "sentence": "concat('Customer ', CAST(o_custkey AS STRING), ' agrees with Order ', CAST(o_orderkey AS STRING), '.')",
    "voice": "CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'passive' END",
    "confidence": "CAST(o_orderkey % 80 AS DOUBLE) / 100",
    "source": "'parser'",
    "subject_start": "CASE WHEN o_orderkey % 4 > 0 THEN 100 END",
    "subject_end": "CASE WHEN o_orderkey % 4 > 0 THEN 110 END",
    "object_start": "CASE WHEN o_orderkey % 4 > 0 THEN 120 END",
    "object_end": "CASE WHEN o_orderkey % 4 > 0 THEN 130 END",
}


def _sections(spark: SparkSession, sf: str) -> sections.Sections:
    spark = b.sized(spark, sf, "orders", "lineitem")
    orders = b.table(spark, sf, "orders")
    made = lambda cols, *more: orders.select(*[F.expr(e).alias(c) for c, e in cols.items()], *more)
    link = lambda iri, label, sure: F.struct(iri.alias("iri"), label.alias("label"), F.lit(sure).alias("confidence"))
    links = F.slice(F.array(link(F.expr(LINK_IRI), F.expr(LINK_LABEL), 0.9), link(F.lit(None).cast("string"), F.lit("Other"), 0.5)), F.lit(1), (F.col("o_orderkey") % 3).cast("int"))
    part = lambda n: F.expr(f"concat('urn:part/', CAST(o_custkey % {n} AS STRING))")
    ref = lambda kind, i, iri: F.array(F.struct(F.lit(kind).alias("kind"), i.alias("id"), iri.alias("iri")))
    only = lambda n, rest, x: F.when(F.col("o_orderkey") % n == rest, x).otherwise(F.slice(x, 1, 0))
    none = F.lit(None).cast("string")
    return sections.Sections(
        b.annotations(spark, sf),
        made(INDIVIDUAL, links.alias("links")),
        made(PROPERTY, only(3, 1, F.array(part(200))).alias("domain_iris"), F.array(part(150), F.lit("urn:none")).alias("range_iris")),
        made(
            TRIPLE,
            only(2, 1, ref("concept", F.lit("a"), part(200))).alias("subject_links"),
            only(3, 1, ref("individual", F.expr(INDIVIDUAL["ind_id"]), none)).alias("object_links"),
            only(5, 0, ref("property", F.expr(PROPERTY["prop_id"]), F.lit("urn:rel/1"))).alias("predicate_links"),
        ),
    )


def _sql(cols: dict[str, str]) -> str:
    return ", ".join(f'{e.replace("STRING", "VARCHAR")} AS "{c}"' for c, e in cols.items())


_PART = "concat('urn:part/', CAST(o_custkey % {0} AS VARCHAR))"
SECTIONS_SQL = f"""{b.ANNOTATIONS_SQL}, shown AS (SELECT * FROM annotations WHERE state <> 'rejected'),
individuals AS (SELECT {_sql(INDIVIDUAL)}, [{{'iri': {LINK_IRI.replace("STRING", "VARCHAR")}, 'label': {LINK_LABEL.replace("STRING", "VARCHAR")}, 'confidence': 0.9::DOUBLE}}, {{'iri': NULL::VARCHAR, 'label': 'Other', 'confidence': 0.5::DOUBLE}}][1 : o_orderkey % 3] AS links FROM orders),
properties AS (SELECT {_sql(PROPERTY)}, CASE WHEN o_orderkey % 3 = 1 THEN [{_PART.format(200)}] ELSE []::VARCHAR[] END AS domain_iris, [{_PART.format(150)}, 'urn:none'] AS range_iris FROM orders),
triples AS (SELECT {_sql(TRIPLE)}, CASE WHEN o_orderkey % 2 = 1 THEN {_PART.format(200)} END AS subject_iri, CASE WHEN o_orderkey % 5 = 0 THEN 'urn:rel/1' END AS predicate_iri,
  CASE WHEN o_orderkey % 3 = 1 THEN {INDIVIDUAL["ind_id"].replace("STRING", "VARCHAR")} END AS object_ind FROM orders)"""

_LINKED = "(subject_iri IS NOT NULL OR object_ind IS NOT NULL OR predicate_iri IS NOT NULL)"


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, \"start\", \"end\", mention, name, kind, array_to_string(list_transform(links, lambda x: coalesce(x.label, '')), '; ') AS class_labels, printf('%.4f', confidence) AS confidence, source, coalesce(normal_form, '') AS normal_form, coalesce(url, '') AS url FROM individuals")
def export_csv_individuals(spark, sf):
    return sections.csv_individuals(_sections(spark, sf).individuals)


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, \"start\", \"end\", text, coalesce(iri, '') AS iri, coalesce(label, '') AS label, printf('%.4f', confidence) AS confidence, source, coalesce(match_type, '') AS match_type, array_to_string(domain_iris, '; ') AS domain_iris, array_to_string(range_iris, '; ') AS range_iris FROM properties")
def export_csv_properties(spark, sf):
    return sections.csv_properties(_sections(spark, sf).properties)


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, subject, predicate, object, sentence, voice, CASE WHEN {_LINKED} THEN 'True' ELSE 'False' END AS has_link, coalesce(subject_iri, '') AS subject_iri, '' AS object_iri, coalesce(predicate_iri, '') AS predicate_iri, printf('%.4f', confidence) AS confidence FROM triples")
def export_csv_triples(spark, sf):
    return sections.csv_triples(_sections(spark, sf).triples)


_text = lambda name, c: f"',\"{name}\":\"' || {c} || '\"'"
_some = lambda name, c: f"CASE WHEN {c} IS NULL THEN '' ELSE {_text(name, c)} END"
_LINKS_JSON = """',"class_links":[' || array_to_string(list_transform(links, lambda x: '{' || CASE WHEN x.iri IS NULL THEN '' ELSE '"iri":"' || x.iri || '",' END || CASE WHEN x.label IS NULL THEN '' ELSE '"label":"' || x.label || '",' END || '"confidence":' || x.confidence || '}'), ',') || ']'"""
_LIST = lambda name, c: f"CASE WHEN len({c}) = 0 THEN '' ELSE ',\"{name}\":[\"' || array_to_string({c}, '\",\"') || '\"]' END"
_SPAN = "',\"start\":' || \"start\" || ',\"end\":' || \"end\""
_BODY = {
    "individual": f"""'"id":"' || ind_id || '"' || {_text("name", "name")} || {_text("mention_text", "mention")} || {_text("individual_type", "kind")} || {_SPAN} || {_LINKS_JSON} || ',"confidence":' || confidence || {_text("source", "source")} || {_some("normal_form", "normal_form")} || {_some("url", "url")}""",
    "property": f"""'"id":"' || prop_id || '"' || {_text("property_text", "text")} || {_some("iri", "iri")} || {_some("label", "label")} || {_SPAN} || ',"confidence":' || confidence || {_text("source", "source")} || {_some("match_type", "match_type")} || {_LIST("domain_iris", "domain_iris")} || {_LIST("range_iris", "range_iris")} || {_some("inverse_of", "inverse_of")}""",
    "triple": f"""'"id":"' || triple_id || '"' || {_text("subject", "subject")} || {_text("predicate", "predicate")} || {_text("object", "object")} || {_text("sentence", "sentence")} || {_text("voice", "voice")} || ',"confidence":' || confidence || {_text("source", "source")} || ',"has_link":' || {_LINKED} || {_some("subject_iri", "subject_iri")} || {_some("predicate_iri", "predicate_iri")}""",
}
_TABLE = {"individual": ("individuals", "ind_id"), "property": ("properties", "prop_id"), "triple": ("triples", "triple_id")}
_ANNOTATION_JSON = """'{"doc_id":' || doc_id || ',"ann_id":"' || ann_id || '","start":' || "start" || ',"end":' || "end" || ',"text":"' || text || '","iri":"' || iri || '","label":"' || label || '","branch":"' || branch || '","confidence":' || confidence || ',"state":"' || state || '"}'"""


@query(f"WITH {SECTIONS_SQL} SELECT doc_id, ann_id AS id, {_ANNOTATION_JSON} AS line FROM shown " + " ".join(f"""UNION ALL SELECT doc_id, {k}, '{{"record_type":"{kind}",' || {_BODY[kind]} || '}}' FROM {t}""" for kind, (t, k) in _TABLE.items()))
def export_jsonl_sections(spark, sf):
    return sections.json_lines(sections.shown(_sections(spark, sf)))


@query(
    f"""WITH {SECTIONS_SQL} SELECT doc_id, ann_id AS id, '{{"index":{{"_index":"annotations","_id":"' || ann_id || '"}}}}' || chr(10) || {_ANNOTATION_JSON} AS line FROM shown """
    + " ".join(f"""UNION ALL SELECT doc_id, {k}, '{{"index":{{"_index":"{t}","_id":"' || {k} || '"}}}}' || chr(10) || '{{"doc_id":' || doc_id || ',' || {_BODY[kind]} || '}}' FROM {t}""" for kind, (t, k) in _TABLE.items())
)
def export_bulk_sections(spark, sf):
    return sections.bulk_lines(sections.shown(_sections(spark, sf)))


_NODES_SQL = """nodes AS (SELECT id, kind, min(label) AS label FROM (SELECT 'doc:' || doc_id AS id, 'Document' AS kind, CAST(doc_id AS VARCHAR) AS label FROM (SELECT doc_id FROM shown UNION SELECT doc_id FROM individuals)
UNION ALL SELECT iri, 'Concept', label FROM shown UNION ALL SELECT 'ind:' || ind_id, 'Individual', name FROM individuals UNION ALL SELECT 'prop:' || prop_id, 'Property', coalesce(label, text) FROM properties) GROUP BY ALL)"""


@query(f"WITH {SECTIONS_SQL}, {_NODES_SQL} SELECT * FROM nodes")
def export_graph_nodes_sections(spark, sf):
    return sections.graph(sections.shown(_sections(spark, sf)))[0]


@query(
    f"""WITH {SECTIONS_SQL}, {_NODES_SQL}, relations AS (SELECT 'doc:' || doc_id AS source, 'CONTAINS_CONCEPT' AS relation, iri AS target FROM shown UNION SELECT 'doc:' || doc_id, 'CONTAINS_INDIVIDUAL', 'ind:' || ind_id FROM individuals
UNION SELECT 'ind:' || ind_id, 'INSTANCE_OF', l.iri FROM individuals, unnest(links) AS t(l) UNION SELECT 'doc:' || doc_id, 'CONTAINS_PROPERTY', 'prop:' || prop_id FROM properties
UNION SELECT 'prop:' || prop_id, 'HAS_DOMAIN', d FROM properties, unnest(domain_iris) AS t(d) UNION SELECT 'prop:' || prop_id, 'HAS_RANGE', d FROM properties, unnest(range_iris) AS t(d)
UNION SELECT subject_iri, 'AGREES_WITH', 'ind:' || object_ind FROM triples)
SELECT source, relation, target FROM relations WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)"""
)
def export_graph_relations_sections(spark, sf):
    return sections.graph(sections.shown(_sections(spark, sf)))[1]


_TARGET = "'<urn:document:' || doc_id || '#char=' || \"start\" || ',' || \"end\" || '>'"


@query(
    f"""WITH {SECTIONS_SQL}, facts AS (SELECT doc_id, ann_id AS id, '<urn:annotation:' || ann_id || '>' AS s, 'rdf:type' AS p, 'oa:Annotation' AS o FROM shown
UNION ALL SELECT doc_id, ann_id, '<urn:annotation:' || ann_id || '>', 'oa:hasBody', '<' || iri || '>' FROM shown UNION ALL SELECT doc_id, ann_id, '<urn:annotation:' || ann_id || '>', 'oa:hasTarget', {_TARGET} FROM shown
UNION ALL SELECT doc_id, ann_id, '<urn:annotation:' || ann_id || '>', 'ex:confidence', printf('"%.4f"^^xsd:decimal', confidence) FROM shown
UNION ALL SELECT doc_id, ind_id, '<urn:individual:' || ind_id || '>', f.p, f.o FROM (SELECT *, [{{'p': 'rdf:type', 'o': 'owl:NamedIndividual'}}, {{'p': 'rdfs:label', 'o': '"' || name || '"'}}, {{'p': 'oa:hasTarget', 'o': {_TARGET}}}] || list_transform(links, lambda x: {{'p': 'rdf:type', 'o': '<' || x.iri || '>'}}) AS fs FROM individuals), unnest(fs) AS t(f)
UNION ALL SELECT doc_id, prop_id, coalesce('<' || iri || '>', '<urn:property:' || prop_id || '>'), f.p, f.o FROM (SELECT *, [{{'p': 'rdf:type', 'o': 'owl:ObjectProperty'}}, {{'p': 'rdfs:label', 'o': '"' || label || '"'}}, {{'p': 'oa:hasTarget', 'o': {_TARGET}}}, {{'p': 'owl:inverseOf', 'o': '<' || inverse_of || '>'}}]
  || list_transform(domain_iris, lambda x: {{'p': 'rdfs:domain', 'o': '<' || x || '>'}}) || list_transform(range_iris, lambda x: {{'p': 'rdfs:range', 'o': '<' || x || '>'}}) AS fs FROM properties), unnest(fs) AS t(f)
UNION ALL SELECT doc_id, triple_id, '<urn:triple:' || triple_id || '>', f.p, f.o FROM triples, unnest([{{'p': 'rdf:type', 'o': 'rdf:Statement'}}, {{'p': 'rdf:subject', 'o': '"' || subject || '"'}}, {{'p': 'rdf:predicate', 'o': '"' || predicate || '"'}}, {{'p': 'rdf:object', 'o': '"' || object || '"'}},
  {{'p': 'ex:voice', 'o': '"' || voice || '"'}}, {{'p': 'ex:subjectRef', 'o': '<' || subject_iri || '>'}}, {{'p': 'ex:predicateRef', 'o': '<' || predicate_iri || '>'}}]) AS t(f))
SELECT doc_id, id, s || ' ' || p || ' ' || o || ' .' AS line FROM facts WHERE o IS NOT NULL"""
)
def export_turtle_sections(spark, sf):
    return sections.turtle(sections.shown(_sections(spark, sf)))


@query(
    f"""WITH {SECTIONS_SQL}, entities AS (
SELECT doc_id, 0 AS k, ann_id AS id, "start" AS s, "end" AS e, replace(min(branch), ' ', '_') AS label, text, flatten(list_transform(list_sort(list({{'iri': iri, 'label': label}})), lambda x: ['IRI@ ' || x.iri, 'Label@ ' || x.label])) AS attrs, NULL AS rel, 0 AS o FROM shown GROUP BY ALL
UNION ALL SELECT doc_id, 1, ind_id, "start", "end", coalesce(replace(links[1].label, ' ', '_'), upper(replace(kind, ' ', '_'))), mention, list_concat(CASE WHEN name <> mention THEN ['CanonicalName@ ' || name] ELSE [] END, list_transform(list_filter(links, lambda x: x.iri IS NOT NULL), lambda x: 'IRI@ ' || x.iri)), NULL, 0 FROM individuals
UNION ALL SELECT doc_id, 2, prop_id, "start", "end", coalesce(replace(label, ' ', '_'), 'PROPERTY'), text, CASE WHEN iri IS NULL THEN [] ELSE ['IRI@ ' || iri] END, NULL, 0 FROM properties
UNION ALL SELECT doc_id, 3, triple_id, subject_start, subject_end, 'TRIPLE_SUBJECT', subject, [], NULL, 1 FROM triples WHERE subject_start IS NOT NULL
UNION ALL SELECT doc_id, 3, triple_id, object_start, object_end, 'TRIPLE_OBJECT', object, [], replace(predicate, ' ', '_'), 2 FROM triples WHERE subject_start IS NOT NULL),
numbered AS (SELECT *, row_number() OVER w AS t, coalesce(sum(len(attrs)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a0, count(rel) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM entities
  WINDOW w AS (PARTITION BY doc_id ORDER BY k, CASE WHEN k < 3 THEN s END NULLS FIRST, CASE WHEN k < 3 THEN e END NULLS FIRST, id, o, text))
SELECT doc_id, 'T' || t || chr(9) || label || ' ' || s || ' ' || e || chr(9) || text AS line FROM numbered
UNION ALL SELECT doc_id, 'A' || CAST(a0 + i AS BIGINT) || chr(9) || replace(attrs[i], '@ ', ' T' || t || ' ') FROM numbered, unnest(range(1, len(attrs) + 1)) AS x(i)
UNION ALL SELECT doc_id, 'R' || r || chr(9) || rel || ' Arg1:T' || (t - 1) || ' Arg2:T' || t FROM numbered WHERE rel IS NOT NULL"""
)
def export_standoff_sections(spark, sf):
    return sections.standoff(sections.shown(_sections(spark, sf))).select("doc_id", "line")


@query(
    f"""WITH {SECTIONS_SQL}, a AS (SELECT doc_id, count(DISTINCT ann_id) AS n_annotations, count(DISTINCT iri) AS n_concepts FROM shown GROUP BY ALL), i AS (SELECT doc_id, count(*) AS n_individuals, count(*) FILTER (kind = 'legal_citation') AS n_citations, count(*) FILTER (kind = 'named_entity') AS n_entities FROM individuals GROUP BY ALL),
p AS (SELECT doc_id, count(*) AS n_properties, count(DISTINCT iri) AS n_distinct_properties FROM properties GROUP BY ALL), t AS (SELECT doc_id, count(*) AS n_triples, count(*) FILTER ({_LINKED}) AS n_linked_triples FROM triples GROUP BY ALL)
SELECT doc_id, coalesce(n_annotations, 0) AS n_annotations, coalesce(n_concepts, 0) AS n_concepts, coalesce(n_individuals, 0) AS n_individuals, coalesce(n_citations, 0) AS n_citations, coalesce(n_entities, 0) AS n_entities, coalesce(n_properties, 0) AS n_properties, coalesce(n_distinct_properties, 0) AS n_distinct_properties,
coalesce(n_triples, 0) AS n_triples, coalesce(n_linked_triples, 0) AS n_linked_triples FROM a FULL JOIN i USING (doc_id) FULL JOIN p USING (doc_id) FULL JOIN t USING (doc_id)"""
)
def export_statistics_sections(spark, sf):
    return sections.statistics(sections.shown(_sections(spark, sf)))


@query(f"""WITH {SECTIONS_SQL} SELECT doc_id, len(list(name)) AS n_individuals, '{{' || min({_BODY["property"]}) || '}}' AS property, '{{' || min({_BODY["triple"]}) || '}}' AS triple FROM (SELECT i.doc_id, i.name, p.* EXCLUDE (doc_id), t.* EXCLUDE (doc_id, confidence, source) FROM individuals i JOIN properties p USING (doc_id) JOIN triples t USING (doc_id)) GROUP BY ALL""".replace(_BODY["triple"], "'\"id\":\"' || triple_id || '\"'"))
def export_json_objects(spark, sf):
    """The one individual, property and triple of each order, read back from the object's JSON."""
    s = sections.objects(_sections(spark, sf)).filter("individuals IS NOT NULL").select("doc_id", F.to_json(F.struct("*")).alias("line"))
    part = lambda path: F.get_json_object("line", path)
    return s.select("doc_id", F.json_array_length(part("$.individuals")).cast("long").alias("n_individuals"), part("$.properties[0]").alias("property"), F.concat(F.lit('{"id":"'), part("$.triples[0].id"), F.lit('"}')).alias("triple"))

