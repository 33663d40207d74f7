"""All that a document's job holds, in each format: annotations, individuals, properties and triples.

A row each; lists are arrays of structs, so nothing is gathered but for formats that are one object a document.

annotations  doc_id, ann_id, start, end, text, iri, label, branch, confidence, state (a row for each concept)
individuals  doc_id, ind_id, name, mention, kind, start, end, links array<struct<iri, label, confidence>>, confidence, source, normal_form, url
properties   doc_id, prop_id, text, iri, label, start, end, confidence, source, match_type, domain_iris, range_iris array<string>, inverse_of
triples      doc_id, triple_id, subject, predicate, object, sentence, voice, confidence, source, subject_links, predicate_links, object_links
             array<struct<kind, id, iri>>, subject_start, subject_end, object_start, object_end (null where a span isn't known)
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.functions.text import relation_name
from lexspan.sinks import export


class Sections(NamedTuple):
    annotations: DataFrame
    individuals: DataFrame
    properties: DataFrame
    triples: DataFrame


def _four(c: str) -> Column:
    return F.format_string("%.4f", F.col(c)).alias(c)


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)


def first_iri(links: str) -> Column:
    """The first link's iri that isn't null."""
    return F.get(F.filter(links, lambda x: x["iri"].isNotNull()), F.lit(0))["iri"]


def has_link() -> Column:
    return (F.size("subject_links") > 0) | (F.size("object_links") > 0) | (F.size("predicate_links") > 0)


def csv_individuals(i: DataFrame) -> DataFrame:
    labels = F.array_join(F.transform("links", lambda x: F.coalesce(x["label"], F.lit(""))), "; ")
    return i.select("doc_id", "start", "end", "mention", "name", "kind", labels.alias("class_labels"), _four("confidence"), "source", _or_empty("normal_form"), _or_empty("url"))


def csv_properties(p: DataFrame) -> DataFrame:
    return p.select("doc_id", "start", "end", "text", _or_empty("iri"), _or_empty("label"), _four("confidence"), "source", _or_empty("match_type"), F.array_join("domain_iris", "; ").alias("domain_iris"), F.array_join("range_iris", "; ").alias("range_iris"))


def csv_triples(t: DataFrame) -> DataFrame:
    linked = F.when(has_link(), "True").otherwise("False").alias("has_link")
    iris = [F.coalesce(first_iri(f"{x}_links"), F.lit("")).alias(f"{x}_iri") for x in ("subject", "object", "predicate")]
    return t.select("doc_id", "subject", "predicate", "object", "sentence", "voice", linked, *iris, _four("confidence"))


def _individual() -> Column:
    return F.struct(F.col("ind_id").alias("id"), "name", F.col("mention").alias("mention_text"), F.col("kind").alias("individual_type"), "start", "end", F.col("links").alias("class_links"), "confidence", "source", "normal_form", "url")


def _property() -> Column:
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return F.struct(F.col("prop_id").alias("id"), F.col("text").alias("property_text"), "iri", "label", "start", "end", "confidence", "source", "match_type", some("domain_iris"), some("range_iris"), "inverse_of")


def _triple() -> Column:
    return F.struct(F.col("triple_id").alias("id"), "subject", "predicate", "object", "sentence", "voice", "confidence", "source", has_link().alias("has_link"), *[first_iri(f"{x}_links").alias(f"{x}_iri") for x in ("subject", "object", "predicate")])


_OBJECTS = {"individual": ("ind_id", _individual), "property": ("prop_id", _property), "triple": ("triple_id", _triple)}


def _rest(s: Sections) -> list[tuple[str, DataFrame]]:
    return list(zip(_OBJECTS, (s.individuals, s.properties, s.triples), strict=True))


def json_lines(s: Sections) -> DataFrame:
    """(doc_id, id, line): a record for each entity; those that are no annotations say what they are. Null fields are left out."""
    out = export.json_lines(s.annotations).select("doc_id", F.col("ann_id").alias("id"), "line")
    for kind, df in _rest(s):
        key, made = _OBJECTS[kind]
        line = F.concat(F.lit(f'{{"record_type":"{kind}",'), F.substring(F.to_json(made()), 2, 1 << 30))  # the object's own fields, after the type
        out = out.unionByName(df.select("doc_id", F.col(key).alias("id"), line.alias("line")))
    return out


def bulk_lines(s: Sections, prefix: str = "") -> DataFrame:
    """(doc_id, id, line) for a search index's bulk format: an action and a document, in an index for each section."""
    out = export.bulk_lines(s.annotations, f"{prefix}annotations").select("doc_id", F.col("ann_id").alias("id"), "line")
    for (kind, df), index in zip(_rest(s), ("individuals", "properties", "triples"), strict=True):
        key, made = _OBJECTS[kind]
        action = F.to_json(F.struct(F.struct(F.lit(f"{prefix}{index}").alias("_index"), F.col(key).alias("_id")).alias("index")))
        document = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(","), F.substring(F.to_json(made()), 2, 1 << 30))
        out = out.unionByName(df.select("doc_id", F.col(key).alias("id"), F.concat_ws("\n", action, document).alias("line")))
    return out


def graph(s: Sections) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label), each once, and relations (source, relation, target), each once, whose ends are nodes.

    Documents contain concepts, individuals and properties; individuals are instances of concepts; properties have domains and
    ranges; triples go from what their subject is linked with first, an individual or a concept, to what their object is.
    """
    doc, ind, prop = (F.concat(F.lit(x), F.col(c)) for x, c in (("doc:", "doc_id"), ("ind:", "ind_id"), ("prop:", "prop_id")))
    a, i, p, t = (x.select("doc_id") for x in s)
    docs = a.unionByName(i).unionByName(p).unionByName(t).distinct()
    # ids of different kinds never meet, so each kind is told apart by its own key
    node = lambda df, key, i, kind, label: df.select(F.col(key), label.alias("label")).groupBy(key).agg(F.min("label").alias("label")).select(i.alias("id"), F.lit(kind).alias("kind"), "label")
    nodes = export.document_nodes(docs).unionByName(export.concept_nodes(s.annotations))
    nodes = nodes.unionByName(node(s.individuals, "ind_id", ind, "Individual", F.col("name"))).unionByName(node(s.properties, "prop_id", prop, "Property", F.coalesce("label", "text")))
    edge = lambda df, a, r, b: df.select(a.alias("source"), (r if isinstance(r, Column) else F.lit(r)).alias("relation"), b.alias("target"))
    each = lambda df, c: df.withColumn("to", F.explode(c))
    end = lambda c: F.get(F.filter(F.transform(c, lambda x: F.when(x["kind"] == "individual", F.concat(F.lit("ind:"), x["id"])).when(x["kind"] == "concept", x["iri"])), lambda x: x.isNotNull()), F.lit(0))
    contains = [export.contained(s.annotations), edge(s.individuals, doc, "CONTAINS_INDIVIDUAL", ind), edge(s.properties, doc, "CONTAINS_PROPERTY", prop)]  # their ends are nodes as they are
    refers = edge(each(s.individuals, "links"), ind, "INSTANCE_OF", F.col("to.iri"))
    for name, to in (("HAS_DOMAIN", "domain_iris"), ("HAS_RANGE", "range_iris")):
        refers = refers.unionByName(edge(each(s.properties, to), prop, name, F.col("to")))
    ids = docs.select(F.concat(F.lit("doc:"), "doc_id").alias("id"))
    for x in (s.annotations.select(F.col("iri").alias("id")).distinct(), s.individuals.select(ind.alias("id")), s.properties.select(prop.alias("id"))):
        ids = ids.unionByName(x)
    among = lambda df, c: df.join(ids.withColumnRenamed("id", c), c, "left_semi")
    stated = among(edge(s.triples, end("subject_links"), relation_name(F.col("predicate")), end("object_links")).filter("source IS NOT NULL AND target IS NOT NULL"), "source")
    found = among(refers.unionByName(stated).filter("source IS NOT NULL AND target IS NOT NULL"), "target").select("source", "relation", "target")
    for x in contains:
        found = found.unionByName(x)
    return nodes, found.filter("source IS NOT NULL AND target IS NOT NULL").distinct()


def _quoted(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def turtle(s: Sections) -> DataFrame:
    """(doc_id, id, line): facts of annotations, and of individuals, properties and statements; a fact without an object is left out."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    urn = lambda kind, c: F.concat(F.lit(f"<urn:{kind}:"), F.col(c), F.lit(">"))
    fact = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    many = lambda p, c: F.transform(c, lambda o: F.struct(F.lit(p).alias("p"), iri(o).alias("o")))
    place = lambda a="start", z="end": F.concat(F.lit("<urn:document:"), F.col("doc_id"), F.lit("#char="), F.col(a), F.lit(","), F.col(z), F.lit(">"))
    refs = lambda c: F.transform(F.filter(c, lambda x: x["iri"].isNotNull()), lambda x: x["iri"])

    def lines(df: DataFrame, key: str, subject: Column, facts: Column) -> DataFrame:
        rows = df.select("doc_id", F.col(key).alias("id"), subject.alias("s"), F.explode(F.filter(facts, lambda f: f["o"].isNotNull())).alias("f"))
        return rows.select("doc_id", "id", F.concat_ws(" ", "s", "f.p", "f.o", F.lit(".")).alias("line"))

    individuals = F.concat(F.array(fact("rdf:type", F.lit("owl:NamedIndividual")), fact("rdfs:label", _quoted(F.col("name"))), fact("oa:hasTarget", place())), many("rdf:type", refs("links")))
    properties = F.concat(F.array(fact("rdf:type", F.lit("owl:ObjectProperty")), fact("rdfs:label", _quoted(F.col("label"))), fact("oa:hasTarget", place()), fact("owl:inverseOf", iri(F.col("inverse_of")))), many("rdfs:domain", F.col("domain_iris")), many("rdfs:range", F.col("range_iris")))
    statements = F.concat(
        F.array(fact("rdf:type", F.lit("rdf:Statement")), *[fact(f"rdf:{x}", _quoted(F.col(x))) for x in ("subject", "predicate", "object")], fact("ex:voice", _quoted(F.col("voice")))),
        *[many(f"ex:{x}Ref", refs(f"{x}_links")) for x in ("subject", "object", "predicate")],
    )
    out = export.turtle(s.annotations).select("doc_id", F.col("ann_id").alias("id"), "line")
    out = out.unionByName(lines(s.individuals, "ind_id", urn("individual", "ind_id"), individuals))
    out = out.unionByName(lines(s.properties, "prop_id", F.coalesce(iri(F.col("iri")), urn("property", "prop_id")), properties))
    return out.unionByName(lines(s.triples, "triple_id", urn("triple", "triple_id"), statements))


def standoff(s: Sections) -> DataFrame:
    """(doc_id, ord, line): text-bound lines T, attributes A and relations R, each numbered through a document: annotations first,
    then individuals, properties, and the two ends of triples whose spans are known. ``ord`` orders a document's lines.

    An annotation with several concepts is one T line with the attributes of each.
    """
    flat = lambda c: F.regexp_replace(c, r"\s+", " ")
    name = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    attribute = lambda k, v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(k).alias("k"), flat(v).alias("v")))
    none = F.lit(None).cast("string")
    concepts = F.array_sort(F.collect_list(F.struct("iri", "label")))
    a = s.annotations.groupBy("doc_id", "ann_id", "start", "end", "text").agg(F.min("branch").alias("branch"), concepts.alias("c"))
    entity = lambda df, kind, key, label, text, attributes, start="start", end="end", relation=none: df.select("doc_id", F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(start).alias("start"), F.col(end).alias("end"), label.alias("label"), flat(text).alias("text"), F.array_compact(attributes).alias("attributes"), relation.alias("relation"))
    rows = entity(a, 0, "ann_id", F.coalesce(name(F.col("branch")), F.lit("CONCEPT")), F.col("text"), F.flatten(F.transform("c", lambda x: F.array(attribute("IRI", x["iri"]), attribute("Label", x["label"])))))
    of_class = F.get("links", F.lit(0))["label"]
    links = F.transform("links", lambda x: attribute("IRI", x["iri"]))
    rows = rows.unionByName(entity(s.individuals, 1, "ind_id", F.coalesce(name(of_class), F.upper(name(F.col("kind")))), F.col("mention"), F.concat(F.array(F.when(F.col("name") != F.col("mention"), F.struct(F.lit("CanonicalName").alias("k"), flat(F.col("name")).alias("v")))), links)))
    rows = rows.unionByName(entity(s.properties, 2, "prop_id", F.coalesce(name(F.col("label")), F.lit("PROPERTY")), F.col("text"), F.array(attribute("IRI", F.col("iri")))))
    both = s.triples.filter("subject_start IS NOT NULL AND object_start IS NOT NULL")
    empty = F.array(attribute("IRI", none))
    for i, x in enumerate(("subject", "object")):
        rows = rows.unionByName(entity(both, 3, "triple_id", F.lit(f"TRIPLE_{x.upper()}"), F.col(x), empty, f"{x}_start", f"{x}_end", name(F.col("predicate")) if i else none))
    ends = F.when(F.col("kind") < 3, 0).when(F.col("label") == "TRIPLE_SUBJECT", 1).otherwise(2)
    place = [F.col("kind"), F.when(F.col("kind") < 3, F.col("start")), F.when(F.col("kind") < 3, F.col("end")), F.col("id"), ends, F.col("text")]
    w = W.partitionBy("doc_id").orderBy(*place)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumns({"t": F.row_number().over(w), "a0": F.coalesce(F.sum(F.size("attributes")).over(before), F.lit(0)), "r": F.count("relation").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))})
    text = F.struct(F.lit(0).alias("o"), F.concat(F.lit("T"), F.col("t"), F.lit("\t"), F.col("label"), F.lit(" "), F.col("start"), F.lit(" "), F.col("end"), F.lit("\t"), F.col("text")).alias("line"))
    attributes = F.transform("attributes", lambda x, i: F.struct((i + 1).alias("o"), F.concat(F.lit("A"), F.col("a0") + i + 1, F.lit("\t"), x["k"], F.lit(" T"), F.col("t"), F.lit(" "), x["v"]).alias("line")))
    relation = F.struct(F.lit(1 << 20).alias("o"), F.concat(F.lit("R"), F.col("r"), F.lit("\t"), F.col("relation"), F.lit(" Arg1:T"), F.col("t") - 1, F.lit(" Arg2:T"), F.col("t")).alias("line"))
    lines = F.concat(F.array(text), attributes, F.when(F.col("relation").isNotNull(), F.array(relation)).otherwise(F.slice(F.array(relation), 1, 0)))
    each = numbered.select("doc_id", "t", F.explode(lines).alias("x"))
    return each.select("doc_id", F.struct("t", "x.o").alias("ord"), "x.line")


def statistics(s: Sections) -> DataFrame:
    """(doc_id and nine counts) of each document that has anything."""
    a = s.annotations.groupBy("doc_id").agg(F.countDistinct("ann_id").alias("n_annotations"), F.countDistinct("iri").alias("n_concepts"))
    i = s.individuals.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_individuals"), F.count_if(F.col("kind") == "legal_citation").alias("n_citations"), F.count_if(F.col("kind") == "named_entity").alias("n_entities"))
    p = s.properties.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_properties"), F.countDistinct("iri").alias("n_distinct_properties"))
    t = s.triples.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_triples"), F.count_if(has_link()).alias("n_linked_triples"))
    return a.join(i, "doc_id", "full").join(p, "doc_id", "full").join(t, "doc_id", "full").na.fill(0)


def objects(s: Sections) -> DataFrame:
    """One row a document with its four lists, in order, and its statistics: what JSON and XML are written from."""
    gathered = lambda df, name, x, *order: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, x.alias("x")))), lambda r: r["x"]).alias(name))
    concept = F.struct("ann_id", "start", "end", "text", "iri", "label", "branch", "confidence", "state")
    out = statistics(s)
    out = out.select("doc_id", F.struct(*[c for c in out.columns if c != "doc_id"]).alias("statistics"))
    for df, name, x, key in ((s.annotations, "annotations", concept, "ann_id"), (s.individuals, "individuals", _individual(), "ind_id"), (s.properties, "properties", _property(), "prop_id")):
        out = out.join(gathered(df, name, x, "start", "end", key), "doc_id", "left")
    return out.join(gathered(s.triples, "triples", _triple(), "triple_id"), "doc_id", "left").select("doc_id", "annotations", "individuals", "properties", "triples", "statistics")


def shown(s: Sections, include_dismissed: bool = False) -> Sections:
    return s._replace(annotations=export.shown(s.annotations, include_dismissed))


def _folders(tables: dict[str, DataFrame], path: str, write) -> None:
    for name, df in tables.items():
        write(df, f"{path}/{name}")


def _text(make):
    return lambda s, path: make(s).select("line").write.text(path)


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def _standoff(s: Sections, path: str) -> None:
    """Many documents to a file, each after a line ``# doc_id``, and beside them how many lines each has: (doc_id, n_lines)."""
    lines = standoff(s)
    head = F.struct(F.lit(0).alias("t"), F.lit(0).alias("o")).cast(lines.schema["ord"].dataType)
    counted = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    every = lines.unionByName(counted.select("doc_id", head.alias("ord"), F.concat(F.lit("# "), F.col("doc_id").cast("string")).alias("line")))
    every.repartition("doc_id").sortWithinPartitions("doc_id", "ord").select("line").write.text(f"{path}/lines")
    counted.write.parquet(f"{path}/index")


#: Writers of all sections by format: each takes sections and a path.
WRITERS = {
    "csv": lambda s, path: _folders({"annotations": export.csv_rows(s.annotations), "individuals": csv_individuals(s.individuals), "properties": csv_properties(s.properties), "triples": csv_triples(s.triples)}, path, _csv),
    "json": lambda s, path: objects(s).select(F.to_json(F.struct("*")).alias("line")).write.text(path),
    "jsonl": _text(json_lines),
    "xml": lambda s, path: objects(s).write.format("xml").option("rowTag", "document").option("rootTag", "documents").save(path),
    "parquet": lambda s, path: _folders(s._asdict(), path, lambda df, p: df.write.parquet(p)),
    "elasticsearch": _text(bulk_lines),
    "neo4j": lambda s, path: _folders(dict(zip(("nodes", "relations"), graph(s), strict=True)), path, _csv),
    "rdf": _text(turtle),
    "brat": _standoff,
}


def register(name: str, write) -> None:
    WRITERS[name] = write


def write(s: Sections, name: str, path: str, include_dismissed: bool = False) -> None:
    if name not in WRITERS:
        raise KeyError(f"no writer for {name}; there are {', '.join(sorted(WRITERS))}")
    WRITERS[name](shown(s, include_dismissed), path)
