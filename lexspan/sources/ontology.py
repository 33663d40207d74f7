"""Ontologies: classes read from OWL, and dimensions kept in versioned folders with a pointer to the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.constants import BRANCHES, EXCLUDED_BRANCHES, VIRTUAL_BRANCHES

#: The name spaces of an ontology's file.
SPACES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#", "xml": "http://www.w3.org/XML/1998/namespace"}
_TEXT = "array<struct<_VALUE:string,`_xml:lang`:string>>"
_LINKS = "array<struct<`_rdf:resource`:string>>"
_CLASS = f"`_rdf:about` string, `rdfs:label` {_TEXT}, `skos:definition` {_TEXT}, `skos:prefLabel` {_TEXT}, `skos:altLabel` {_TEXT}, `skos:example` {_TEXT}, `rdfs:subClassOf` {_LINKS}, `rdfs:seeAlso` {_LINKS}, `owl:deprecated` {_TEXT}"
_PROPERTY = f"`_rdf:about` string, `rdfs:label` {_TEXT}, `skos:definition` {_TEXT}, `skos:prefLabel` {_TEXT}, `skos:altLabel` {_TEXT}, `rdfs:domain` {_LINKS}, `rdfs:range` {_LINKS}, `owl:inverseOf` {_LINKS}, `owl:deprecated` {_TEXT}"
_INDIVIDUAL = f"`_rdf:about` string, `rdfs:label` {_TEXT}, `rdf:type` {_LINKS}"


def _tagged(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).filter("`_rdf:about` IS NOT NULL")


def _texts(name: str, language: bool = False) -> Column:
    """An element's texts: those without a language, or those with one."""
    c = F.coalesce(F.col(f"`{name}`"), F.array().cast(_TEXT))
    kept = F.filter(c, lambda x: x["_VALUE"].isNotNull() & (x["_xml:lang"].isNotNull() if language else x["_xml:lang"].isNull()))
    return kept if language else F.transform(kept, lambda x: x["_VALUE"])


def _first(name: str) -> Column:
    """An element's text without a language, else in English, else the first."""
    c = F.filter(F.col(f"`{name}`"), lambda x: x["_VALUE"].isNotNull())
    plain, english = F.filter(c, lambda x: x["_xml:lang"].isNull()), F.filter(c, lambda x: F.startswith(x["_xml:lang"], F.lit("en")))
    return F.coalesce(F.get(plain, F.lit(0)), F.get(english, F.lit(0)), F.get(c, F.lit(0)))["_VALUE"]


def _links(name: str) -> Column:
    return F.filter(F.transform(F.coalesce(F.col(f"`{name}`"), F.array().cast(_LINKS)), lambda p: p["_rdf:resource"]), lambda x: x.isNotNull())


_deprecated = lambda: F.coalesce(F.lower(_first("owl:deprecated")) == "true", F.lit(False)).alias("deprecated")


def read_owl(spark: SparkSession, path: str) -> DataFrame:
    """Classes of an RDF/XML file: (iri, label, definition, preferred_label, parents, see_also, alternatives, translations map<string,string>, examples, deprecated).

    Alternative labels with a language are translations, the least of several in one language. Classes without an iri, such as restrictions, are none.
    """
    by_language = F.array_sort(F.transform(_texts("skos:altLabel", True), lambda x: F.struct(x["_xml:lang"].alias("key"), x["_VALUE"].alias("value"))))
    once = F.filter(by_language, lambda x, i: (i == 0) | (F.get(by_language, i - 1)["key"] != x["key"]))
    return _tagged(spark, path, "owl:Class", _CLASS).select(
        F.col("`_rdf:about`").alias("iri"),
        _first("rdfs:label").alias("label"),
        _first("skos:definition").alias("definition"),
        _first("skos:prefLabel").alias("preferred_label"),
        _links("rdfs:subClassOf").alias("parents"),
        _links("rdfs:seeAlso").alias("see_also"),
        _texts("skos:altLabel").alias("alternatives"),
        F.map_from_entries(once).alias("translations"),
        _texts("skos:example").alias("examples"),
        _deprecated(),
    )


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Object properties of an RDF/XML file: (iri, label, definition, preferred_label, alternatives, domains, ranges, inverse, deprecated)."""
    return _tagged(spark, path, "owl:ObjectProperty", _PROPERTY).select(
        F.col("`_rdf:about`").alias("iri"),
        _first("rdfs:label").alias("label"),
        _first("skos:definition").alias("definition"),
        _first("skos:prefLabel").alias("preferred_label"),
        _texts("skos:altLabel").alias("alternatives"),
        _links("rdfs:domain").alias("domains"),
        _links("rdfs:range").alias("ranges"),
        F.get(_links("owl:inverseOf"), F.lit(0)).alias("inverse"),
        _deprecated(),
    )


def read_individuals(spark: SparkSession, path: str) -> DataFrame:
    """Named individuals of an RDF/XML file: (iri, label, types)."""
    return _tagged(spark, path, "owl:NamedIndividual", _INDIVIDUAL).select(F.col("`_rdf:about`").alias("iri"), _first("rdfs:label").alias("label"), _links("rdf:type").alias("types"))


def _written(df: DataFrame, path: str, tag: str) -> None:
    root = "rdf:RDF " + " ".join(f'xmlns:{k}="{v}"' for k, v in SPACES.items() if k != "xml")
    df.write.mode("append").format("xml").option("rowTag", tag).option("rootTag", root).option("validateName", "false").save(path)


def _said(c: str, language: Column | None = None) -> Column:
    """A text, or null, as an element's list."""
    none = F.lit(None).cast("string")
    return F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(c).alias("_VALUE"), (none if language is None else language).alias("_xml:lang"))))


def _each(c: str) -> Column:
    return F.transform(F.col(c), lambda x: F.struct(x.alias("_VALUE"), F.lit(None).cast("string").alias("_xml:lang")))


def _linked(c: Column) -> Column:
    return F.transform(c, lambda x: F.struct(x.alias("_rdf:resource")))


def write_owl(path: str, concepts: DataFrame | None = None, properties: DataFrame | None = None) -> None:
    """Classes and object properties, as the readers give them, as RDF/XML files in one folder, which the readers take as one ontology."""
    deprecated = F.when(F.col("deprecated"), F.array(F.struct(F.lit("true").alias("_VALUE"), F.lit(None).cast("string").alias("_xml:lang")))).alias("owl:deprecated")
    if concepts is not None:
        translated = F.transform(F.map_entries(F.coalesce("translations", F.create_map().cast("map<string,string>"))), lambda x: F.struct(x["value"].alias("_VALUE"), x["key"].alias("_xml:lang"))) if "translations" in concepts.columns else F.array().cast(_TEXT)
        names = F.concat(F.coalesce(_each("alternatives"), F.array().cast(_TEXT)), translated).alias("skos:altLabel")
        _written(concepts.select(F.col("iri").alias("_rdf:about"), _said("label").alias("rdfs:label"), _said("definition").alias("skos:definition"), _said("preferred_label").alias("skos:prefLabel"), names, _each("examples").alias("skos:example"), _linked(F.col("parents")).alias("rdfs:subClassOf"), _linked(F.col("see_also")).alias("rdfs:seeAlso"), deprecated), path, "owl:Class")
    if properties is not None:
        inverse = F.when(F.col("inverse").isNotNull(), F.array("inverse"))
        _written(properties.select(F.col("iri").alias("_rdf:about"), _said("label").alias("rdfs:label"), _said("definition").alias("skos:definition"), _said("preferred_label").alias("skos:prefLabel"), _each("alternatives").alias("skos:altLabel"), _linked(F.col("domains")).alias("rdfs:domain"), _linked(F.col("ranges")).alias("rdfs:range"), _linked(inverse).alias("owl:inverseOf"), deprecated), path, "owl:ObjectProperty")


def edges(concepts: DataFrame) -> DataFrame:
    """(child, parent, ord)."""
    return concepts.select(F.col("iri").alias("child"), F.posexplode("parents").alias("ord", "parent"))


def labels(concepts: DataFrame) -> DataFrame:
    """(iri, label, label_type), a row for each label."""
    preferred = concepts.select("iri", "label", F.lit("preferred").alias("label_type"))
    return preferred.unionByName(concepts.select("iri", F.explode("alternatives").alias("label"), F.lit("alternative").alias("label_type"))).filter("label IS NOT NULL")


def branches(spark: SparkSession) -> DataFrame:
    """(key, name, color): the dimension of branches."""
    return spark.createDataFrame([(k, *v) for k, v in BRANCHES.items()], "key string, name string, color string")


def actual_branches(c: Column) -> Column:
    """An array of branch names with those that stand for others replaced by them."""
    parts = F.transform(c, lambda x: F.coalesce(*[F.when(x == k, F.array(*[F.lit(t) for t in v])) for k, v in VIRTUAL_BRANCHES.items()], F.array(x)))
    return F.array_distinct(F.flatten(parts))


def live(concepts: DataFrame, own_types: str | None = None, excluded: tuple[str, ...] = EXCLUDED_BRANCHES) -> DataFrame:
    """Concepts (branch, deprecated) that are neither deprecated nor of an excluded branch, nor of the ontology's branch of its own types."""
    out = [*excluded, *([own_types] if own_types else [])]
    return concepts.filter(~F.coalesce(F.col("branch").isin(*out), F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))


def publish(df: DataFrame, root: str, version: int) -> None:
    """Writes a version, then points to it; readers of the old one aren't disturbed."""
    df.write.mode("errorifexists").parquet(f"{root}/v={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{root}/current")


def current(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    """The newest version published, or the one ``back`` steps before it."""
    found = spark.read.schema("version long").json(f"{root}/current").distinct().orderBy(F.col("version").desc()).limit(back + 1).collect()
    return spark.read.parquet(f"{root}/v={found[-1]['version']}")
