"""The tables that queries run on, made from the driver's tables: the same rows in Spark and in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.constants import ALTERNATIVE_STOP, PATTERN_STOP
from lexspan.operators.lexicon import admitted
from lexspan.staging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of one partition of a shuffle at most, on average, before Spark joins small ones; and bytes of a scan's and of a joined one.
ROWS, SCAN_BYTES, JOINED_BYTES = 400_000, 32 << 20, 16 << 20
_sized: dict[tuple[int, int], SparkSession] = {}


def sized(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """A session of the same application with the settings of ``spark``, but for as many partitions as the tables' rows ask for: what a task sorts or holds stays as it is when they grow."""
    rows = sum(table(spark, sf_dir, n).count() for n in names)
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    own = _sized.get((id(spark), wanted))
    if own is None or own.sparkContext is not spark.sparkContext:
        own = _sized[id(spark), wanted] = spark.newSession()
    most = {"spark.sql.files.maxPartitionBytes": SCAN_BYTES, "spark.sql.adaptive.advisoryPartitionSizeInBytes": JOINED_BYTES, "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 2 * JOINED_BYTES}
    settings = {"spark.sql.shuffle.partitions": str(wanted), **{k: str(v) for k, v in most.items()}}
    for key, value in {**spark.conf.getAll, **settings}.items():
        if own.conf.get(key, None) != value and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, for scans by Python code."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Annotations: a span for each line of an order, with the part as its concept.
ANNOTATION = {
    "doc_id": "l_orderkey",
    "ann_id": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))",
    "start": "CAST(l_linenumber * 40 + l_suppkey % 30 AS INT)",
    "end": "CAST(l_linenumber * 40 + l_suppkey % 30 + CAST(l_quantity AS INT) AS INT)",
    "text": "concat('Part ', CAST(l_partkey AS STRING))",
    "iri": "concat('urn:part/', CAST(l_partkey AS STRING))",
    "label": "concat('part ', CAST(l_partkey AS STRING))",
    "branch": "concat('Branch ', l_linestatus)",
    "confidence": "CAST(l_quantity AS DOUBLE) / 50",
    "state": "CASE WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'preliminary' END",
}


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in ANNOTATION.items()])


ANNOTATIONS_SQL = "annotations AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS \"{c}\"" for c, e in ANNOTATION.items()) + " FROM lineitem)"

#: Annotations with three concepts each.
STACKED = {
    "ann_id": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))",
    "a": "concat('urn:part/', CAST(l_partkey AS STRING))",
    "b": "concat('urn:supplier/', CAST(l_suppkey AS STRING))",
    "c": "concat('urn:line/', CAST(l_linenumber AS STRING))",
    "state": ANNOTATION["state"],
    "k": "CAST(l_linenumber % 4 AS INT)",
}


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in STACKED.items()])
    concept = lambda c: F.struct(F.col(c).alias("iri"), F.col(c).alias("label"), F.lit(0.5).alias("confidence"), F.lit("preliminary").alias("state"))
    return rows.select("ann_id", "state", "k", F.array(concept("a"), concept("b"), concept("c")).alias("concepts"), F.array(F.lit("made")).alias("lineage"))


STACKED_SQL = "stacked AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in STACKED.items()) + " FROM lineitem)"

#: Sentences that hold what the extractors look for, and some that only seem to. A template is a list of literals, fields (expressions in
#: braces) and finds, ``(extractor, pieces)``; a find of a definition is its term alone, within its quotes.
TEMPLATES: list[list] = [
    [
        "On ", ("date", ["{CAST(CAST(o_orderdate AS DATE) AS STRING)}"]), " buyer {o_custkey} shall pay ", ("money", ["${CAST(o_totalprice AS DECIMAL(18, 2))}"]), " within ", ("duration", ["{o_orderkey % 90 + 1} business days"]),
        ", ", ("constraint", ["at least"]), " ", ("percent", ["{o_orderkey % 20}.5%"]), " up front, ", ("condition", ["provided that"]), " the ", ("court", ["United States District Court"]), ' agrees. "', ("definition", ["Goods"]), '" means order {o_orderkey} at ',
        ("address", ["{o_custkey % 900 + 1} Market Street, Suite 4"]), ". ", ("trademark", ["Acme®"]), " ", ("copyright", ["(c) 2024 Acme"]),
    ],
    [
        "By ", ("date", ["March {o_orderkey % 28 + 1}, {year(o_orderdate)}"]), " the tenant owes ", ("money", ["{o_orderkey} dollars"]), " and ", ("money", ["25 cents"]), ", that is ", ("percent", ["fifty percent"]), " of ", ("money", ["{o_custkey} USD"]),
        ", for ", ("duration", ["six (6) months"]), "; ", ("condition", ["unless"]), " the ", ("court", ["Ninth Circuit"]), " reverses. The term “", ("definition", ["Net Price"]), "” refers to lot {o_orderkey}, ", ("constraint", ["not to exceed"]), " ",
        ("percent", ["{o_orderkey % 500} basis points"]), ". See ", ("citation", ["42 U.S.C. § {o_orderkey}"]), ".",
    ],
    ['Order {o_orderkey} holds 5 apples and 12.50 pears; 2023-1-5 and 13-2020 are no dates, a sign alone % and per cent alone are none. She said "nothing" and left; the court of opinion adjourned, iffy or atleast so. 12 Market, no street; Acme R; copyright soon. 42 U.S. and F.2d 7.'],
    [
        "Lot {o_orderkey}: ", ("date", ["the {o_orderkey % 20 + 4}th day of May, {year(o_orderdate)}"]), "; ", ("date", ["Jan. 5, {year(o_orderdate)}"]), "; ", ("date", ["15 Sep 2021"]), ". Pay ", ("money", ["€1,{o_custkey % 900 + 100} million"]), " or ", ("money", ["five hundred thousand dollars"]),
        "; ", ("money", ["$3K"]), " today. ", ("court", ["Superior Court of Kent"]), "; ", ("court", ["S.D.N.Y."]), "; ", ("condition", ["if"]), " paid, ", ("constraint", ["no more than"]), " ", ("duration", ["{o_orderkey % 30 + 2} years"]), ". ", ("copyright", ["Copyright 2019-{year(o_orderdate)} Foo Bar"]),
        ". ", ("address", ["{o_custkey % 900 + 1} Oak Ave, Springfield, IL 62701"]), "; ", ("trademark", ["Foo Bar™"]),
    ],
]


def _said(pieces: list) -> str:
    """An expression for the concatenation, in Spark's types."""
    out = []
    for p in pieces:
        if isinstance(p, tuple):
            out.append(_said(p[1]))
            continue
        for i, part in enumerate(re.split(r"[{}]", p)):
            if part:
                out.append(f"CAST({part} AS STRING)" if i % 2 else "'" + part.replace("'", "''") + "'")
    return f"concat({', '.join(out)})"


SENTENCE = "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN {_said(t)}" for i, t in enumerate(TEMPLATES)) + " END"


def expected(extractor: str) -> str:
    """DuckDB's expression for what the extractor should find in a sentence, written from the template's fields."""
    each = [", ".join(_said(p[1]) for p in t if isinstance(p, tuple) and p[0] == extractor) for t in TEMPLATES]
    return ("CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN [{x}]::VARCHAR[]" for i, x in enumerate(each)) + " END").replace("STRING", "VARCHAR")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("doc_id"), F.expr(SENTENCE).alias("text"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, ord): suppliers under nations under regions."""
    nation = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS child", "concat('r', n_regionkey) AS parent", "0 AS ord")
    return nation.unionByName(table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS child", "concat('n', s_nationkey) AS parent", "0 AS ord"))


EDGES_SQL = "edges AS (SELECT concat('n', n_nationkey) AS child, concat('r', n_regionkey) AS parent FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier)"

FEEDBACK = {
    "id": "event_id",
    "created_at": "ts",
    "rating": "CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' WHEN 'signup' THEN 'dismissed' ELSE 'up' END",
    "stage": "CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('stage ', CAST(user_id % 5 AS STRING)) END",
    "label": "concat('label ', CAST(user_id % 40 AS STRING))",
    "iri": "concat('urn:user/', CAST(user_id AS STRING))",
}


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in FEEDBACK.items()])


FEEDBACK_SQL = "feedback AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in FEEDBACK.items()) + " FROM events)"

#: A small lexicon of words that the documents have, with label types.
LEXICON = [("the", "preferred"), ("of", "hidden"), ("and", "alternative"), ("in the", "preferred"), ("is the", "alternative"), ("tion", "translation"), ("license", "preferred"), ("general public license", "preferred"), ("stupid", "alternative")]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"urn:term/{i}", a, b) for i, (a, b) in enumerate(LEXICON)], "iri string, label_key string, label_type string")


LEXICON_SQL = "lexicon(iri, label_key, label_type) AS (VALUES " + ", ".join(f"('urn:term/{i}', '{a}', '{b}')" for i, (a, b) in enumerate(LEXICON)) + ")"


#: A large lexicon, admitted as an ontology's labels are: the small one, labels with signs, one to eight words of each document, and the names of all parts
#: and customers. Every document is searched for all of them. A part's name is an alternative label, a document's words are of any type.
SIGNED = [("(c)", "preferred"), ("e.g.", "alternative"), ("100%", "preferred"), ("§", "hidden"), ("u.s.c.", "preferred"), ("...", "hidden")]
_WORDS_OF = {
    "spark": "array_join(slice(split(lower(text), ' '), CAST(doc_id % 3 + 1 AS INT), CAST(doc_id % 8 + 1 AS INT)), ' ')",
    "duckdb": "array_to_string(string_split(lower(text), ' ')[doc_id % 3 + 1 : doc_id % 3 + doc_id % 8 + 1], ' ')",
}
_PART_LABEL = "lower(concat(p_name, ' ', CAST(p_partkey AS STRING)))"
_KIND = "CASE doc_id % 4 WHEN 0 THEN 'preferred' WHEN 1 THEN 'alternative' WHEN 2 THEN 'hidden' ELSE 'translation' END"
_PIECE, _SIGN = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]"


def large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = spark.createDataFrame([(f"urn:sign/{i}", a, k) for i, (a, k) in enumerate(SIGNED)], "iri string, label_key string, label_type string").unionByName(lexicon(spark))
    of_docs = table(spark, sf_dir, "documents").select(F.expr("concat('urn:document/', CAST(doc_id AS STRING))").alias("iri"), F.expr(_WORDS_OF["spark"]).alias("label_key"), F.expr(_KIND).alias("label_type"))
    of_parts = table(spark, sf_dir, "part").select(F.expr("concat('urn:part/', CAST(p_partkey AS STRING))").alias("iri"), F.expr(_PART_LABEL).alias("label_key"), F.lit("alternative").alias("label_type"))
    of_customers = table(spark, sf_dir, "customer").select(F.expr("concat('urn:customer/', CAST(c_custkey AS STRING))").alias("iri"), F.lower("c_name").alias("label_key"), F.lit("preferred").alias("label_type"))
    every = small.unionByName(of_docs).unionByName(of_parts).unionByName(of_customers)
    return admitted(every.withColumn("label", F.col("label_key"))).drop("label").filter(F.regexp_like("label_key", F.lit(r"(?U)\S")))


def _listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


LARGE_LEXICON_SQL = (
    LEXICON_SQL
    + rf""", signed(iri, label_key, label_type) AS (VALUES {", ".join(f"('urn:sign/{i}', '{a}', '{k}')" for i, (a, k) in enumerate(SIGNED))}),
every AS (SELECT * FROM lexicon UNION ALL SELECT * FROM signed UNION ALL SELECT concat('urn:document/', CAST(doc_id AS VARCHAR)), {_WORDS_OF["duckdb"]}, {_KIND} FROM documents
UNION ALL SELECT concat('urn:part/', CAST(p_partkey AS VARCHAR)), {_PART_LABEL.replace("STRING", "VARCHAR")}, 'alternative' FROM part UNION ALL SELECT concat('urn:customer/', CAST(c_custkey AS VARCHAR)), lower(c_name), 'preferred' FROM customer),
large AS (SELECT *, regexp_extract_all(label_key, '{_PIECE}|{_SIGN}') AS p FROM every WHERE regexp_matches(label_key, '[^[:space:]\p{{Z}}]') AND length(label_key) >= 3 AND label_key NOT IN ({_listed(PATTERN_STOP)})
  AND (label_type <> 'alternative' OR (length(label_key) > 3 AND (contains(label_key, ' ') OR label_key NOT IN ({_listed(ALTERNATIVE_STOP)}))))),
low AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
pieces AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, regexp_extract_all(low, '{_PIECE}|{_SIGN}') AS w FROM low), unnest(range(1, len(w) + 1)) AS s(i)),
ahead AS (SELECT doc_id, t AS t0, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lag(t) OVER w AS back, sum(length(t)) OVER w - length(t) AS place FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
maybe AS (SELECT doc_id, place, label_key, iri, label_type, t0, back FROM ahead JOIN large ON len(p) = 1 AND p[1] = t0 UNION ALL SELECT doc_id, place, label_key, iri, label_type, t0, back FROM ahead JOIN large ON len(p) = 2 AND p[1] = t0
UNION ALL SELECT doc_id, place, label_key, iri, label_type, t0, back FROM ahead JOIN large ON len(p) > 2 AND p[1] = t0 AND p[2] = t1 AND starts_with(t2, p[3])),
met AS (SELECT doc_id, CAST(place AS INT) AS s, label_key, iri, label_type FROM maybe JOIN low USING (doc_id) WHERE substr(low, CAST(place AS BIGINT) + 1, length(label_key)) = label_key
  AND NOT regexp_matches(substr(low, CAST(place AS BIGINT) + length(label_key) + 1, 1), '{_PIECE}') AND (regexp_matches(t0, '^{_PIECE}') OR back IS NULL OR NOT regexp_matches(back, '^{_PIECE}')))"""
)
