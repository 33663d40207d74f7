import pytest
from compare import assert_same, connect
from test_operators import plain_individuals, resolved

from lexspan.operators import chunks, extract, lexicon
from lexspan.plans import bindings
from lexspan.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, sf, name):
    assert_same(spark, con, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert df.count() > 0


def test_spans_of_documents(spark, sf):
    """The interval joins over whole documents, offsets beyond one bin among them, against plain loops."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spans = {}
    for r in lexicon.match(docs, bindings.lexicon(spark)).select("doc_id", "start", "end", "iri").collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert max(e for x in spans.values() for _, e in x) > 4096
    within = lambda d, s, e: sum(s <= i and j <= e for i, j in spans.get(d, ()))
    got = {(r["doc_id"], r["chunk_index"]): r["n_entities"] for r in QUERIES["rag_chunks_documents"](spark, sf).collect()}
    assert got == {(r["doc_id"], r["chunk_index"]): within(r["doc_id"], r["start"], r["end"]) for r in chunks.chunks(docs).collect()}
    boxes = {}
    for r in chunks.sentences(docs).collect():
        boxes.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    want = set()
    for d, x in spans.items():
        for i, j in set(x):
            met = sorted((not (s <= i and j <= e), 0 if s <= i and j <= e else -(min(j, e) - max(i, s)), s, e) for s, e in boxes.get(d, ()) if i < e and s < j)
            want.add((d, i, j, *(met[0][2:] if met else (None, None))))
    rows = QUERIES["sentence_for_span_documents"](spark, sf).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_overlaps_of_documents(spark, sf):
    """Whole documents and the large lexicon, against the rule said again."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), bindings.large_lexicon(spark, sf)
    spans, iris = {}, {}
    for r in lexicon.match(docs, labels).collect():
        spans.setdefault(r["doc_id"], set()).add((r["start"], r["end"]))
        iris.setdefault((r["doc_id"], r["start"], r["end"]), set()).add(r["iri"])
    want = sorted((d, s, e, i) for d, x in spans.items() for s, e in resolved(x) for i in iris[d, s, e])
    assert sorted(map(tuple, QUERIES["overlap_resolve"](spark, sf).collect())) == want
    assert len(want) < len({(d, s, e, i) for (d, s, e), x in iris.items() for i in x})


def test_individuals_of_documents(spark, sf):
    """What the extractors find in each text, merged by the plain rule."""
    by_doc = {}
    for r in extract.extract(bindings.sentences(spark, sf)).collect():
        link = extract.EXTRACTORS[r["label"]].kind
        by_doc.setdefault(r["doc_id"], []).append({"name": r["value"], "mention": r["text"], "start": r["start"], "end": r["end"], "source": "citation" if r["label"] == "citation" else "regex", "links": [link]})
    want = sorted((d, *x) for d, rows in by_doc.items() for x in plain_individuals(rows))
    got = sorted((r["doc_id"], r["name"], r["start"], r["end"], r["source"], tuple(r["links"]), r["n_merged"]) for r in QUERIES["individuals"](spark, sf).collect())
    assert got == want


def test_search_asks_for_words_of_names(spark, sf):
    names = {w for r in spark.read.parquet(f"{sf}/part.parquet").collect() for w in r["p_name"].split()}
    assert {r["query"] for r in QUERIES["multi_search"](spark, sf).collect()} == names


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
