"""Steps whose time or memory grew faster than their tables: the same rows, made in bounded parts."""

import pytest
from compare import assert_same, connect

from lexspan.operators import concepts, hierarchy, search
from lexspan.plans import bindings
from lexspan.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def families(spark):
    """(child, parent, ord): one large family, a small one, repeated edges, second parents."""
    rows = [(f"a{i}", "a", 0) for i in range(60)] + [(f"a{i}", "b", 1) for i in range(0, 60, 7)] + [(f"b{i}", "b", 0) for i in range(5)] + [("a1", "a", 0), ("c", "d", 0)]
    return spark.createDataFrame(rows, "child string, parent string, ord int")


def _plain_siblings(edges):
    rows = [tuple(r) for r in edges.collect()]
    first = {c: min((o, p) for x, p, o in rows if x == c)[1] for c, _, _ in rows}
    return sorted({(c, x) for c, p in first.items() for x, q, _ in rows if p == q and x != c})


@pytest.mark.parametrize("part", [7, 2048])
def test_siblings_are_made_in_blocks(families, monkeypatch, part):
    monkeypatch.setattr(hierarchy, "PART", part, raising=False)
    found = hierarchy.siblings(families)
    assert sorted(map(tuple, found.collect())) == _plain_siblings(families)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange")  # pairs are made last: no shuffle holds them
    assert found.rdd.getNumPartitions() >= 4  # one family is more than one task's work


@pytest.mark.parametrize("part", [7, 2048])
def test_relatives_take_siblings_from_lists_of_families(spark, families, monkeypatch, part):
    edges = [tuple(r) for r in families.collect()]
    names = sorted({x for c, p, _ in edges for x in (c, p)})
    parents = {n: [p for _, p in sorted({(o, p) for c, p, o in edges if c == n})] for n in names}
    rows = [(n, n.upper(), parents[n] + ["gone"], ["a", "gone"] if n == "c" else []) for n in names]
    known = spark.createDataFrame(rows, "iri string, label string, parents array<string>, see_also array<string>")
    monkeypatch.setattr(hierarchy, "PART", part, raising=False)
    monkeypatch.setattr(hierarchy, "siblings", None)  # pairs aren't made
    got = {r["iri"]: {c: [tuple(x) for x in r[c]] for c in ("all_parents", "children", "siblings", "related")} for r in concepts.relatives(known).collect()}
    of = lambda some: sorted((x.upper(), x) for x in some)
    kids = {n: {c for c, p, _ in edges if p == n} for n in names}
    want = {n: {"all_parents": of(parents[n]), "children": of(kids[n]), "siblings": of(kids[parents[n][0]] - {n} if parents[n] else ()), "related": of(["a"] if n == "c" else ())} for n in names}
    assert got == want


def _dealt_by_rows(spark, sf, monkeypatch, name):
    """The query in a session of as many partitions as its rows ask for, which leaves the caller's as it is."""
    monkeypatch.setattr(bindings, "ROWS", 20, raising=False)
    before = spark.conf.getAll
    df = QUERIES[name](spark, sf)
    assert int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > int(before["spark.sql.shuffle.partitions"])
    assert spark.conf.getAll == before
    return df


@pytest.mark.parametrize("name", ["export_graph_nodes_sections", "export_graph_relations_sections"])
def test_graphs_are_dealt_by_their_rows(spark, sf, monkeypatch, name):
    df = _dealt_by_rows(spark, sf, monkeypatch, name)
    assert_same(spark, connect(sf), sf, lambda *_: df, ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["resolution", "resolve_with_hints"])
def test_resolution_is_dealt_by_its_rows(spark, sf, monkeypatch, name):
    df = _dealt_by_rows(spark, sf, monkeypatch, name)
    if name in ORACLE_SQL:
        assert_same(spark, connect(sf), sf, lambda *_: df, ORACLE_SQL[name])


def test_a_search_meets_no_more_concepts_of_one_text_than_it_gives(spark):
    """Many concepts share their texts: the best by score and iri, without a row for each of them and each query."""
    texts = {"b": ("red bolt", "steel"), "n": ("red nut", "steel"), "x": (None, "red bolt")}
    rows = [(f"{k}{i:03}", *v) for k, v in texts.items() for i in range(200)] + [("c", "red bolt", "iron")]
    found = search.search(spark.createDataFrame([("red bolt",)], "query string"), spark.createDataFrame(rows, "iri string, label string, definition string"), top=202)
    got = [(r["rank"], r["iri"]) for r in found.orderBy("rank").collect()]
    assert got == [(n + 1, i) for n, i in enumerate([*(f"b{i:03}" for i in range(200)), "c", "n000"])]
    few = search.search(spark.createDataFrame([("red bolt",)], "query string"), spark.createDataFrame(rows, "iri string, label string, definition string"), top=3)
    assert [r["iri"] for r in few.orderBy("rank").collect()] == ["b000", "b001", "b002"]
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(label#" in plan  # a text's concepts are cut before they meet queries
