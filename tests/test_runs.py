"""Runs of stages: resumed, side by side, changed, and with stages that fail."""

import threading

import pytest
from pyspark.sql import functions as F

from lexspan.operators import extract, lexicon, sentences
from lexspan.plans import annotate, bindings, runs
from lexspan.plans.queries import QUERIES


def test_resumed_run(spark, sf):
    """What the run says of each document, by the operators alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    text = annotate.canonical(docs)
    texts = {r["doc_id"]: r["text"] for r in text.collect()}
    known = sentences.learned(text)
    index = lexicon.multi_index(lexicon.admitted(bindings.lexicon(spark).withColumnRenamed("label_key", "label"))).select("label_key", "iri")
    n = {r["doc_id"]: r["n"] for r in lexicon.match(text, index, resolve=True).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    rows = {r["doc_id"]: r for r in QUERIES["resumed_run"](spark, sf).collect()}
    assert rows.keys() == texts.keys()
    for d, x in texts.items():
        r = rows[d]
        assert (r["n_chars"], r["n_sentences"], r["n_annotations"]) == (len(x), len(sentences.spans(x, known)), n.get(d, 0))
        assert r["stages_done_again"] == 1
    found = extract.found_individuals(text, [e for e in extract.EXTRACTORS if e != "citation"])
    assert sum(r["n_individuals"] for r in rows.values()) >= found.count()


def test_texts_are_passed_once(spark):
    """Counting words shuffles a row for each word of a task, not for each place; annotating and individuals move no texts or sentences between tasks."""
    texts = spark.range(0, 2000, 1, 2).selectExpr("id AS doc_id", "concat('The judge v. Doe cites 410 U.S. 113 ', id % 3, '. Then he left. ', repeat('so on and so on ', 50)) AS text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    labels = spark.createDataFrame([("u:1", "judge", "preferred")], "iri string, label string, label_type string")
    assert "Join" not in plan(annotate.annotated(texts, labels)).replace("BroadcastHashJoin", "")
    assert "Generate" not in plan(sentences.word_counts(texts))
    found = extract.found_individuals(texts, ["money"], cited=True)
    assert "Exchange" not in plan(found)
    cited = extract.individuals(extract.as_individuals(extract.citations(texts), F.lit("citation"), F.col("class")))
    assert sorted(map(str, found.collect())) == sorted(map(str, cited.collect())) and found.count() == 2000


def test_annotated_documents(spark, sf):
    """Each admitted match once, after overlaps, with its sentence, confidence and lineage."""
    labels = {k: (f"urn:term/{i}", kind) for i, (k, kind) in enumerate(bindings.LEXICON)}
    rows = QUERIES["annotated_documents"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in annotate.canonical(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len({r["ann_id"] for r in rows}) == len(rows) > 0
    for r in rows:
        iri, kind = labels[texts[r["doc_id"]][r["start"] : r["end"]].lower()]
        assert (r["iri"], r["label_type"]) == (iri, kind)
        assert r["state"] == ("confirmed" if r["confidence"] >= 0.6 else "preliminary")
        assert r["lineage"] == [f"lexicon: {kind} label", f"state: {r['state']}"]
        assert r["sentence_start"] is None or r["sentence_start"] <= r["start"] < r["sentence_end"]


def test_runs(spark, tmp_path):
    calls, gate = [], threading.Barrier(2, timeout=60)
    one = spark.range(3).withColumnRenamed("id", "n")

    def noted(name, f):
        def run(t):
            calls.append(name)
            return f(t)

        return run

    def meets(t):
        gate.wait()  # both stages are at work at once
        return t["a"]

    def fails(_):
        raise ValueError("no good")

    flaky = [True]

    def second_time(t):
        if flaky and flaky.pop():
            raise ValueError("not yet")
        return t["b"].unionByName(t["c"])

    make = lambda version="1": [
        runs.Stage("a", ("in",), noted("a", lambda t: t["in"])),
        runs.Stage("b", ("a",), noted("b", meets)),
        runs.Stage("c", ("a",), noted("c", meets), version),
        runs.Stage("d", ("b", "c"), noted("d", second_time)),
        runs.Stage("e", ("a",), noted("e", fails), empty="n long"),
        runs.Stage("f", ("e", "d"), noted("f", lambda t: t["d"].unionByName(t["e"]))),
    ]
    run = runs.Run(spark, str(tmp_path / "run"), make())
    with pytest.raises(runs.Broken, match="d: ValueError: not yet"):
        run.execute({"in": one}, {"in": "1"})
    assert sorted(calls)[:4] == ["a", "b", "c", "d"] and "f" not in calls
    calls.clear()
    tables = runs.Run(spark, str(tmp_path / "run"), make()).execute({"in": one}, {"in": "1"})  # another driver goes on
    assert set(calls) == {"d", "e", "f"}  # a failed optional stage is tried again
    assert tables["f"].count() == 6 and tables["e"].count() == 0
    calls.clear()
    gate.reset()
    changed = make("2")
    changed[2] = runs.Stage("c", ("a",), noted("c", lambda t: t["a"]), "2")
    run = runs.Run(spark, str(tmp_path / "run"), changed)
    run.execute({"in": one}, {"in": "1"})
    assert set(calls) == {"c", "d", "e", "f"} and "a" not in run.made
    log = {(r["stage"], r["error"]) for r in run.log().collect()}
    assert ("d", "ValueError: not yet") in log and ("e", "ValueError: no good") in log and ("f", None) in log
