"""Sentence borders and longest-first matches against plain versions."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspan.operators import lexicon, overlap, sentences
from lexspan.plans import bindings
from lexspan.plans.queries import QUERIES

NONE = sentences.Knowledge(frozenset(sentences.ABBREVIATIONS), frozenset({"the", "she"}))


def split(text):
    return [text[a:b] for a, b in sentences.spans(text, NONE)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("First sentence. Second sentence. Third sentence.", ["First sentence.", "Second sentence.", "Third sentence."]),
        ("Just one sentence.", ["Just one sentence."]),
        ("The U.S. court ruled today.", ["The U.S. court ruled today."]),
        ("42 U.S.C. § 1983 provides a cause of action. The statute is important.", ["42 U.S.C. § 1983 provides a cause of action.", "The statute is important."]),
        ("See Smith v. Jones, No. 12-345. The court ruled accordingly.", ["See Smith v. Jones, No. 12-345.", "The court ruled accordingly."]),
        ("Fed. R. Civ. P. 12. Smith v. Jones", ["Fed. R. Civ. P. 12.", "Smith v. Jones"]),
        ("He sued Acme Inc. She settled.", ["He sued Acme Inc.", "She settled."]),
        ("Acme Inc. Delaware was sued!  Why?\n\nNo one knows.", ["Acme Inc. Delaware was sued!", "Why?", "No one knows."]),
        ("(See Art. I of the U.S. Constitution.) Yes", ["(See Art. I of the U.S. Constitution.) Yes"]),
        ("", []),
        (" \n ", []),
    ],
)
def test_borders(text, want):
    assert split(text) == want


def plain_counts(texts):
    """Of each word in lower case: with a period, without, small, capital in mid-sentence, capital after an end mark."""
    out = {}
    for x in texts:
        before = "."
        for w in re.findall(r"[^\W\d_]+(?:\.[^\W\d_]+)*\.?|[\d.,-]*\d\.?|[.!?]+", x):
            if w[0].isalpha():
                c = out.setdefault((w[:-1] if w.endswith(".") else w).lower(), Counter())
                c["period" if w.endswith(".") else "plain"] += 1
                c["small" if not w[0].isupper() else "opening" if before[-1] in ".!?" else "capital"] += 1
            before = w
    return out


def test_learned(spark):
    texts = ["The fr. word is fr. here, and fr. there. The end.", "Some fr. Words. some the end", "a new line. New York, New York. the New", None, "", "x" * 5000 + ". Yes fr. no"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r["type"]: [r[c] for c in ("n_period", "n_plain", "n_small", "n_capital", "n_opening")] for r in sentences.word_counts(docs).collect()}
    want = plain_counts([x for x in texts if x])
    assert counts == {w: [c[k] for k in ("period", "plain", "small", "capital", "opening")] for w, c in want.items()}
    known = sentences.learned(docs, known=[])
    assert "fr" in known.abbreviations and "end" not in known.abbreviations
    assert "the" in known.openers and "new" not in known.openers  # a word with capitals in mid-sentence opens none
    rows = sorted((r["doc_id"], r["place"], r["sentence"]) for r in sentences.split(docs, known).filter("doc_id < 2").collect())
    assert rows == [(0, 0, "The fr. word is fr. here, and fr. there."), (0, 1, "The end."), (1, 0, "Some fr. Words. some the end")]
    assert sentences.learned(docs.limit(0)).openers == frozenset()
    assert sentences.split(docs.limit(0), known).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aZé中½٣1.,-!?'\" \n\x85\x1c_", max_size=40), max_size=6))
def test_counted_by_pieces(texts):
    """What a task counts by pieces between white space is what the words of whole texts, one after another, give."""
    want = {}
    for x in texts:
        before = "."
        for w in sentences._WORD.findall(x):
            n, opening = want.get(w, (0, 0))
            want[w] = (n + 1, opening + (before[-1] in ".!?"))
            before = w
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None], pa.string())], ["text"])
    got = [r for b in sentences._counted(iter([batch])) for r in b.to_pylist()]
    assert {r["x"]: (r["n"], r["n_opening"]) for r in got} == want and len(got) == len(want)


def test_sentences_of_documents(spark, sf):
    """Whole documents: borders by a loop over the text's characters."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    known = sentences.learned(docs)
    want = set()
    for r in docs.collect():
        x, start, place = r["text"] or "", 0, 0
        i = 0
        while i < len(x):
            j = i
            while j < len(x) and x[j].isspace():
                j += 1
            if j > i and i and x[i - 1] in ".!?" and j < len(x) and "A" <= x[j] <= "Z":
                word = re.split(r"[\s\"'“‘(\[]", x[start:i])[-1]
                follows = re.match(r"\w+", x[j:]).group().lower()
                kind = word[:-1].lower()
                short = word.endswith(".") and (kind in known.abbreviations or re.fullmatch(r"[^\W\d_]|(?:[^\W\d_]*\.)+[^\W\d_]*", kind) and kind.strip("."))
                if not short or follows in known.openers:
                    if x[start:i].strip():
                        want.add((r["doc_id"], place, start, i))
                        place += 1
                    start = j
            i = max(j, i + 1)
        if x[start:].strip():
            want.add((r["doc_id"], place, start, len(x)))
    got = [(r["doc_id"], r["place"], r["start"], r["end"]) for r in QUERIES["learned_sentences"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def plain_longest(spans):
    """(start, end, tokens) taken one by one, each against all before it."""
    taken = []
    for s in sorted(set(spans), key=lambda s: (-s[2], s[0], -s[1])):
        if not any(s[0] < t[1] and t[0] < s[1] for t in taken):
            taken.append(s)
    return sorted(taken)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.integers(1, 4)).map(lambda t: (t[0], t[0] + t[1], t[2])), max_size=25))
def test_longest_first(spans):
    assert [spans[i] for i in overlap.longest_first(spans)] == plain_longest(spans)


def test_longest_of_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), bindings.large_lexicon(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans, iris = {}, {}
    for r in lexicon.match(docs, labels).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"], len(re.findall(r"\w+|[^\w\s]", r["surface"]))))
        iris.setdefault((r["doc_id"], r["start"], r["end"]), set()).add(r["iri"])
    want = sorted((d, s, e, i) for d, x in spans.items() for s, e, _ in plain_longest(x) for i in iris[d, s, e])
    assert sorted(map(tuple, QUERIES["longest_matches"](spark, sf).collect())) == want


def test_longest_rules(spark):
    docs = spark.createDataFrame([(1, "Breach of contract and contract law of contract")], "doc_id long, text string")
    labels = spark.createDataFrame([(k,) for k in ("breach of contract", "contract", "contract law", "law of contract", "of", " ")], "label_key string")
    want = [(0, 18, "Breach of contract"), (23, 31, "contract"), (32, 47, "law of contract")]
    for part in (10_000, 9):  # one automaton, several
        rows = lexicon.match(docs, labels, longest=True, part_chars=part).collect()
        assert sorted((r["start"], r["end"], r["surface"]) for r in rows) == want
    counted = {(r["label_key"], r["n"], r["first_start"]) for r in lexicon.counts(docs, labels).collect()}
    assert counted == {("breach of contract", 1, 0), ("contract", 3, 10), ("contract law", 1, 23), ("law of contract", 1, 32), ("of", 2, 7)}


def test_a_lexicon_beyond_one_automaton_is_found_in_one_pass(spark, monkeypatch):
    from lexspan.operators import hashed

    monkeypatch.setattr(hashed, "WINDOW", 40)  # texts in windows
    words = ["new", "york", "county", "court", "(c)", "u.s.c.", "İ", "é"]
    texts = [" ".join(words[(i * k + j) % 8] for j in range(i % 30)) for i in range(40) for k in (1, 3)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")  # two rows an id
    labels = spark.createDataFrame([(f"{i}", k) for i, k in enumerate(("new york", "york county", "york county", "county court (c)", "(c)", "u.s.c.", "c", "new york county court (c) u.s.c.", "é new", " "))], "iri string, label_key string")
    listed = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    for more in ({}, {"resolve": True}, {"longest": True}, {"surface": False}):
        assert listed(lexicon.match(docs, labels, part_chars=5, **more)) == listed(lexicon.match(docs, labels, **more)) != []
    many = lexicon.counts(docs, labels, part_chars=5)
    assert listed(many) == listed(lexicon.counts(docs, labels))
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_large_lexicon_is_told_from_the_filter_in_the_pass(spark, monkeypatch):
    """Overlaps are resolved where they are found, without a shuffle of finds, whichever way labels come in; keys that share a code have none."""
    from lexspan.operators import hashed

    docs = spark.createDataFrame([(i, f"the new york county court of the {i} and new york") for i in range(60)], "doc_id long, text string")
    keys = [*(("the", f"a{i}") for i in range(9)), *(("new york", f"b{i}") for i in range(3)), ("york county court", "c"), *((f"the {i}", f"d{i}") for i in range(60))]
    labels = spark.createDataFrame(keys, "label_key string, iri string")
    listed = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    ways = ({}, {"resolve": True}, {"longest": True})
    want, counted = [listed(lexicon.match(docs, labels, **more)) for more in ways], listed(lexicon.counts(docs, labels))
    assert all(want) and counted
    known = lexicon.prepared(labels, 5)
    assert known.key == "code" and sorted(known.codes.value.of(["the", "the 7", "the 77", "york"]), key=str)[2:] == [None, None]
    for most in (32 << 20, 0):  # labels for every task, and few of them
        monkeypatch.setattr(lexicon, "BROADCAST_BYTES", most)
        for few in (5, 10, 100):
            monkeypatch.setattr(lexicon, "BROADCAST_LABELS", few)
            assert lexicon.prepared(labels, 5).crowded == {5: None, 10: 9, 100: 3}[few]
            plans = [lexicon.match(docs, labels, part_chars=5, **more) for more in ways]
            assert [listed(x) for x in plans] == want and listed(lexicon.counts(docs, labels, part_chars=5)) == counted
            assert all("Aggregate" not in (plan := x._jdf.queryExecution().optimizedPlan().toString()) and "RepartitionByExpression" not in plan for x in plans)
    monkeypatch.setattr(hashed.Known, "distinct", lambda self: False)
    assert lexicon.prepared(labels, 5).key == "label_key"
    assert [listed(lexicon.match(docs, labels, part_chars=5, **more)) for more in ways] == want


def test_runs_of_words_are_looked_up_where_they_stand(spark, monkeypatch):
    texts = ["The lease, the LEASE-agreement of the", "é the é_1 the é", None, "", "ÉCOLE a  b\na b a", "the\U00010400lease lease"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([("u:1", "the"), ("u:2", "the"), ("u:3", "lease agreement of"), ("u:4", "the é"), ("u:5", "école"), ("u:6", "a b"), ("u:7", "b a b a"), ("u:8", "")], "iri string, label_key string")
    listed = lambda df: sorted(map(tuple, df.collect()))
    found = lexicon.match_native(docs, labels)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # runs that are no labels never become rows
    few = listed(lexicon.match_native(docs, labels, 2))
    monkeypatch.setattr(lexicon, "PART_CHARS", 0)
    known = docs.filter("text IS NOT NULL")
    other = lexicon.match_native(known, labels)
    assert listed(found) == listed(other) != [] and found.dtypes == other.dtypes
    assert few == listed(lexicon.match_native(known, labels, 2))


def test_own_names(spark):
    docs = spark.createDataFrame([(1, "a b A c"), (2, "a b"), (3, None), (4, ""), (5, "a"), (1, "b")], "doc_id long, text string")
    names = spark.createDataFrame([(1, "a", "u:2"), (1, "a", "u:1"), (1, "b a", "u:3"), (2, "b", "u:4"), (2, " ", "u:5"), (3, "a", "u:6"), (9, "a", "u:7")], "doc_id long, label_key string, iri string")
    found = lambda **k: sorted((r["doc_id"], r["start"], r["end"], r["surface"], r["iri"]) for r in lexicon.match_own(docs, names, **k).collect())
    assert found(resolve=False) == [(1, 0, 1, "a", "u:1"), (1, 2, 5, "b A", "u:3"), (1, 4, 5, "A", "u:1"), (2, 2, 3, "b", "u:4")]
    assert lexicon.match_own(docs, names.limit(0)).count() == 0
