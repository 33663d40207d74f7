import base64
import io
import random
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lexspan.functions import scoring, text
from lexspan.operators import annotations, chunks, confidence, extract, feedback, hierarchy, intervals, lexicon, overlap, reconcile, search, triples, vectors
from lexspan.sinks import export
from lexspan.sources import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_whitespace(spark):
    n = lambda s: one(spark, text.normalize_whitespace(F.col("s")), s=s)
    assert n("  a   b\t\tc ") == "a b c"
    assert n("a\n\nb") == "a\n\nb"
    assert n("a\n\n\n\nb") == "a\n\nb"
    assert n("a \n b") == "a\nb"
    assert n("") == ""


def test_whitespace_in_tasks(spark):
    """Python's way over a collection and the JVM's give the same, and what the plain patterns say."""
    import random

    from lexspan.plans import annotate

    at = random.Random(3)
    said = ["".join(at.choice("ab \n\n  \t\x0b\r\x85\xa0\x1c\x1f\u2003\u2028\u180e\u200b\u3000\ufeff") for _ in range(at.randrange(30))) for _ in range(2000)]
    docs = spark.createDataFrame([*enumerate(said), (-1, None)], "doc_id long, text string")
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[^\S\n]+", " "), r"\n{3,}", "\n\n")
    want = {r[0]: r[1] for r in docs.select("doc_id", F.btrim(F.regexp_replace(plain, r" ?\n ?", "\n"), F.lit(" \n"))).collect()}
    assert {r[0]: r[1] for r in docs.select("doc_id", text.normalize_whitespace(F.coalesce("text", F.lit("")))).collect()} == want
    assert {r[0]: r[1] for r in annotate.canonical(docs).collect()} == want


def test_best_in():
    """The first sentence around a span, else that which it overlaps most, else none."""
    s = [(0, 10), (11, 20), (22, 30)]
    assert [intervals.best_in(*x, s) for x in ((0, 3), (9, 10), (9, 12), (8, 13), (9, 14), (20, 22), (20, 23), (5, 29), (30, 31))] == [(0, 10), (0, 10), (0, 10), (0, 10), (11, 20), (None, None), (22, 30), (11, 20), (None, None)]


def test_sentences_and_chunks():
    parts = chunks.split("First one. Second one! third stays. Fourth? Yes.")
    assert parts == ["First one.", "Second one! third stays.", "Fourth?", "Yes."]
    spans = [(i * 30, i * 30 + 28) for i in range(20)]
    found = chunks.filled(spans, 200, 50)
    assert found[0][2] == 0 and found[-1][3] == 19
    assert all(b - a <= 200 for a, b, _, _ in found)
    assert all(y[2] <= x[3] + 1 and y[2] > x[2] for x, y in zip(found, found[1:]))
    assert chunks.filled([(0, 500)], 200, 50) == [(0, 500, 0, 0)]
    assert chunks.filled([]) == []


def resolved(spans):
    """The rule, said again in Python."""
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if any(k[:2] == s[:2] for k in kept):
            continue
        for i, k in enumerate(kept):
            inside = (k[0] <= s[0] and s[1] <= k[1]) or (s[0] <= k[0] and k[1] <= s[1])
            if k[0] < s[1] and s[0] < k[1] and not inside:
                if s[1] - s[0] > k[1] - k[0]:
                    kept[i] = s
                break
        else:
            kept.append(s)
    return sorted(kept)


def test_overlap_resolution(spark):
    rng = random.Random(5)
    cases = {i: [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 20) for _ in range(rng.randint(1, 9)))] for i in range(60)}
    for spans in [*cases.values(), [(i, i + rng.randint(1, 40)) for i in range(300)]]:
        assert sorted(spans[i] for i in overlap.kept([(*s, 0.0) for s in spans])) == resolved(spans)
    df = spark.createDataFrame([(i, *s) for i, x in cases.items() for s in x], "doc_id int, start int, end int")
    found = {}
    for r in overlap.resolve(df).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert {i: sorted(x) for i, x in found.items()} == {i: resolved(x) for i, x in cases.items()}
    sure = spark.createDataFrame([(1, 0, 5, 0.7, "a"), (1, 0, 5, 0.9, "b"), (1, 3, 9, 0.1, "c"), (1, 4, 5, 0.2, "d")], "doc_id int, start int, end int, confidence double, of string")
    assert [r["of"] for r in overlap.resolve(sure, "confidence").collect()] == ["c", "d"]


def test_lexicon(spark):
    docs = spark.createDataFrame([(1, "The lease, a Lease agreement; leases."), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([("u:1", "lease"), ("u:2", "lease agreement")], "iri string, label_key string")
    found = sorted((r["doc_id"], r["start"], r["end"], r["iri"]) for r in lexicon.match(docs, labels).collect())
    assert found == [(1, 4, 9, "u:1"), (1, 13, 18, "u:1"), (1, 13, 28, "u:2")]
    every = lambda text, *keys, **more: sorted((r["start"], r["end"], r["label_key"]) for r in lexicon.match(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(k,) for k in keys], "label_key string"), **more).collect())
    long = "motion for leave to file an amended complaint"
    assert every(f"The {long.title()}.", long, "leave") == [(4, 4 + len(long), long), (15, 20, "leave")]
    assert every("under 5 U.S.C. 7, but not XU.S.C. or u.s.c.x", "u.s.c.") == [(8, 14, "u.s.c.")]
    assert every("a (c) b(c)", "(c)") == [(2, 5, "(c)")]
    assert every("İstanbul court", "court") == [(9, 14, "court")]  # places are the text's, whatever lower case does
    assert every("new york county", "new york", "york county") == [(0, 8, "new york"), (4, 15, "york county")]
    assert every("new york county", "new york", "york county", resolve=True) == [(4, 15, "york county")]
    assert every("new york county", "new york", "york county", resolve=True, part_chars=9) == [(4, 15, "york county")]  # two automata
    assert every("court_x courts", "court", "") == [] and every("", "court") == []
    assert lexicon.match(docs, labels.limit(0)).count() == 0
    c = lambda kind, label: one(spark, lexicon.confidence(F.col("k"), F.col("l")), k=kind, l=label)
    assert (c("preferred", "a b"), c("alternative", "a"), c("hidden", "a")) == (0.90, 0.35, 0.50)


def test_interval_joins(spark):
    rng = random.Random(2)
    a = [(rng.randint(0, 2), s, s + rng.randint(1, 3000)) for s in (rng.randint(0, 9000) for _ in range(60))]
    b = [(rng.randint(0, 2), s, s + rng.randint(1, 3000)) for s in (rng.randint(0, 9000) for _ in range(60))]
    frame = lambda x: spark.createDataFrame([(*r, i) for i, r in enumerate(x)], "doc_id int, start int, end int, n int")
    got = sorted((r["a_n"], r["b_n"]) for r in intervals.overlap_join(frame(a), frame(b)).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    touch = spark.createDataFrame([(1, 0, 5, 0)], "doc_id int, start int, end int, n int"), spark.createDataFrame([(1, 5, 9, 0)], "doc_id int, start int, end int, n int")
    assert intervals.overlap_join(*touch).count() == 0
    assert intervals.overlap_join(*touch, touching=True).count() == 1


def test_hierarchy(spark):
    edges = spark.createDataFrame([("b", "a", 0), ("c", "b", 0), ("d", "b", 0), ("d", "x", 1), ("p", "q", 0), ("q", "p", 0)], "child string, parent string, ord int")
    up = {(r["iri"], r["ancestor"]): r["depth"] for r in hierarchy.closure(edges).collect()}
    assert up["c", "a"] == 2 and up["d", "x"] == 1 and ("p", "p") not in up
    path = {r["iri"]: r["path"] for r in hierarchy.paths(edges).collect()}
    assert path["d"] == ["a", "b", "d"] and path["a"] == ["a"]
    assert {(r["iri"], r["sibling"]) for r in hierarchy.siblings(edges).collect()} == {("c", "d"), ("d", "c")}


def test_scores(spark):
    words = lambda s: F.array(*[F.lit(w) for w in s.split()])
    assert one(spark, scoring.word_overlap(words("contract law"), words("contract law"))) == 1.0
    assert one(spark, scoring.word_match(F.lit("contract"), F.lit("contracts"))) == 0.8
    assert one(spark, scoring.word_match(F.lit("litigation"), F.lit("litigator"))) == 0.7
    assert one(spark, scoring.word_match(F.lit("cat"), F.lit("dog"))) == 0.0
    rel = lambda q, t, d="": one(spark, scoring.relevance(F.lit(q), F.lit(t), F.lit(d), scoring.word_overlap(text.content_words(F.lit(q), search.STOP), text.content_words(F.lit(t), search.STOP)), scoring.word_overlap(text.content_words(F.lit(q), search.STOP), text.content_words(F.lit(d), search.STOP))))
    assert rel("Dog Bite", "Dog Bite Strict Liability") >= 85.0
    assert rel("criminal defense attorney", "Criminal Defense") >= 78.0
    assert rel("employment discrimination", "Workplace Discrimination Law") > 30.0
    assert rel("leases", "Tenancy", "of leases and rents") == 60.0  # found by its definition alone
    assert rel("test", "") == 0.0 and rel("test", "test", "test test test") == 82.0
    assert rel("cat", "catalogue") == 70.4  # contained, but by three letters: the words' overlap counts
    assert rel("breach of contract", "breach of contract") == 97.0
    assert rel("real estate", "Real Estate") == 92.0
    assert rel("lease", "lease") == 82.0
    assert rel("lease", "lease agreement") >= 85.0


def test_search_candidates(spark):
    rows = [
        ("u:1", "General", None, None, None),
        ("u:2", "Type", "", [], None),
        ("u:3", "Überblick", "", ["Survey Report", None], None),
        ("u:4", "Sublease", "", None, "Undertenancy Deed"),
        ("u:5", "价格表", "", None, None),
        ("u:6", "Compliance Desk", "", None, None),
        ("u:7", "Counterclaim", "answers a megaphone user", None, None),
    ]
    concepts = spark.createDataFrame(rows, "iri string, label string, definition string, alt_labels array<string>, preferred_label string")
    asked = ["general", "Type", "überblick", "lease", "survey report", "undertenancy deed", "tenancy", "价格表", "regulatory", "my counterclaim!", "gaphone us", "", " ", None]
    got = {(r["query"], r["iri"]): r["score"] for r in search.search(spark.createDataFrame([(x,) for x in asked], "query string"), concepts).collect()}
    want = {("general", "u:1"): 82.0, ("Type", "u:2"): 82.0, ("überblick", "u:3"): 82.0, ("lease", "u:4"): 85.0, ("survey report", "u:3"): 82.0, ("undertenancy deed", "u:4"): 90.0}
    want |= {("tenancy", "u:4"): 84.0, ("价格表", "u:5"): 82.0, ("my counterclaim!", "u:7"): 78.0, ("gaphone us", "u:7"): 60.0}
    assert {k: got.get(k) for k in want} == want
    assert got["regulatory", "u:6"] == 44.0  # by its expansion "regulatory compliance"
    assert {q for q, _ in got} == set(asked) - {"", " ", None}
    assert one(spark, search.terms(F.lit("tax law"))) == ["tax law", "tax", "tax practice", "tax service"]
    mentions = spark.createDataFrame([("Survey Report", None, 0.5), ("general", None, 0.5)], "text string, iri string, confidence double")
    assert {r["text"]: r["iri"] for r in search.resolve(mentions, concepts).collect()} == {"Survey Report": "u:3", "general": "u:1"}


def test_individuals(spark):
    rows = [(1, "Acme", "Acme", 0, 4, "ner", ["org"]), (1, "Acme Corp", "Acme Corp", 0, 9, "regex", ["co"]), (1, "Bolt", "Bolt", 30, 34, "ner", ["org"])]
    df = spark.createDataFrame(rows, "doc_id long, name string, mention string, start int, end int, source string, links array<string>")
    got = {r["name"]: (r["source"], sorted(r["links"]), r["n_merged"]) for r in extract.individuals(df).collect()}
    assert got == {"Acme Corp": ("hybrid", ["co", "org"], 2), "Bolt": ("ner", ["org"], 1)}


def test_extractors():
    cases = {"money": "paid $1,200.50 today", "date": "on March 3, 2021 it", "duration": "thirty (30) days", "percent": "12.5% of", "court": "the superior court of Kent", "definition": '"Goods" means things', "condition": "provided that he", "constraint": "not to exceed ten", "address": "at 12 North Main Street, Suite 4", "trademark": "Acme® tools", "copyright": "© 2020 Acme", "citation": "at 410 U.S. 113", "email": "a.b@c.org"}
    for name, sample in cases.items():
        assert list(extract._finds(sample, extract._compiled([name]))), name


def test_svo():
    tokens = ["Court", "reversed", "judgment", "in", "March"]
    got = triples.svo(tokens, ["court", "reverse", "judgment", "in", "March"], ["NOUN", "VERB", "NOUN", "ADP", "PROPN"], ["nsubj", "ROOT", "dobj", "prep", "pobj"], [1, 1, 1, 1, 3])
    assert [t[:4] for t in got] == [("Court", "reverse", "judgment", "active"), ("Court", "reverse in", "March", "active")]
    passive = triples.svo(["Motion", "was", "denied", "by", "court"], ["motion", "be", "deny", "by", "court"], ["NOUN", "AUX", "VERB", "ADP", "NOUN"], ["nsubjpass", "auxpass", "ROOT", "agent", "pobj"], [2, 2, 2, 2, 3])
    assert passive[0][:4] == ("court", "deny", "Motion", "passive")


def test_vectors(spark):
    rng = random.Random(1)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(80)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    got = vectors.nearest(df, df.filter("vec_id < 5"), 3, by_label=True).toPandas()
    for q in range(5):
        best = sorted(((-sum(a * c for a, c in zip(v[q][1], x[1])), x[0]) for x in v if x[0] != q and x[2] == v[q][2]))[:3]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [b[1] for b in best]


def test_annotation_life(spark):
    concept = "struct<iri:string,label:string,confidence:double,state:string>"
    df = spark.createDataFrame([("x", "preliminary", [("a", "A", 0.9, "p"), ("b", "B", 0.8, "p")], ["made"])], f"ann_id string, state string, concepts array<{concept}>, lineage array<string>")
    p = annotations.promote(df, F.lit(1)).first()
    assert [c["iri"] for c in p["concepts"]] == ["b", "a"] and p["concepts"][0]["state"] == "confirmed"
    assert annotations.promote(df, F.lit(5)).first()["concepts"][0]["iri"] == "a"
    twice = annotations.reject(annotations.reject(df, F.lit(True)), F.lit(True)).first()
    assert twice["state"] == "rejected" and twice["lineage"] == ["made", "rejected"]
    assert annotations.restore(annotations.reject(df, F.lit(True)), F.lit(True)).first()["state"] == "confirmed"


def test_rate_limit(spark):
    e = spark.createDataFrame([(i, "k", (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=10 * i)).to_pydatetime()) for i in range(12)], "event_id long, key string, ts timestamp")
    got = {r["event_id"]: r["accepted"] for r in feedback.accepted(e, limit=2, seconds=60).collect()}
    times, want = [], {}
    for i in range(12):
        times = [t for t in times if t > 10 * i - 60]
        want[i] = len(times) < 2
        times += [10 * i] if want[i] else []
    assert got == want


def test_sources(spark):
    fmt = lambda name, c: one(spark, ingest.detect_format(F.col("n"), F.col("c")), n=name, c=c)
    assert fmt("a.MD", "x") == "markdown"
    assert fmt("", "<html><body>x") == "html"
    assert fmt("", "Subject: x\n\ny") == "email"
    assert fmt("", "{\\rtf1 x}") == "rtf"
    assert fmt("", "just words") == "plain_text"
    assert one(spark, ingest.markdown_text(F.col("c")), c="# A\n\n**b** [c](d) ![e](f)\n- g") == "A\n\nb c e\ng"
    assert ingest.rtf_text(r"{\rtf1\ansi Hello\par World}") == "Hello\nWorld"
    assert ingest.eml_text("From: a@b.c\nSubject: S\nContent-Type: text/plain\n\nBody").endswith("Body")
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    assert ingest.rtf_text(b64(r"{\rtf1\ansi Hello\par World}")) == "Hello\nWorld"
    assert ingest.eml_text(b64("From: a@b.c\nSubject: S\n\nGrüße “§”")) == "From: a@b.c\nSubject: S\n\nGrüße “§”"
    assert ingest.eml_text("Subject: S\n\nGrüße").endswith("\n\nGrüße")
    assert ingest.eml_text(f"Subject: S\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: base64\n\n{b64('Grüße'.encode('latin-1'))}\n").endswith("\n\nGrüße")
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    files = [(1, "a.docx", b64(word.getvalue())), (2, "a.docx", "UEsDBBQAbroken"), (3, "a.docx", "no base 64!"), (4, "a.eml", None), (5, "a.pdf", "JVBERi0x"), (6, "a.rtf", "plain"), (7, "a.txt", "x"), (8, "a.docx", b64(b"PK\x03\x04" + bytes(50)))]
    read = {r["doc_id"]: (r["full_text"], r["error"] and r["error"].split(":")[0]) for r in ingest.ingest(spark.createDataFrame(files, "doc_id long, filename string, content string")).collect()}
    assert read == {1: ("One\n\nTwo", None), 2: (None, read[2][1]), 3: (None, read[3][1]), 4: (None, None), 5: (None, "no converter for pdf"), 6: (None, "ValueError"), 7: ("x", None), 8: (None, "BadZipFile")}
    assert read[2][1] and read[3][1]
    pages = spark.createDataFrame([(1, "<h1>A</h1><p>one</p><h2>B</h2><li>two</li><script>no</script>")], "page_id long, html string")
    got = [(r["text"], r["element_type"], r["section_path"]) for r in ingest.html_elements(pages, "page_id", "html").orderBy("ord").collect()]
    assert got == [("A", "heading", ["A"]), ("one", "paragraph", ["A"]), ("B", "heading", ["A", "B"]), ("two", "list_item", ["A", "B"])]


def test_exports(spark, tmp_path):
    rows = [(1, "1-1", 0, 5, "court", "u:1", "Court", "Actors", 0.95, "confirmed"), (1, "1-2", 6, 9, "law", "u:2", "Law", "Areas", 0.5, "rejected")]
    a = spark.createDataFrame(rows, "doc_id long, ann_id string, start int, end int, text string, iri string, label string, branch string, confidence double, state string")
    for name in export.WRITERS:
        export.export(a, name, f"{tmp_path}/{name}")
    assert spark.read.text(f"{tmp_path}/brat").first()["value"] == "T1\tActors 0 5\tcourt"
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 1
    docs = spark.createDataFrame([(1, "court <b>")], "doc_id long, text string")
    assert export.highlighted(docs, a).first()["html"] == '<mark class="high">court</mark> <mark class="low">&lt;b&gt;</mark>'


def test_part_of_speech(spark):
    from lexspan.operators import confidence

    s = spark.createDataFrame([(1, 10, "He can run fast", ["He", "can", "run", "fast"], ["PRON", "AUX", "VERB", "ADV"], ["PRP", "MD", "VB", "RB"])], "doc_id long, start int, text string, tokens array<string>, pos_tags array<string>, fine_tags array<string>")
    t = confidence.token_rows(s)
    assert [(r["start"], r["end"]) for r in t.orderBy("position").collect()] == [(10, 12), (13, 16), (17, 20), (21, 25)]
    spans = spark.createDataFrame([(1, 17, 20), (1, 90, 95)], "doc_id long, start int, end int")
    assert {r["start"]: r["pos"] for r in confidence.span_pos(spans, t).collect()} == {17: "VERB", 90: None}
    a = spark.createDataFrame([("run", "alternative", "VERB", 0.30, "preliminary"), ("court", "alternative", "NOUN", 0.35, "preliminary")], "text string, label_type string, pos string, confidence double, state string")
    got = {r["text"]: (r["confidence"], r["state"]) for r in confidence.concept_penalty(a).collect()}
    assert got == {"run": (0.15, "rejected"), "court": (0.35, "preliminary")}


def test_models(spark):
    from lexspan.operators import models

    def answer(prompts):
        return ['```json\n[{"mention": "Court", "confidence": 0.9}]\n```' for _ in prompts]

    df = spark.createDataFrame([(1, "the court of x", 100, "p")], "doc_id long, text string, chunk_start int, prompt string")
    found = models.in_chunk(models.answered_list(models.asked(df, "prompt", answer), "mention string, confidence double")).first()
    assert (found["start"], found["end"]) == (104, 109)

    def fails(prompts):
        raise ValueError("no")

    assert models.asked(df, "prompt", fails).first()["error"] == "ValueError: no"

    def some(prompts):
        if "bad" in prompts:
            raise ValueError("bad")
        return [p.upper() for p in prompts]

    mixed = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "bad", "b", "c"])], "doc_id long, prompt string").coalesce(1)
    assert [(r["answer"], r["error"]) for r in models.asked(mixed, "prompt", some).orderBy("doc_id").collect()] == [("A", None), (None, "ValueError: bad"), ("B", None), ("C", None)]


def test_ontology(spark, tmp_path):
    from lexspan.sources import ontology

    owl = tmp_path / "o.owl"
    owl.write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:skos="k"><owl:Class rdf:about="u/1"><rdfs:label>Actor</rdfs:label></owl:Class><owl:Class rdf:about="u/2"><rdfs:label>Judge</rdfs:label><rdfs:subClassOf rdf:resource="u/1"/><skos:altLabel>Justice</skos:altLabel></owl:Class></rdf:RDF>')
    c = ontology.read_owl(spark, str(owl))
    assert [(r["child"], r["parent"]) for r in ontology.edges(c).collect()] == [("u/2", "u/1")]
    assert {(r["label"], r["label_type"]) for r in ontology.labels(c).collect()} == {("Actor", "preferred"), ("Judge", "preferred"), ("Justice", "alternative")}
    root = str(tmp_path / "dim")
    ontology.publish(c.limit(1), root, 1)
    ontology.publish(c, root, 2)
    assert ontology.current(spark, root).count() == 2 and ontology.current(spark, root, back=1).count() == 1
    assert one(spark, ontology.actual_branches(F.array(F.lit("Document Metadata"), F.lit("Event")))) == ["Actor / Player", "Document / Artifact", "Event"]


def test_annotate(spark):
    from lexspan.plans import annotate

    docs = spark.createDataFrame([(1, "The  court ruled. A Supreme Court judge agreed."), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([("u:1", "court", "preferred"), ("u:2", "supreme court", "preferred"), ("u:3", "act", "alternative")], "iri string, label string, label_type string")
    rows = annotate.annotate(docs, labels).orderBy("start", F.desc("end")).collect()
    assert [(r["text"], r["iri"], r["confidence"], r["sentence_start"]) for r in rows] == [("court", "u:1", 0.72, 0), ("Supreme Court", "u:2", 0.9, 17), ("Court", "u:1", 0.72, 17)]


def test_pages_of_text(spark):
    c = lambda s: one(spark, text.dehyphenate(F.col("s")), s=s)
    assert c("One ends.\nNext line") == "One ends.\nNext line"
    assert c("it goes\non and con-\ntinues\nHere") == "it goes on and continues\nHere"
    assert c("end.\n 12 \nStart 12 of") == "end.\nStart 12 of"


def test_reconcile(spark):
    side = lambda *rows: spark.createDataFrame([(t, i, c, n) for n, (t, i, c) in enumerate(rows)], "text string, iri string, confidence double, ord long")
    got = lambda r, m: sorted((x["text"], x["iri"], x["category"], round(x["confidence"], 4)) for x in reconcile.reconcile(side(*r), side(*m)).collect())
    assert got([("Court", "u:1", 0.8)], [("court", None, 0.6)]) == [("court", "u:1", "both_agree", 0.81)]
    assert got([("court", "", 0.5)], [("court", "u:2", 0.9), ("court", "u:1", 0.7)]) == [("court", "u:1", "llm_only", 0.7), ("court", "u:2", "both_agree", 0.905)]
    assert got([("deal", "u:2", 0.8)], [("deal", "u:3", 0.6)]) == [("deal", "u:2", "ruler_only", 0.8), ("deal", "u:3", "llm_only", 0.6)]
    assert got([("the", "u:1", 0.5)], []) == [] and got([], []) == []
    assert got([("a", "u:1", 0.7), ("a", "u:1", 0.8)], []) == [("a", "u:1", "ruler_only", 0.8)]
    more = lambda *rows: spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "text string, iri string, confidence double, similarity double, overlap double, ord long")
    tri = lambda r, m: sorted((x["iri"], x["category"], round(x["confidence"], 4)) for x in reconcile.triaged(more(*r), more(*m)).collect())
    assert tri([("deal", "u:2", 0.8, 0.9, 0.0)], [("deal", "u:3", 0.95, 0.9, 1.0)]) == [("u:2", "conflict_resolved", 0.9)]
    assert tri([("deal", "u:2", 0.8, 0.1, 0.2)], [("deal", "u:3", 0.6, 0.2, 0.5)]) == [("u:3", "conflict_resolved", 0.6)]
    assert tri([("deal", "u:2", 0.8, 0.1, 0.5)], [("deal", "u:3", 0.6, 0.2, 0.5)]) == [("u:2", "conflict_resolved", 0.8), ("u:3", "conflict_resolved", 0.6)]
    assert tri([("deal", "", 0.8, 0.1, 0.5)], [("deal", "u:3", 0.6, 0.2, 0.5)]) == [("u:3", "both_agree", 0.81)]


def test_citations_and_entities(spark):
    said = "See 410 U.S. 113 (1973); 42 USC 1983; 17 C.F.R. § 240.10b-5; 12 Harv. L. Rev. 345. Id. at 5; 410 U.S. at 120; supra note 3."
    found = [(r["form"], r["text"], r["class"], r["normal_form"], r["url"]) for r in extract.citations(spark.createDataFrame([(1, said), (2, None)], "doc_id long, text string")).orderBy("start").collect()]
    assert found == [
        ("case", "410 U.S. 113 (1973)", "Caselaw", None, "https://cite.case.law/us/410/113/"),
        ("statute", "42 USC 1983", "Statute", "42 U.S.C. § 1983", "https://www.law.cornell.edu/uscode/text/42/1983"),
        ("regulation", "17 C.F.R. § 240.10b-5", "Statute", None, "https://www.law.cornell.edu/cfr/text/17/240.10b-5"),
        ("journal", "12 Harv. L. Rev. 345", "Legal Scholarship", None, None),
        ("id", "Id. at 5", "Caselaw", "Id.", None),
        ("short", "410 U.S. at 120", "Caselaw", "410 U.S., at 120", None),
        ("supra", "supra note 3", "Caselaw", "supra", None),
    ]
    cites = extract.citations(spark.createDataFrame([(1, said)], "doc_id long, text string"))
    more = spark.createDataFrame([(1, 4, 23, "410 U.S. 113 (1973)", None, None), (1, 0, 3, "See", None, "u")], "doc_id long, start int, end int, text string, normal_form string, url string")
    assert [(r["text"], r["confidence"]) for r in extract.with_more_citations(cites, more).filter("form = 'other'").collect()] == [("See", 0.9)]
    spans = spark.createDataFrame([(1, 0, 9, x, t) for x, t in (("Jane Doe", "PERSON"), ("Doe Holdings", "PERSON"), ("Habeas Corpus ", "ORG"), ("Acme", "ORG"), ("Ohio", "GPE"), ("1999", "DATE"))], "doc_id long, start int, end int, text string, tag string")
    assert [(r["text"], r["class"], r["confidence"]) for r in extract.entities(spans).collect()] == [("Jane Doe", "Person", 0.8), ("Doe Holdings", "Organization", 0.8), ("Acme", "Organization", 0.78), ("Ohio", "Location", 0.78)]


def test_extractor_errors_stay_alone(spark, monkeypatch):
    monkeypatch.setitem(extract.EXTRACTORS, "broken", extract.Extractor("x+", 0.5, group=7))  # a group that isn't there fails on every match
    rows = list(extract._finds("xx on 2024-01-05", extract._compiled(["broken", "date"])))
    assert [(r[0], r[3], bool(r[6])) for r in rows] == [("broken", None, True), ("date", "2024-01-05", False)]
    docs = spark.createDataFrame([(1, "on 2024-01-05")], "doc_id long, text string")
    assert [r["text"] for r in extract.extract(docs, ["date"], errors=True).collect()] == ["2024-01-05"]
    try:
        extract.register("bad", extract.Extractor("(", 0.5))
        raise AssertionError
    except re.error:
        assert "bad" not in extract.EXTRACTORS


def plain_individuals(rows):
    """The merge, looking at every kept row."""
    kept = []
    for r in sorted(rows, key=lambda r: (-extract.PRIORITY.get(r["source"], 0), r["start"], r["end"], r["name"])):
        for k in kept:
            x, y = r["name"].lower(), k["name"].lower()
            if (k["start"] < r["end"] and r["start"] < k["end"]) or x in y or y in x or r["mention"].lower() == k["mention"].lower():
                k["links"] += [z for z in r["links"] if z not in k["links"]]
                k["n"] += 1
                k["of"].add(r["source"])
                break
        else:
            kept.append({**r, "links": list(r["links"]), "n": 1, "of": {r["source"]}})
    return sorted((k["name"], k["start"], k["end"], k["source"] if len(k["of"]) == 1 else "hybrid", tuple(k["links"]), k["n"]) for k in kept)


def test_individuals_like_the_plain_merge(spark):
    rng = random.Random(12)
    names = ["Smith", "John Smith", "Acme", "Acme Corp", "Acme Corp Holdings", "Ohio", "ohio", "Doe"]
    rows = []
    for d in range(40):
        for _ in range(rng.randint(1, 40)):
            name, start = rng.choice(names), rng.randint(0, 3000)
            rows.append({"doc_id": d, "name": name, "mention": rng.choice([name, name.upper(), "it"]), "start": start, "end": start + rng.choice([3, 9, 700]), "source": rng.choice(["citation", "regex", "ner", "model"]), "links": [rng.choice("abc")]})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, name string, mention string, start int, end int, source string, links array<string>")
    key = lambda r: (r["name"], r["start"], r["end"], r["source"], tuple(r["links"]), r["n_merged"])
    by_doc = {}
    for r in extract.individuals(df).collect():
        by_doc.setdefault(r["doc_id"], []).append(key(r))
    assert {d: sorted(x) for d, x in by_doc.items()} == {d: plain_individuals([r for r in rows if r["doc_id"] == d]) for d in range(40)}
    docs = spark.createDataFrame([(d, "Acme® and $5") for d in range(40)], "doc_id long, text string").join(extract.gathered(df), "doc_id", "left")
    joined = extract.found_individuals(docs, ["money", "trademark"], more="more").collect()
    assert {r["name"] for r in joined} >= {"$5", "Acme®"} and any(r["source"] == "hybrid" for r in joined)


def test_writers_of_sections(spark, tmp_path):
    """Every format is written and found again, empty sections and signs in texts among them."""
    from lexspan.plans.export_queries import _sections
    from lexspan.sinks import sections

    s = _sections(spark, "/root/testdata/sf0.001")
    few = sections.Sections(s.annotations.filter("doc_id < 40"), s.individuals.filter("doc_id < 40").withColumn("name", F.lit('a "b" <c>, d\n')), s.properties.filter("doc_id < 40"), s.triples.limit(0))
    for name in sections.WRITERS:
        sections.write(few, name, f"{tmp_path}/{name}")
        assert any(tmp_path.joinpath(name).rglob("part-*")), name
    assert spark.read.parquet(f"{tmp_path}/parquet/individuals").count() == 40 and spark.read.parquet(f"{tmp_path}/parquet/triples").count() == 0
    back = spark.read.json(f"{tmp_path}/json")
    assert back.count() == 40 and {r["individuals"][0]["name"] for r in back.collect()} == {'a "b" <c>, d\n'}
    assert spark.read.format("xml").option("rowTag", "document").load(f"{tmp_path}/xml").count() == 40
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/brat/lines").collect()]
    index = {r["doc_id"]: r["n_lines"] for r in spark.read.parquet(f"{tmp_path}/brat/index").collect()}
    for d, n in index.items():  # a document's lines follow its head
        at = lines.index(f"# {d}")
        assert lines[at + 1].startswith("T1\t") and not any(x.startswith("# ") for x in lines[at + 1 : at + 1 + n])
    assert len(lines) == sum(index.values()) + len(index)
    rejected = few.annotations.filter("state = 'rejected'").count()
    assert rejected and sections.shown(few, include_dismissed=True).annotations.count() - sections.shown(few).annotations.count() == rejected
    docs = spark.createDataFrame([(1, "a < b court")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 6, 11, "u:1", "court", 0.95)], "doc_id long, start int, end int, iri string, label string, confidence double")
    export.TEXT_WRITERS["html"](found, docs, f"{tmp_path}/html")
    assert spark.read.parquet(f"{tmp_path}/html").first()["html"] == 'a &lt; b <mark class="high">court</mark>'
    export.TEXT_WRITERS["rag"](found, chunks.chunks(docs), f"{tmp_path}/rag")
    assert spark.read.json(f"{tmp_path}/rag").first()["entities"][0]["iri"] == "u:1"
    try:
        sections.write(few, "none", "x")
        raise AssertionError
    except KeyError:
        pass


def test_jobs_and_pages(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"job{i}.json").write_text('{\n "id": "j%d",\n "status": "completed", "annotations": [{"start": %d}]}' % (i, i))
    jobs = ingest.job_files(spark, str(tmp_path))
    assert jobs.count() == 3
    assert ingest.job_files(spark, f"{tmp_path}/job1.json").first()["annotations"][0]["start"] == 1  # one job alone
    pages = spark.createDataFrame([(1, 0, "a word cut-\nin two\ngoes on"), (1, 1, None)], "doc_id long, page int, text string")
    assert [r["text"] for r in ingest.pdf_pages(pages).orderBy("page").collect()] == ["a word cutin two goes on", None]


def test_index_of_vectors(spark, tmp_path):
    from lexspan.operators import models

    df = models.embedded(spark.createDataFrame([("a", "court"), ("b", "lease")], "iri string, text string"), "text", "iri")
    models.saved(df, f"{tmp_path}/index", "hashed")
    assert models.loaded(spark, f"{tmp_path}/index", "hashed", 2).columns == ["iri", "embedding"]
    for model, count in (("other", None), ("hashed", 3)):
        try:
            models.loaded(spark, f"{tmp_path}/index", model, count)
            raise AssertionError
        except ValueError:
            pass
    assert models.routed({"concept": "m1"}, "m0", {"property": "m2"})["concept"] == "m1"
    assert models.routed({}, None, {"property": "m2"}) == dict.fromkeys([t for t in models.MODEL_TASKS]) | {"property": "m2"}


def test_reject_leaves_feedback(spark):
    rows = spark.createDataFrame([(1, "a", "confirmed", ["made"]), (1, "b", "rejected", ["made"])], "job_id int, ann_id string, state string, lineage array<string>")
    old = spark.createDataFrame([(1, "a", "up", "")], "job_id int, ann_id string, rating string, note string")
    now, entries = annotations.rejected_with_feedback(rows, old, F.lit(True), "wrong")
    assert {r["ann_id"]: len(r["lineage"]) for r in now.collect()} == {"a": 2, "b": 1}
    assert [(r["ann_id"], r["rating"], r["note"]) for r in entries.collect()] == [("a", "dismissed", "wrong")]


def test_parses():
    p = triples.Parse(["a", "b", "c"], ["a", "b", "c"], ["NOUN", "VERB", "NOUN"], ["nsubj", "ROOT", "dobj"], [2, 1, 0])  # a and c hang from each other
    assert p.triples() == [] and p.phrase(1) == "b"
    deep = triples.Parse(["x"] * 5000, ["x"] * 5000, ["VERB"] + ["NOUN"] * 4999, ["ROOT", "dobj"] + ["nmod"] * 4998, [0, *range(4999)])
    assert deep.reach[1] == (1, 4999) and len(deep.phrase(1).split()) == 4999  # as long as a sentence may be
    assert triples.offsets("The court,  ruled", 7, ["The", "court", ",", "gone", "ruled"]) == [(7, 10), (11, 16), (16, 17), (17, 17), (19, 24)]
    got = triples.svo(["It", "is", "void"], ["it", "be", "void"], ["PRON", "AUX", "ADJ"], ["nsubj", "ROOT", "attr"], [1, 1, 1])
    assert got == [("It", "be", "void", "active", 0.6)]


def test_visible_branches():
    from lexspan.functions.constants import BRANCHES, EXCLUDED_BRANCHES
    from lexspan.operators import concepts

    names = concepts.visible_branches()
    assert names == sorted(names) and not set(names) & set(EXCLUDED_BRANCHES) and set(names) | set(EXCLUDED_BRANCHES) >= {n for n, _ in BRANCHES.values()}


def test_codes_are_compared_in_blocks_of_bounded_size(spark, monkeypatch):
    from lexspan.operators import vectors

    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<double>")
    rows = lambda: sorted(map(tuple, vectors.Codes.fit(v).search(v.filter("vec_id % 5 = 0"), 4).collect()))
    want = rows()
    monkeypatch.setattr(vectors, "NEAR_CELLS", 1)  # a query at a time
    assert rows() == want and len(want) == 240


def test_courts_are_looked_for_where_they_may_begin():
    from lexspan.operators import extract

    new = extract._compiled(["court"])
    e, rx, beginnings = new["court"]
    for text in ("xUnited States District Court", "the ſupreme Court of Ohio", "NİNTH circuit, SUPERIOR COURT of Kent", "s.d.N.Y. and U.S. Tax court", "Court of Court of Appeals for the City", ""):
        assert list(extract._finds(text, new)) == list(extract._finds(text, {"court": (e, rx, None)}))
    assert not list(beginnings.finditer("a plain line of text without any"))


def test_pos_of_finds_in_their_pass(spark):
    texts = ["pay $5 and  $6 now", "five days or 5 days five", "", None, "ten dollars 10 ten"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.split("text", " "))
    tagged = docs.withColumn("pos_tags", F.slice(F.transform("tokens", lambda x: F.when(x.rlike("[0-9]"), "NUM").otherwise("NOUN")), 1, 4)).withColumn("fine_tags", F.col("pos_tags"))
    apart = confidence.span_pos(extract.extract(docs, ["money", "duration"]).select("doc_id", "start", "end", "label"), confidence.token_rows(tagged.withColumn("start", F.lit(0))))
    from lexspan.plans.queries import QUERIES

    found = confidence.found_pos(tagged, ["money", "duration"])
    assert found.dtypes == apart.dtypes and sorted(map(str, found.collect())) == sorted(map(str, apart.collect())) and found.count() == 5
    assert "Join" not in (plan := QUERIES["span_pos"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan


def test_groups_are_picked_from_batches(spark):
    """Spans are resolved document by document without a call for each, wherever a batch ends."""
    rng = random.Random(8)
    spans = [(rng.choice([None, *range(9)]), s := rng.randrange(60), s + rng.randrange(1, 20), rng.choice([0.2, 0.5, 0.9]), rng.choice(["a", "b", None])) for _ in range(300)]
    df = spark.createDataFrame(spans, 'doc_id long, start int, `end` int, confidence double, text string')
    want = []
    for d in [None, *range(9)]:
        mine = sorted((x for x in spans if x[0] == d), key=lambda x: (x[1], x[2], x[3], x[4] is None, x[4] or ""))
        want += [mine[i] for i in overlap.kept([(x[1], x[2], x[3]) for x in mine])]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            found = overlap.resolve(df, "confidence")
            assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_individuals_are_kept_without_looking_twice():
    """An individual is lowered once when it is looked for and kept, and what a plain search finds is found."""
    lowered = []

    class Said(str):
        def lower(self):
            lowered.append(str(self))
            return str.lower(self)

    rng = random.Random(2)
    row = lambda w, s: {"name": w, "mention": w, "start": s, "end": s + rng.randrange(1, 400), "source": rng.choice(["regex", "ner", "citation"]), "links": [rng.choice("xy")], "normal_form": None, "url": None}
    rows = [row(Said(f"n{i}q"), 1000 * i) for i in range(20)]
    assert len(extract._merged(rows)) == 20 and len(lowered) == 20
    for _ in range(200):
        rows = [row("".join(rng.choice("abC ") for _ in range(rng.randint(1, 4))), rng.randrange(3000)) for _ in range(rng.randint(1, 12))]
        kept = []
        for r in sorted(rows, key=lambda r: (-extract.PRIORITY.get(r["source"], 0), r["start"], r["end"], r["name"])):
            n = r["name"].lower().strip()
            met = next((k for k in kept if n in k["name"].lower().strip() or k["name"].lower().strip() in n or (k["start"] < r["end"] and r["start"] < k["end"]) or k["mention"].lower().strip() == n), None)
            if met is None:
                kept.append({**r, "n": 1})
            else:
                met["n"] += 1
        assert [(k["name"], k["start"], k["end"], k["n"]) for k in kept] == [(x[0], x[2], x[3], x[-1]) for x in extract._merged(rows)]
