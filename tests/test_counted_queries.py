"""Queries over whole tables that SQL can't express, said again row by row."""

import html
import re
import zlib

import numpy as np
from test_plain_versions import table

from lexspan.operators import extract
from lexspan.plans import bindings
from lexspan.plans.queries import QUERIES

BLOCK = "p|li|td|th|blockquote|h[1-6]"


def plain_elements(page):
    """Blocks by cutting a page at its tags."""
    page = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "", page or "")
    found, path, name, held = [], [], "", ""

    def close():
        text = " ".join(html.unescape(held).split())
        if not name or not text:
            return
        level = int(name[1]) if name[0] == "h" else None
        if level:
            path[level - 1 :] = [text]
        kind = "heading" if level else {"li": "list_item", "td": "table_cell", "th": "table_cell"}.get(name, "paragraph")
        found.append((len(found), text, kind, tuple(path), level))

    for piece in re.split(r"(<[^>]*>)", page):
        tag = re.fullmatch(rf"(?is)<(/?)({BLOCK})\b[^>]*>", piece)
        if not tag:
            held += "" if piece.startswith("<") else piece
        elif not tag[1] or tag[2].lower() == name:
            close()
            name, held = "" if tag[1] else tag[2].lower(), ""
    close()
    return found


def test_html_elements(spark, sf):
    want = {(r["page_id"], *x) for r in table(spark, sf, "pages") for x in plain_elements(r["html"])}
    got = [(r["page_id"], r["ord"], r["text"], r["element_type"], tuple(r["section_path"]), r["level"]) for r in QUERIES["html_elements"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {x[3] for x in got} >= {"heading", "paragraph", "list_item"}


def test_export_html(spark, sf):
    """A character at a time: the first span, by start and end, that holds it, and a new mark at each border."""
    docs = bindings.sentences(spark, sf)
    spans = {}
    for r in extract.extract(docs, ["money", "date", "court"]).collect():
        c = r["confidence"]
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"], "high" if c >= 0.9 else "mid" if c >= 0.6 else "low" if c >= 0.45 else "faint"))
    want = {}
    for r in docs.collect():
        mine, out, text = sorted(spans.get(r["doc_id"], [])), "", r["text"]
        cuts = sorted({0, len(text), *(x for s in mine for x in s[:2])})
        for i, j in zip(cuts, cuts[1:], strict=False):
            tier = next((t for s, e, t in mine if s <= i and j <= e), None)
            piece = html.escape(text[i:j]).replace("&#x27;", "'")
            out += f'<mark class="{tier}">{piece}</mark>' if tier else piece
        if mine:
            want[r["doc_id"]] = out
    got = {r["doc_id"]: r["html"].replace("&#39;", "'").replace("&#x27;", "'") for r in QUERIES["export_html"](spark, sf).collect()}
    assert got == want
    plain = {k: html.unescape(re.sub(r"</?mark[^>]*>", "", x)) for k, x in got.items()}
    assert plain == {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in plain}


def test_label_embeddings(spark, sf):
    got = {r["p_partkey"]: r["embedding"] for r in QUERIES["label_embeddings"](spark, sf).collect()}
    parts = table(spark, sf, "part")
    assert len(got) == len(parts)
    for r in parts:
        want = np.zeros(64)
        for w in f"{r['p_name']}: {r['p_type']}. Examples: {r['p_brand']}".lower().split():
            h = zlib.crc32(w.encode())
            want[h % 64] += 1 if h >> 16 & 1 else -1
        n = np.sqrt((want**2).sum())
        assert np.allclose(got[r["p_partkey"]], want / (n or 1), atol=1e-6)


def test_model_answers(spark, sf):
    """The stand-in answers by the prompt's length, so every answer tells whether its own whole prompt was asked."""
    ends = {r["doc_id"]: r["ends"] for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS ends").collect()}
    head = len("What type of document is this? Answer with the type.\n\n")
    got = {r["doc_id"]: (r["answer"], r["error"]) for r in QUERIES["model_answers"](spark, sf).collect()}
    assert got == {k: (f"type {(head + (1505 if len(x) > 1500 else len(x))) % 3}", None) for k, x in ends.items()}


def test_ingest_documents(spark, sf):
    """Pages and documents, each once; a page's text is that of ``html_to_text``, whose SQL is its own."""
    got = sorted((r["format"], r["doc_id"], r["n_chars"]) for r in QUERIES["ingest_documents"](spark, sf).collect())
    pages, docs = table(spark, sf, "pages"), table(spark, sf, "documents")
    assert [x[:2] for x in got] == sorted([("html", r["page_id"]) for r in pages] + [("markdown", r["doc_id"]) for r in docs])
    sizes = {(f, k): n for f, k, n in got}
    for r in docs:
        if not re.search(r"[`*_\[\]#!+-]|(?m:^\s*[0-9]+\.)", r["text"] or ""):
            assert sizes["markdown", r["doc_id"]] == len((r["text"] or "").strip(" \n\t\r"))
    for r in pages:
        text = re.sub(r"(?is)<(script|style|head)\b[^>]*>.*?</(?:script|style|head)\s*>", " ", r["html"] or "")
        text = re.sub(r"(?s)<!--.*?-->|<[^>]*>", " ", text)
        # the six common entities only; others stay as they are written
        text = re.sub(r"&(nbsp|lt|gt|quot|#39|amp);", lambda m: {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "amp": "&"}[m[1]], text)
        assert sizes["html", r["page_id"]] == len(re.sub(r"[ \t\r\n]+", " ", text).strip(" "))
