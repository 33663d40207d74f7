"""Toxicity scores by loops over words and trees, and fingerprints of long texts."""

import bisect
import math
import random
import re

import pytest
from test_llm_queries import plain_winnow

from lexspan.llm import toxicity, winnowing


def plain_features(text, lexicon):
    """Each feature by itself, every pair of places for nearness."""
    words = re.findall(r"[^\s.,;:!?\"()\[\]{}<>«»„“”…]+", text)
    n = len(words)
    if not n:
        return [0.0] * 16
    leet = dict(zip("013457@$", "oieastas", strict=True))
    plain = [w.lower() if w.lower().isalpha() else "".join(leet.get(c, c) for c in w.lower()) for w in words]
    hits = [lexicon.words[w] for w in plain if w in lexicon.words]
    stems = [lexicon.stems[w[:5]] for w in plain if w[:5] in lexicon.stems]
    places = [i for i, w in enumerate(plain) if w in lexicon.words or w[:5] in lexicon.stems or w in toxicity.INSULTS]
    you = [i for i, w in enumerate(words) if w.lower() in toxicity.SECOND]
    near = sum(any(abs(i - j) <= 8 for j in you) for i in places)
    insults = sum(w in toxicity.INSULTS for w in plain)
    return [
        math.log1p(n), sum(hits) / n * 100, sum(stems) / n * 100, insults / n * 100, max(hits, default=0.0), max(stems, default=0.0), len(places) / n * 100, len(you) / n * 100, near / n * 100,
        sum(c.isupper() for c in text) / len(text), sum(len(w) > 1 and w.isupper() for w in words) / n, text.count("!") / n, text.count("?") / n, sum(c in ".,;:!?" for c in text) / len(text),
        sum(p != w.lower() and p.isalpha() for w, p in zip(words, plain, strict=True)) / n, sum(bool(re.search(r"(.)\1\1", w.lower())) for w in words) / n,
    ]


def walked(node, x):
    while node.subtreeDepth() > 0:
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def interpolated(at, xs, ys):
    if at <= xs[0]:
        return ys[0]
    if at >= xs[-1]:
        return ys[-1]
    i = bisect.bisect_left(xs, at)
    return ys[i] if xs[i] == at else ys[i - 1] + (ys[i] - ys[i - 1]) * (at - xs[i - 1]) / (xs[i] - xs[i - 1])


def test_scores_by_loops(spark):
    """The fitted trees walked node by node over features counted word by word, and the calibration by its own points."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    roots = [(t._java_obj.rootNode(), w) for t, w in zip(model.trees.trees, model.trees.treeWeights, strict=True)]
    xs, ys = (list(v) for v in (model.calibration.boundaries, model.calibration.predictions)) if model.calibration else (None, None)
    rows = model.scored(docs.select("doc_id", "text"), ["doc_id", "text"]).orderBy("doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows[::4]:  # a walk through Java's nodes is slow; the features are compared for all below
        x = plain_features(r["text"] or "", model.lexicon)
        raw = 1 / (1 + math.exp(-2 * sum(w * walked(root, x) for root, w in roots)))
        want = interpolated(raw, xs, ys) if xs else raw
        assert r["score"] == pytest.approx(min(max(want, 0.0), 1.0), abs=1e-9)
    for r in rows:
        assert toxicity.features(r["text"] or "", model.lexicon) == pytest.approx(plain_features(r["text"] or "", model.lexicon))


def test_winnow_long(spark):
    """Long texts, of the table and made ones, by looking at every window."""
    rng = random.Random(11)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    long = sorted((r["text"] for r in rows if r["text"] and len(r["text"]) > 6_000), key=len)
    made = ["".join(rng.choices("ab ", k=20_000)), "".join(rng.choices("añ𝒳z\n", k=20_000)), "xyz" * 7_000, "q" * 20_000]
    assert long
    for x in [*long[:6], long[-1], *made]:
        h, p = winnowing.winnow(x)
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == plain_winnow(x)
