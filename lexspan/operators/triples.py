"""Subject, predicate, object: from parsed sentences, and linked to what their spans touch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators.intervals import overlap_join

SUBJECTS, OBJECTS = ("nsubj", "nsubjpass"), ("dobj", "obj", "attr", "oprd")
_SPANS = [f"{part}_{end}" for part in ("subject", "predicate", "object") for end in ("start", "end")]
TRIPLE = "doc_id long, sentence_index int, subject string, predicate string, object string, voice string, confidence double, predicate_text string, " + ", ".join(f"{c} int" for c in _SPANS)
#: What of a subtree isn't part of its phrase: clauses, conjuncts, and what joins them.
_APART = ("relcl", "cc", "conj", "punct")
_VERBS, _NOUNS = ("VERB", "AUX"), ("NOUN", "PROPN")


class Parse:
    """One sentence's parse: each token's children, and the reach of its phrase, by one pass up from the leaves. Tokens in a cycle of heads hang from nothing."""

    def __init__(self, tokens: list[str], lemmas: list[str], pos: list[str], deps: list[str], heads: list[int]) -> None:
        self.tokens, self.lemmas, self.pos, self.deps, self.heads = tokens, lemmas, pos, deps, heads
        n = len(tokens)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i, h in enumerate(heads):
            if h != i and 0 <= h < n:
                self.children[h].append(i)
        order = [i for i, h in enumerate(heads) if h == i]
        for i in order:  # grows while it is read: parents before children
            order += self.children[i]
        self.reach = [(i, i) for i in range(n)]
        for i in reversed(order):
            h = heads[i]
            if h != i and deps[i] not in _APART:
                (a, b), (c, d) = self.reach[i], self.reach[h]
                self.reach[h] = (min(a, c), max(b, d))
        self.order = set(order)

    def below(self, i: int, *names: str) -> list[int]:
        return [j for j in self.children[i] if self.deps[j] in names]

    def phrase(self, i: int) -> str:
        """The words of a token's subtree, in order, without clauses and conjuncts."""
        found, open_ = [], [i]
        while open_:
            j = open_.pop()
            found.append(j)
            open_ += [k for k in self.children[j] if self.deps[k] not in _APART]
        return " ".join(self.tokens[j] for j in sorted(found))

    def verb(self, i: int) -> str:
        """A verb with the auxiliaries before it."""
        return " ".join([self.tokens[j] for j in self.below(i, "aux", "auxpass") if j < i] + [self.tokens[i]])

    def confidence(self, s: int, v: int, o: int, passive: bool) -> float:
        matches = (self.pos[s] in _NOUNS) + (self.pos[v] in _VERBS) + (self.pos[o] in _NOUNS)
        return round(min(0.85, max(0.30, 0.5 + 0.1 * matches - 0.05 * passive)), 2)

    def triples(self) -> list[tuple[int | None, int, int, str, str, float]]:
        """(subject, verb, object, predicate, voice, confidence) by tokens: main verbs, their conjuncts and relative clauses; prepositions join the predicate; passives with an agent turn round."""
        out = []
        for v in sorted(self.order):
            if self.pos[v] not in _VERBS or self.deps[v] not in ("ROOT", "relcl", "conj"):
                continue
            passive = bool(self.below(v, "nsubjpass", "auxpass"))
            subjects = self.below(v, *SUBJECTS)
            at = v
            while not subjects and self.deps[at] == "conj":
                at = self.heads[at]
                subjects = self.below(at, *SUBJECTS)
            if not subjects and self.deps[at] == "relcl":
                subjects = [self.heads[at]]
            subjects += [c for s in subjects if s != self.heads[at] for c in self.below(s, "conj")]
            direct = self.below(v, *OBJECTS)
            direct += [c for o in direct for c in self.below(o, "conj")]
            lemma = self.lemmas[v]
            targets = [(lemma, o) for o in direct] + [(f"{lemma} {self.lemmas[p]}", o) for p in self.below(v, "prep") for o in self.below(p, "pobj")]
            agents = [o for a in self.below(v, "agent") for o in self.below(a, "pobj")]
            for s in subjects:
                if passive and agents:
                    out += [(a, v, s, lemma, "passive", self.confidence(a, v, s, True)) for a in agents]
                elif passive and not targets:
                    out.append((None, v, s, lemma, "passive", 0.5))
                else:
                    out += [(s, v, o, predicate, "passive" if passive else "active", self.confidence(s, v, o, passive)) for predicate, o in targets]
        return out


def svo(tokens: list[str], lemmas: list[str], pos: list[str], deps: list[str], heads: list[int]) -> list[tuple[str, str, str, str, float]]:
    """Triples of one sentence as words: (subject, predicate, object, voice, confidence). A passive without an agent or other objects has an empty subject."""
    p = Parse(tokens, lemmas, pos, deps, heads)
    return [("" if s is None else p.phrase(s), predicate, p.phrase(o), voice, sure) for s, _, o, predicate, voice, sure in p.triples()]


def offsets(text: str, start: int, tokens: list[str]) -> list[tuple[int, int]]:
    """Places of a sentence's tokens, each looked for from the end of the one before; one that isn't found takes no place there."""
    out, at = [], 0
    for t in tokens:
        found = text.find(t, at)
        out.append((start + at, start + at) if found < 0 else (start + found, start + found + len(t)))
        at = at if found < 0 else found + len(t)
    return out


def triples(parsed: DataFrame) -> DataFrame:
    """From rows (doc_id, sentence_index, tokens, lemmas, pos, deps, heads), whichever parser made them, and perhaps the sentence's ``text`` and ``start``.

    ``predicate_text`` is the verb with its auxiliaries; spans are of whole phrases and of the verb, null without a text. Null lists give none.
    """
    names = ["tokens", "lemmas", "pos", "deps", "heads"]
    rows = parsed
    for name, kind in (("text", "string"), ("start", "int")):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.select("doc_id", "sentence_index", *names, "text", F.col("start").cast("double").alias("start"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if any(getattr(r, c) is None for c in names):
                    continue
                p = Parse(*(list(getattr(r, c)) for c in names))
                places = None if r.text is None or pd.isna(r.start) else offsets(r.text, int(r.start), p.tokens)

                def span(i, whole, p=p, places=places):
                    if i is None or places is None:
                        return None, None
                    a, b = p.reach[i] if whole else (i, i)
                    return places[a][0], places[b][1]

                for s, v, o, predicate, voice, sure in p.triples():
                    out.append((r.doc_id, r.sentence_index, "" if s is None else p.phrase(s), predicate, p.phrase(o), voice, sure, p.verb(v), *span(s, True), *span(v, False), *span(o, True)))
            columns = [c.split()[0] for c in TRIPLE.split(", ")]
            yield pd.DataFrame(out, columns=columns).astype(dict.fromkeys(_SPANS, "Int32"))

    return rows.mapInPandas(run, TRIPLE)


def linked(triples_: DataFrame, annotations: DataFrame) -> DataFrame:
    """Triple ends (doc_id, triple_id, role, start, end) with the annotations, not rejected, that they touch, ends included."""
    return overlap_join(triples_, annotations.filter("state <> 'rejected'"), touching=True).select("doc_id", F.col("a_triple_id").alias("triple_id"), F.col("a_role").alias("role"), F.col("b_iri").alias("iri"))


def mentions_within(ends: DataFrame, names: DataFrame) -> DataFrame:
    """Triple ends (doc_id, triple_id, role, text) and the names (doc_id, name) of the same document that occur in them, ignoring case."""
    return ends.join(names, "doc_id").filter(F.contains(F.lower("text"), F.lower("name")) & (F.col("name") != ""))


def properties_within(predicates: DataFrame, found: DataFrame) -> DataFrame:
    """Predicates (doc_id, triple_id, predicate) and the properties (doc_id, text, iri, ...) of the same document whose text occurs in them, ignoring case."""
    return predicates.join(found, "doc_id").filter(F.contains(F.lower("predicate"), F.lower("text")) & (F.col("text") != ""))


def enriched(triples_: DataFrame, annotations: DataFrame, individuals: DataFrame, properties: DataFrame) -> DataFrame:
    """Triples (doc_id, triple_id, subject, predicate, object, subject_start, ..., object_end) with what their parts are linked to, flat.

    A subject's or object's concept is that of the first annotation, not rejected, that its span touches; its individual the first
    whose mention it holds; the predicate's property the first whose text it holds. First goes by place, then by iri or id.
    """
    ends, names = [], []
    for role in ("subject", "object"):
        ends.append(triples_.filter(f"{role}_start IS NOT NULL").select("doc_id", "triple_id", F.lit(role).alias("role"), F.col(f"{role}_start").alias("start"), F.col(f"{role}_end").alias("end")))
        names.append(triples_.select("doc_id", "triple_id", F.lit(role).alias("role"), F.col(role).alias("said")))
    touched = overlap_join(ends[0].unionByName(ends[1]), annotations.filter("state <> 'rejected' AND iri IS NOT NULL"), touching=True)
    concept = touched.groupBy("doc_id", F.col("a_triple_id").alias("triple_id"), F.col("a_role").alias("role")).agg(F.min(F.struct("b_start", "b_iri")).alias("x")).select("doc_id", "triple_id", "role", F.col("x.b_iri").alias("concept"))
    said = names[0].unionByName(names[1]).withColumnRenamed("said", "text")
    held = mentions_within(said, individuals.select("doc_id", F.col("mention").alias("name"), "ind_id", "start"))
    person = held.groupBy("doc_id", "triple_id", "role").agg(F.min_by("ind_id", F.struct("start", "ind_id")).alias("individual"))
    named = properties_within(triples_.select("doc_id", "triple_id", "predicate"), properties.select("doc_id", "text", "iri", "start"))
    relation = named.groupBy("doc_id", "triple_id").agg(F.min_by("iri", F.struct("start", "iri")).alias("predicate_iri"))
    out = triples_
    for role in ("subject", "object"):
        of = lambda df, c, role=role: df.filter(F.col("role") == role).select("doc_id", "triple_id", F.col(c).alias(f"{role}_{c}"))
        out = out.join(of(concept, "concept"), ["doc_id", "triple_id"], "left").join(of(person, "individual"), ["doc_id", "triple_id"], "left")
    return out.join(relation, ["doc_id", "triple_id"], "left")
