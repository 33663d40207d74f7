"""Parts of speech looked up for spans, and what they and models do to confidence and state."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.scoring import blend, clamp
from lexspan.operators import extract
from lexspan.operators.intervals import overlap_join
from lexspan.operators.metadata import majority

#: Penalties and bounds.
CONCEPT_PENALTY, PROPERTY_PENALTY, AFFINITY, REJECT_BELOW = 0.15, 0.12, 0.05, 0.20


def token_rows(sentences: DataFrame) -> DataFrame:
    """(doc_id, start, end, token, pos, tag, position) from sentences (doc_id, start, text, tokens, pos_tags, fine_tags): tokens found one after the other, one that isn't found standing where the last one ended."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.text is None or r.tokens is None:
                    continue
                at = 0
                tags, fine = (list(x) if x is not None else [] for x in (r.pos_tags, r.fine_tags))
                for i, token in enumerate(r.tokens):
                    found = r.text.find(token, at)
                    at = at if found < 0 else found
                    out.append((r.doc_id, r.start + at, r.start + at + len(token), token, tags[i] if i < len(tags) else None, fine[i] if i < len(fine) else None, i))
                    at += len(token)
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "token", "pos", "tag", "position"])

    return sentences.select("doc_id", F.col("start").cast("int").alias("start"), "text", "tokens", "pos_tags", "fine_tags").mapInPandas(run, "doc_id long, start int, end int, token string, pos string, tag string, position int")


def span_pos(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end) with the most frequent part of speech of the tokens they overlap, the first seen of equals."""
    met = overlap_join(spans.select("doc_id", "start", "end").distinct(), tokens)
    best = majority(met, ["doc_id", "a_start", "a_end"], "b_pos", "b_start")
    return spans.join(best.select("doc_id", F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("b_pos").alias("pos")), ["doc_id", "start", "end"], "left")


def found_pos(docs: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, start, end, label, pos): finds of the named extractors in rows (doc_id, text, tokens, pos_tags), each of one sentence.

    As ``span_pos`` of ``extract.extract`` and ``token_rows``, but in the pass that finds them: no token becomes a row. Rows that share an id have their own tokens.
    """
    chosen = extract._compiled(names)
    kinds = {"doc_id": pa.int64(), "start": pa.int32(), "end": pa.int32(), "label": pa.string(), "pos": pa.string()}

    def places(text: str, tokens: list[str]) -> tuple[list[int], list[int]]:
        starts, ends, at = [], [], 0
        for token in tokens:
            found = text.find(token, at)
            at = at if found < 0 else found
            starts.append(at)
            at += len(token)
            ends.append(at)
        return starts, ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, tokens, tags = (b.column(c).to_pylist() for c in ("doc_id", "text", "tokens", "pos_tags"))
            out: list[tuple] = []
            for doc_id, text, words, said in zip(ids, texts, tokens, tags, strict=True):
                spans = [(s, e, label) for label, s, e, *_, error in extract._finds(text or "", chosen) if error is None]
                if not spans:
                    continue
                words, said = (words if text is not None else None) or [], said or []
                starts, ends = places(text or "", words)
                longest = max(map(len, words), default=0)
                for start, end, label in spans:
                    counts: dict[str | None, int] = {}
                    for i in range(bisect.bisect_left(starts, start - longest), bisect.bisect_left(starts, end)):
                        if ends[i] > start:
                            tag = said[i] if i < len(said) else None
                            counts[tag] = counts.get(tag, 0) + 1
                    out.append((doc_id, start, end, label, max(counts, key=counts.__getitem__) if counts else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    return docs.select("doc_id", "text", "tokens", "pos_tags").mapInArrow(run, "doc_id long, start int, end int, label string, pos string")


def concept_penalty(df: DataFrame) -> DataFrame:
    """One-word alternative labels that are verbs or adverbs lose confidence; below the floor they are rejected."""
    single = ~F.contains(F.btrim("text"), F.lit(" "))
    hit = single & (F.col("label_type") == "alternative") & F.col("pos").isin("VERB", "ADV")
    lowered = F.when(F.coalesce(hit, F.lit(False)), clamp(F.col("confidence") - CONCEPT_PENALTY)).otherwise(F.col("confidence"))
    return df.withColumn("confidence", F.round(lowered, 4)).withColumn("state", F.when(F.col("confidence") < REJECT_BELOW, "rejected").otherwise(F.col("state")))


def property_penalty(df: DataFrame) -> DataFrame:
    """One-word properties found by the automaton that are nouns lose confidence."""
    hit = ~F.contains(F.btrim("text"), F.lit(" ")) & (F.col("source") == "automaton") & F.col("pos").isin("NOUN", "PROPN")
    return df.withColumn("confidence", F.round(F.when(F.coalesce(hit, F.lit(False)), clamp(F.col("confidence") - PROPERTY_PENALTY)).otherwise(F.col("confidence")), 4))


def reranked(resolved: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows (text, iri, confidence) blended half and half with a model's scores, clamped, for the same text, in any case, and iri."""
    s = scores.select(F.lower("text").alias("key"), "iri", clamp(F.col("score")).alias("score")).groupBy("key", "iri").agg(F.max("score").alias("score"))
    met = resolved.withColumn("key", F.lower("text")).join(s, ["key", "iri"], "left")
    return met.withColumn("confidence", F.when(F.col("score").isNull(), F.col("confidence")).otherwise(blend(F.col("confidence"), F.col("score"), 0.5))).drop("key", "score")


def judged(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (item_id, confidence, state, lineage array<string>) with a judge's branch and score: 70 to 30, at most 1.

    With a branch a row is confirmed, without one rejected; its part of speech (``pos``, if there is one) then adds or takes a little.
    """
    met = items.join(verdicts.select("item_id", F.col("branch").alias("judged_branch"), F.col("score").alias("judge")), "item_id", "left")
    has = F.coalesce(F.col("judged_branch"), F.lit("")) != ""
    value = F.least(F.lit(1.0), F.col("confidence") * 0.7 + F.col("judge") * 0.3)
    if "pos" in items.columns:
        value = F.when(has, clamp(value + affinity(F.col("pos"), F.col("judged_branch")))).otherwise(value)
    asked = F.col("judge").isNotNull()
    note = F.when(has, F.concat(F.lit("branch "), "judged_branch")).otherwise(F.lit("no branch"))
    return met.withColumn("confidence", F.when(asked, value).otherwise(F.col("confidence"))).withColumn("state", F.when(asked, F.when(has, "confirmed").otherwise("rejected")).otherwise(F.col("state"))).withColumn("lineage", F.when(asked, F.concat("lineage", F.array(note))).otherwise(F.col("lineage"))).drop("judge")


def property_confidence(kind, text):
    """By label type, and more for several words."""
    base = F.when(kind == "preferred", 0.85).when(kind == "lemma", 0.72).otherwise(0.75)
    return F.round(base + F.when(F.contains(F.btrim(text), F.lit(" ")), 0.05).otherwise(0.0), 4)


#: Words of branch names that verbs fit, and that nouns fit.
ACTIONS = ["process", "granting", "filing", "action", "procedure", "activity"]
ENTITIES = ["document", "person", "organization", "role", "asset", "thing", "object"]


def affinity(pos, branch):
    """A little more for verbs in branches of actions and nouns in those of entities, a little less the other way round."""
    low = F.lower(branch)
    acts, is_thing = low.rlike("|".join(ACTIONS)), low.rlike("|".join(ENTITIES))
    verb, noun = pos.isin("VERB", "AUX"), pos.isin("NOUN", "PROPN")
    return F.coalesce(F.when(verb & acts, AFFINITY).when(verb & is_thing, -AFFINITY).when(noun & is_thing, AFFINITY).when(noun & acts, -AFFINITY), F.lit(0.0))


def in_context(resolved: DataFrame, similarity: str) -> DataFrame:
    """Rows whose definition isn't empty blend confidence and the similarity of sentence and definition 60 to 40; others stay."""
    known = (F.coalesce("definition", F.lit("")) != "") & F.col(similarity).isNotNull()
    return resolved.withColumn("confidence", F.when(known, blend(F.col("confidence"), clamp(F.col(similarity)), 0.6)).otherwise(F.col("confidence")))
