"""Models as columns: a function from prompts to answers is plugged in, and what surrounds it is Spark.

``answer`` is any function from a list of prompts to as many answers. An answer that fails becomes a row with
``error``, so one bad document doesn't stop a job.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.constants import METADATA_FIELDS, MODEL_TASKS
from lexspan.functions.text import bookends, unfenced

Answer = Callable[[list[str]], list[str]]


def concept_prompt(text: Column, branches: list[str]) -> Column:
    return F.concat(F.lit("Name the concepts in this text, each as JSON {text, branch, confidence}. Branches: " + ", ".join(sorted(branches)) + ".\n\n"), text)


def rerank_prompt(text: Column, candidates: Column) -> Column:
    return F.concat(F.lit("Score from 0 to 1 how well each candidate fits the text; answer as a JSON object.\nCandidates: "), F.array_join(candidates, "; "), F.lit("\n\n"), text)


def branch_prompt(concept: Column, sentence: Column, branches: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Concept: "), concept), F.concat(F.lit("Sentence: "), sentence), F.concat(F.lit("Which of these branches? "), F.array_join(branches, ", ")))


def type_prompt(text: Column) -> Column:
    """Asks for a document's type by its two ends."""
    return F.concat(F.lit("What type of document is this? Answer with the type.\n\n"), bookends(text))


def individual_prompt(text: Column, annotations: Column) -> Column:
    """Asks for named individuals of a chunk, given its annotations as ``id: label`` strings."""
    return F.concat(F.lit("Name the individuals in this text, each as JSON {name, mention, class_ids, class_labels, confidence}. Annotations: "), F.array_join(annotations, "; "), F.lit("\n\n"), text)


def property_prompt(text: Column, known: Column) -> Column:
    """Asks for relations of a chunk, given those already found."""
    return F.concat(F.lit("Name the relations in this text, each as JSON {mention, domain, range, confidence}. Found already: "), F.array_join(known, "; "), F.lit("\n\n"), text)


def area_prompt(kind: Column, concepts: Column) -> Column:
    """Asks for areas of law, given a document's type and its concepts."""
    said = F.when(F.size(concepts) > 0, F.array_join(concepts, ", ")).otherwise(F.lit("none"))
    return F.concat(F.lit("Which areas of law is this document about? Answer as a JSON array of {area, confidence}.\nType: "), F.coalesce(kind, F.lit("unknown")), F.lit("\nConcepts: "), said)


def check_prompt(kind: Column, branches: Column, labels: Column) -> Column:
    """Asks whether a document's type fits what was found in it."""
    return F.concat(F.lit("Does the type fit what was found? Answer as JSON {severity, message}.\nType: "), F.coalesce(kind, F.lit("unknown")), F.lit("\nBranches: "), F.array_join(branches, ", "), F.lit("\nLabels: "), F.array_join(labels, ", "))


def severity(c: Column) -> Column:
    """A model's word for how grave something is, as one of info, warning and error."""
    low = F.lower(F.btrim(c))
    return F.when(low.isin("error", "critical", "high"), "error").when(low.isin("warning", "medium", "moderate"), "warning").otherwise("info")


def document_type(found: DataFrame, fallback: str = "Unknown") -> DataFrame:
    """Rows with ``answer`` and ``error`` of a type prompt as (..., document_type, confidence): JSON or a bare word; an error or nothing is the fallback at 0."""
    parsed = F.from_json(unfenced(F.col("answer")), "document_type string, confidence double")
    plain = F.btrim(unfenced(F.col("answer")))
    named = F.coalesce(parsed["document_type"], F.when(~F.startswith(plain, F.lit("{")) & (plain != ""), plain))
    bad = F.col("error").isNotNull() | named.isNull()
    return found.withColumn("document_type", F.when(bad, fallback).otherwise(named)).withColumn("confidence", F.when(bad, 0.0).otherwise(F.coalesce(parsed["confidence"], F.lit(1.0)))).drop("answer", "error")


def routed(configured: dict[str, str], default: str | None, tiers: dict[str, str] | None = None) -> dict[str, str | None]:
    """The model of each task: the one configured, else that of the task's tier, else the default; None if there is none."""
    return {t: configured.get(t) or (tiers or {}).get(t) or default for t in MODEL_TASKS}


def saved(vectors: DataFrame, path: str, model: str) -> None:
    """Writes an index (key, embedding) with the name of its model."""
    vectors.withColumn("model", F.lit(model)).withColumn("dim", F.size("embedding")).write.parquet(path)


def loaded(spark, path: str, model: str, count: int | None = None) -> DataFrame:
    """Reads an index that ``saved`` has written; one of another model, of mixed sizes or of another number of rows is refused."""
    df = spark.read.parquet(path)
    said = df.agg(F.collect_set("model").alias("m"), F.countDistinct("dim").alias("d"), F.count(F.lit(1)).alias("n")).first()
    if said["m"] != [model] or said["d"] != 1 or (count is not None and said["n"] != count):
        raise ValueError(f"the index at {path} is of {said['m']}, {said['n']} rows and {said['d']} sizes")
    return df.drop("model", "dim")


def asked(df: DataFrame, prompt: str, answer: Answer) -> DataFrame:
    """``df`` with ``answer`` and ``error``: prompts go to the model in batches, and those of a batch that fails one by one, so that an error is its own prompt's alone."""
    kept = [f for f in df.schema.fields if f.name not in ("answer", "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", answer string, error string"

    def tried(prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
        try:
            return list(answer(prompts)), [None] * len(prompts)
        except Exception as e:  # noqa: BLE001  the model's own errors, of any kind
            if len(prompts) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
        each = [tried([p]) for p in prompts]
        return [a[0] for a, _ in each], [e[0] for _, e in each]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, wrong = tried(pdf[prompt].tolist()) if len(pdf) else ([], [])
            yield pdf.assign(answer=found, error=wrong)

    return df.select(*[f.name for f in kept]).mapInPandas(run, schema)


def answered_list(df: DataFrame, schema: str) -> DataFrame:
    """The answers' JSON arrays, fenced or not, a row for each element; what isn't JSON gives none."""
    return df.select("*", F.explode(F.from_json(unfenced(F.col("answer")), f"array<struct<{schema}>>")).alias("found")).select(*df.columns, "found.*")


def in_chunk(found: DataFrame) -> DataFrame:
    """Mentions (mention) placed in their chunk (text, chunk_start): as written, else in any case; offsets are the document's."""
    exact = F.call_function("locate", F.col("mention"), F.col("text"))
    loose = F.call_function("locate", F.lower("mention"), F.lower("text"))
    at = F.when(exact > 0, exact).otherwise(loose)
    return found.withColumn("start", F.col("chunk_start") + at - 1).withColumn("end", F.col("chunk_start") + at - 1 + F.length("mention")).filter((at > 0) & (F.col("mention") != ""))


def best_per_text(df: DataFrame) -> DataFrame:
    """Per lower-case text the most confident row, the earliest of equals."""
    return df.groupBy(F.lower("text").alias("key")).agg(F.max_by(F.struct("text", "iri", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b")).select("key", "b.*")


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """A stand-in for a model: words hashed to signed places, of length 1."""
    out = np.zeros((len(texts), size))
    for i, x in enumerate(texts):
        for w in x.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embedded(df: DataFrame, text: str, key: str, embed: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """(key, embedding) of texts through an embedding function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": list(embed(pdf[text].fillna("").tolist()).astype("float32"))})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def index_text(label: Column, definition: Column, examples: Column) -> Column:
    """What is embedded for a concept: label, definition, and up to three examples."""
    return F.concat(label, F.when(F.coalesce(definition, F.lit("")) != "", F.concat(F.lit(": "), definition)).otherwise(F.lit("")), F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, F.concat(F.lit(". Examples: "), F.array_join(F.slice(examples, 1, 3), ", "))).otherwise(F.lit("")))


def monthly_cost(prices: DataFrame, tokens_in: int = 800, tokens_out: int = 200) -> DataFrame:
    """Cost of a call by model (model, in_cost, out_cost a token), also under its name without a provider's prefix."""
    cost = prices.select("model", F.round(F.col("in_cost") * tokens_in + F.col("out_cost") * tokens_out, 8).alias("cost"))
    bare = cost.filter(F.contains("model", F.lit("/"))).select(F.substring_index("model", "/", -1).alias("model"), "cost")
    return cost.unionByName(bare).groupBy("model").agg(F.min("cost").alias("cost"))


def metadata_prompt(kind: Column, block: Column) -> Column:
    """Asks for a document's fields, given its type and what is known of it."""
    names = ", ".join(f"{k} (a list)" if many else k for k, many in METADATA_FIELDS.items())
    return F.concat(F.lit(f"Fill in what the context says of these fields; leave out the others. Answer as one JSON object. Fields: {names}.\nType: "), F.coalesce(kind, F.lit("unknown")), F.lit("\n\n"), block)


def metadata_fields(answers: DataFrame) -> DataFrame:
    """(doc_id, a column for each field) of answers (doc_id, answer): the object's known fields, texts or lists of texts; what isn't JSON, or of another kind, gives nulls.

    A single text for a list is a list of one; blank texts and empty lists are null; other fields are passed over.
    """
    said = F.from_json(unfenced(F.col("answer")), ", ".join(f"`{k}` string" for k in METADATA_FIELDS))
    met = answers.select("doc_id", said.alias("said"))

    def one(name: str, many: bool) -> Column:
        c = F.btrim(F.col(f"said.{name}"))
        if not many:
            return F.when((c != "") & ~F.startswith(c, F.lit("[")) & ~F.startswith(c, F.lit("{")), c).alias(name)
        parts = F.when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>")).when((c != "") & ~F.startswith(c, F.lit("{")), F.array(c))
        kept = F.filter(parts, lambda x: x.isNotNull() & (F.btrim(x) != ""))
        return F.when(F.size(kept) > 0, kept).alias(name)

    return met.select("doc_id", *[one(k, many) for k, many in METADATA_FIELDS.items()])
