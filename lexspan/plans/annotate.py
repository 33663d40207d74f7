"""The annotation pipeline over a collection: text to spans, concepts, confidence, state and statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators import chunks, lexicon


#: Unicode's white space without newline and space, as ``normalize_whitespace`` has it.
_BLANK = "\t\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN, _LINES, _AROUND = re.compile(f"[{_BLANK}][ {_BLANK}]*| [ {_BLANK}]+"), re.compile("\n{3,}"), re.compile(" \n ?|\n ")


def normalized(text: str) -> str:
    """As ``normalize_whitespace``, of one text: the JVM's patterns take several times as long over a collection."""
    return _AROUND.sub("\n", _LINES.sub("\n\n", _RUN.sub(" ", text))).strip(" \n")


def canonical(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with white space normalised; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([normalized(x or "") for x in b.column("text").to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def annotate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, ann_id, start, end, text, iri, label_type, confidence, state, lineage array<string>, sentence_start, sentence_end).

    Labels (iri, label, label_type) are admitted, indexed and matched; crossing spans are resolved within each
    document; each span gets its sentence, and its lineage says where it comes from. Confidence is the label type's; below 0.6 a match stays preliminary.
    """
    return annotated(canonical(docs), labels)


def annotated(text: DataFrame, labels: DataFrame) -> DataFrame:
    """As ``annotate``, of texts that are canonical already: each is read once, and its spans get their sentences where they are found."""
    index = lexicon.multi_index(lexicon.admitted(labels)).select("label_key", "iri", "label", "label_type")
    spans = lexicon.match(text, index, resolve=True, sentences=lambda x: chunks.located(x, chunks.split(x))).withColumnRenamed("surface", "text")
    out = spans.withColumn("confidence", lexicon.confidence(F.col("label_type"), F.col("label")))
    ann_id = F.sha2(F.concat_ws("|", "doc_id", "start", "end", "iri"), 256)  # the same in every run
    state = F.when(F.col("confidence") >= 0.6, "confirmed").otherwise("preliminary")
    lineage = F.array(F.concat(F.lit("lexicon: "), "label_type", F.lit(" label")), F.concat(F.lit("state: "), state))
    return out.select("doc_id", ann_id.alias("ann_id"), "start", "end", "text", "iri", "label_type", "confidence", state.alias("state"), lineage.alias("lineage"), "sentence_start", "sentence_end")
