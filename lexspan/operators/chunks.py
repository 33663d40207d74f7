"""Sentences with their offsets, and chunks of them with overlap: one ordered pass over each document.

Splitting, finding and filling depend on what came before within a document, never on another one, so
documents stream through Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SIZE, OVERLAP = 3000, 200

_BORDER = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z])")

#: How texts are cut to sentences; another function may take its place.
Splitter = Callable[[str], list[str]]


def split(text: str) -> list[str]:
    return [s for s in _BORDER.split(text) if s.strip(" \n\t\r")]


def located(text: str, parts: list[str]) -> list[tuple[int, int]]:
    """Start and end of each part, looked for from the end of the one before; not found, it stands there."""
    out, at = [], 0
    for p in parts:
        start = text.find(p, at)
        start = at if start < 0 else start
        at = start + len(p)
        out.append((start, at))
    return out


def filled(spans: list[tuple[int, int]], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Chunks (start, end, first, last sentence).

    A chunk is closed before the sentence that would take it beyond ``size``; the next one begins with those
    last sentences that together stay within ``overlap``, but never with the whole chunk. A sentence longer
    than ``size`` is a chunk.
    """
    out, first = [], 0
    for i, (_, end) in enumerate(spans):
        if i > first and end - spans[first][0] > size:
            last_end = spans[i - 1][1]
            out.append((spans[first][0], last_end, first, i - 1))
            carried = i
            while carried - 1 > first and last_end - spans[carried - 1][0] <= overlap:
                carried -= 1
            first = carried
    if spans:
        out.append((spans[first][0], spans[-1][1], first, len(spans) - 1))
    return out


def sentences(docs: DataFrame, splitter: Splitter = split) -> DataFrame:
    """(doc_id, sentence, start, end, text). Null and empty texts have none."""

    def rows(doc_id: int, text: str) -> list[tuple]:
        return [(doc_id, i, a, b, text[a:b]) for i, (a, b) in enumerate(located(text, splitter(text)))]

    return _mapped(docs, rows, "doc_id long, sentence int, start int, end int, text string", (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, splitter: Splitter = split) -> DataFrame:
    """(doc_id, chunk_index, start, end, first, last): chunks with true offsets into the text."""

    def rows(doc_id: int, text: str) -> list[tuple]:
        return [(doc_id, i, *c) for i, c in enumerate(filled(located(text, splitter(text)), size, overlap))]

    return _mapped(docs, rows, "doc_id long, chunk_index int, start int, end int, first int, last int", (pa.int64(), *[pa.int32()] * 5))


def _mapped(docs: DataFrame, rows: Callable[[int, str], list[tuple]], schema: str, kinds: tuple[pa.DataType, ...]) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for r in rows(d, t or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
