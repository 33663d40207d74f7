"""Sentence borders that know abbreviations, learned from the collection itself.

Whether a word that ends with a period is an abbreviation is decided by counts over all documents, as in
Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006): how far the period goes with
the word beyond chance (a log-likelihood ratio), less for long words, more for inner periods, and far less for words that also stand without a
period. Whether the next word opens a sentence all the same is decided by its cases: one that is written with a small letter
elsewhere, and with a capital only after end marks, opens one.

The counts are one aggregate over word types. What the splitter takes with it is bounded: the best ``MOST`` of each table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.constants import ABBREVIATIONS
from lexspan.staging import discard, staged

MOST = 10_000
#: Least score of an abbreviation, and how many times as often as with a capital in mid-sentence an opener stands with a small letter.
LEAST, OPENS = 0.3, 20
_WORD = regex.compile(r"\p{L}+(?:\.\p{L}+)*\.?|[\p{N}.,-]*\p{N}\.?|[.!?]+")
#: Pieces between white space, and characters of texts, that a task counts before it hands their words' counts on.
HELD, HELD_CHARS = 200_000, 32_000_000
_BORDER = re.compile(r"[.!?](\s+)(?=[A-Z])")
_BEFORE = re.compile(r"[^\s\"'“‘(\[]*\Z")
_NEXT = re.compile(r"\w+")
#: Characters before a border that may belong to its word.
_BACK = 64


class Knowledge(NamedTuple):
    """Abbreviations without their last period, and words that open a sentence, all in lower case."""

    abbreviations: frozenset[str]
    openers: frozenset[str]


def _words(piece: str) -> list[str]:
    """The words of a text without white space; most are letters, with a comma or a period at most."""
    if piece.isalpha():
        return [piece]
    if piece[-1] in ",." and piece[:-1].isalpha():
        return [piece.removesuffix(",")]
    return _WORD.findall(piece)


class _Ends(dict):
    """Of a piece whether its last word ends with an end mark: 1, 0, or 2 where it has no words."""

    def __missing__(self, piece: str) -> int:
        found = _words(piece)
        self[piece] = kind = (found[-1][-1] in ".!?") + 0 if found else 2
        return kind


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, n, n_opening): how often each word of a task's texts stands there, and how often at the start or after an end mark.

    No word has white space, so it is pieces between white space that are counted, and each piece is taken apart once.
    """
    n, first, ends, chars = Counter(), Counter(), _Ends(), 0

    def said() -> pa.RecordBatch:
        words, opening = Counter(), Counter()
        for piece, k in n.items():
            end, opens = False, first[piece]
            for x in _words(piece):
                words[x] += k
                opening[x] += opens or k * end
                end, opens = x[-1] in ".!?", 0
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64()), pa.array([opening[x] for x in words], pa.int64())], ["x", "n", "n_opening"])

    for b in batches:
        for text in b.column("text").to_pylist():
            pieces = (text or "").split()
            n.update(pieces)
            kinds = [ends[x] for x in pieces]
            if 2 in kinds:
                pieces, kinds = [x for x, k in zip(pieces, kinds, strict=True) if k != 2], [k for k in kinds if k != 2]
            first.update(pieces[:1])
            first.update(compress(pieces[1:], kinds))
            chars += len(text or "")
            if len(n) >= HELD or chars >= HELD_CHARS:
                yield said()
                n, first, ends, chars = Counter(), Counter(), _Ends(), 0
    if n:
        yield said()


def word_counts(docs: DataFrame) -> DataFrame:
    """(type, n_period, n_plain, n_small, n_capital, n_opening): of each word in lower case how often it has a period, not, a small letter, a capital in mid-sentence, a capital after an end mark.

    Words are counted in the task as they are written; what leaves it is a row for each, not one for each place.
    """
    one = docs.select("text").mapInArrow(_counted, "x string, n long, n_opening long").filter(F.col("x").rlike(r"^\p{L}"))
    period, capital = F.endswith("x", F.lit(".")), F.col("x").rlike(r"^\p{Lu}")
    count = lambda c, n, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    kind = F.lower(F.when(period, F.expr("left(x, length(x) - 1)")).otherwise(F.col("x")))
    inner = F.col("n") - F.col("n_opening")
    return one.groupBy(kind.alias("type")).agg(count(period, F.col("n"), "n_period"), count(~period, F.col("n"), "n_plain"), count(~capital, F.col("n"), "n_small"), count(capital, inner, "n_capital"), count(capital, F.col("n_opening"), "n_opening"))


def scored(counts: DataFrame) -> DataFrame:
    """Types that have had a period, with the ``score`` of each as an abbreviation. Totals are one row, joined to the types."""
    totals = counts.agg(F.sum("n_period").alias("periods"), F.sum(F.col("n_period") + F.col("n_plain")).alias("words"))
    x = counts.filter("n_period > 0").join(F.broadcast(totals))
    n, k = F.col("n_period") + F.col("n_plain"), F.col("n_period")
    p = F.least(F.col("periods") / F.col("words"), F.lit(1 - 1e-9))
    chance = k * F.log(p) + (n - k) * F.log(1 - p)  # against: nearly always with its period
    sure = k * F.log(F.lit(0.99)) + (n - k) * F.log(F.lit(0.01))
    letters, inner = F.length(F.replace("type", F.lit("."), F.lit(""))), F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    score = -2 * (chance - sure) * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -F.col("n_plain").cast("double"))
    return x.withColumn("score", score)


def learned(docs: DataFrame, known: list[str] = ABBREVIATIONS, most: int = MOST) -> Knowledge:
    """What the collection (doc_id, text) says, with the abbreviations ``known``; of each table the ``most`` best go to the driver."""
    made: list[str] = []
    counts = staged(word_counts(docs), "words", made)  # read three times, counted once
    best = scored(counts).filter(F.col("score") >= LEAST).orderBy(F.col("score").desc(), "type").select("type").limit(most).collect()
    opening = counts.filter((F.col("n_opening") > 0) & (F.col("n_small") > 0) & (F.col("n_capital") * OPENS <= F.col("n_small")))
    openers = opening.orderBy(F.col("n_opening").desc(), "type").select("type").limit(most).collect()
    discard(docs.sparkSession, made)
    return Knowledge(frozenset(r["type"] for r in best) | frozenset(known), frozenset(r["type"] for r in openers))


def abbreviated(word: str, known: Knowledge) -> bool:
    """A word with its period: a known abbreviation, a single letter, or letters with inner periods."""
    kind = word[:-1].lower()
    return kind in known.abbreviations or (len(kind) == 1 and kind.isalpha()) or ("." in kind and kind.replace(".", "").isalpha())


def spans(text: str, known: Knowledge) -> list[tuple[int, int]]:
    """Sentences' places, white space between them in none; a text without any but white space has none."""
    out, start = [], 0
    for m in _BORDER.finditer(text):
        at = m.start(1)
        before = _BEFORE.search(text[max(start, at - _BACK) : at]).group()
        if before.endswith(".") and abbreviated(before, known) and _NEXT.match(text, m.end()).group().lower() not in known.openers:
            continue
        out.append((start, at))
        start = m.end()
    out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def split(docs: DataFrame, known: Knowledge) -> DataFrame:
    """(doc_id, place, start, end, sentence) of texts. Null and blank texts have none; rows that share an id are split each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for b in batches:
            out = [(d, i, s, e, x[s:e]) for d, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if x for i, (s, e) in enumerate(spans(x, known))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "place", "start", "end", "sentence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place int, start int, end int, sentence string")
