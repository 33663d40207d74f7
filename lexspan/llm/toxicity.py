"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

Labelled rows whose crc32(doc_id) mod 4 is not 2 are drawn, by hash, down to at most SAMPLE rows; this
bound is the one place where a part stands for the whole, and only for fitting. They are split by hash
again: from the first part comes a learned lexicon (words and word beginnings that toxic texts have
and others lack), the second fits the trees, the third the calibration. Every text is scored.

Features look at the text alone: densities of the learned and of a written lexicon, how near its words
stand to each other and to the second person, capitals, punctuation, obfuscated and stretched words.

Null or empty text has features of 0 and a score like any other. Without usable labels of both kinds the
score is the share of toxic labels, 0 if there are none. Repeated rows are scored each; a document with both
labels teaches both.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import release, small, staged

SAMPLE = 20_000
LEXICON = 3_000
THRESHOLD = 0.3
STEM = 5  # characters of a word beginning
NEAR = 8  # words that count as near
TREES, DEPTH = 24, 4

#: Insults, words of the second person, and characters that stand for letters.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash garbage clown fool fools ugly hate kill shut freak filthy jerk imbecile vermin".split())
SECOND = frozenset("you your yours yourself youre ur u du dich dir dein deine deinen ihr euch tu toi te ton ta tes vous votre ti usted ustedes vosotros tuyo".split())
LEET = str.maketrans("013457@$", "oieastas")

_WORD = re.compile(r"[^\s.,;:!?\"()\[\]{}<>«»„“”…]+")
_STRETCHED = re.compile(r"(.)\1\1")
NAMES = ("log_words", "lexicon", "stems", "insults", "lexicon_max", "insults_max", "hit_share", "second", "near_second", "capitals", "shouted", "exclaimed", "asked", "punctuation", "obfuscated", "stretched")


@dataclass
class Lexicon:
    """Weights of words and of word beginnings: the log odds of toxic over other texts."""

    words: dict[str, float]
    stems: dict[str, float]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text)


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = tokens(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    low = [w.lower() for w in words]
    found, stems = lexicon.words, lexicon.stems
    plain = [w.translate(LEET) if not w.isalpha() else w for w in low]
    hits = [(i, found.get(w, 0.0)) for i, w in enumerate(plain) if w in found]
    begun = [(i, stems[w[:STEM]]) for i, w in enumerate(plain) if w[:STEM] in stems]
    insults = [i for i, w in enumerate(plain) if w in INSULTS]
    second = [i for i, w in enumerate(low) if w in SECOND]
    places = np.array(sorted({i for i, _ in hits} | {i for i, _ in begun} | set(insults)))
    you = np.array(second)
    near = 0
    if len(places) and len(you):
        at = np.searchsorted(you, places)
        gap = np.minimum(np.abs(places - you[np.minimum(at, len(you) - 1)]), np.abs(places - you[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    letters = len(text)
    marks = sum(text.count(c) for c in ".,;:!?")
    return [
        float(np.log1p(n)),
        sum(x for _, x in hits) / n * 100,
        sum(x for _, x in begun) / n * 100,
        len(insults) / n * 100,
        max((x for _, x in hits), default=0.0),
        max((x for _, x in begun), default=0.0),
        len(places) / n * 100,
        len(you) / n * 100,
        near / n * 100,
        sum(map(str.isupper, text)) / letters,
        sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        text.count("!") / n,
        text.count("?") / n,
        marks / letters,
        sum(1 for w, p in zip(low, plain, strict=True) if p != w and p.isalpha()) / n,
        sum(1 for w in low if _STRETCHED.search(w)) / n,
    ]


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, toxic, part) of at most about ``limit`` labelled rows, drawn by hash; part is 0 to 9. Rows that repeat count once."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 2)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    total = usable.count()
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    if total > limit:
        usable = usable.filter(draw < int((1 << 32) * limit / total))
    part = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 9, 8), 16, 10).cast("long") % 10
    few = F.broadcast(usable.withColumn("part", part))  # ``limit`` rows
    return docs.select("doc_id", "text").join(few, "doc_id").distinct().select("text", "toxic", "part")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic texts, other texts) of each batch; beginnings of words are marked by a space."""
    for b in small(batches):
        each = (Counter(), Counter())
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = {w.lower().translate(LEET) for w in tokens(text or "")}
            each[toxic].update(words)
            each[toxic].update({" " + w[:STEM] for w in words if len(w) >= STEM})
        names = list(each[0].keys() | each[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([each[1][x] for x in names], pa.int64()), pa.array([each[0][x] for x in names], pa.int64())], ["token", "bad", "good"])


def learn_lexicon(rows: DataFrame, limit: int = LEXICON) -> Lexicon:
    """At most ``limit`` tokens by log odds, of those that enough toxic texts have."""
    total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = total["bad"], total["n"] - total["bad"]
    if not bad or not good:
        return Lexicon({}, {})
    counts = rows.select("text", "toxic").mapInArrow(_counts, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    best = counts.filter(F.col("bad") >= max(4, bad // 300)).withColumn("odds", odds).filter("odds > 1.5")
    found = best.orderBy(F.col("odds").desc(), F.col("bad").desc(), "token").limit(limit).collect()  # at most ``limit`` rows
    return Lexicon({r["token"]: r["odds"] for r in found if r["token"][:1] != " "}, {r["token"][1:]: r["odds"] for r in found if r["token"][:1] == " "})


def _featured(df: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in small(batches):
            rows = np.array([features(x or "", lexicon) for x in b.column("text").to_pylist()], np.float64).reshape(-1, len(NAMES))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(NAMES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), x], [*keep, "x"])

    return df.select("text", *[c for c in keep if c != "text"]).mapInArrow(run, f"{kept}, x array<double>").withColumn("features", array_to_vector("x")).drop("x")


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def scored(self, df: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
        """The columns ``keep`` of ``df``, and the score under ``name``."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.share).alias(name))
        own = ["text" if c == "text" else f"own_{i}" for i, c in enumerate(keep)]  # no name of df's can clash with one of the models'
        named = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True) if c != "text"], F.col("text"))
        raw = _raw(self.trees, _featured(named, self.lexicon, *own))
        if self.calibration is not None:
            raw = self.calibration.transform(raw).drop("raw").withColumnRenamed("score", "raw")
        back = [F.col(o).alias(c) for c, o in zip(keep, own, strict=True)]
        return raw.select(*back, F.least(F.greatest("raw", F.lit(0.0)), F.lit(1.0)).alias(name))


def _raw(trees: GBTClassificationModel, featured: DataFrame) -> DataFrame:
    return trees.transform(featured).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    rows = staged(sample(docs, labels, limit), "labelled")
    lexicon = learn_lexicon(rows.filter("part < 4"))
    each = {(r["late"], r["toxic"]): r["count"] for r in rows.groupBy((F.col("part") >= 8).alias("late"), "toxic").count().collect()}
    n = sum(each.values())
    share = sum(v for (_, toxic), v in each.items() if toxic == 1) / n if n else 0.0
    if rows.filter("part >= 4 AND part < 8").select("toxic").distinct().count() < 2:
        return Model(lexicon, None, None, share)
    made = staged(_featured(rows.filter("part >= 4"), lexicon, "toxic", "part").select("toxic", "part", vector_to_array("features").alias("x")).coalesce(2), "features").withColumn("features", array_to_vector("x"))
    boost = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=64)
    trees = boost.fit(made.filter("part < 8").select("features", F.col("toxic").cast("double").alias("toxic")))
    calibration = None
    if {k for late, k in each if late} >= {0, 1}:
        later = _raw(trees, made.filter("part >= 8"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(later.select("raw", F.col("toxic").cast("double").alias("label")))
    return Model(lexicon, trees, calibration, share)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    found = fit(docs, labels).scored(docs.select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
