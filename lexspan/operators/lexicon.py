"""Lexicons: label indexes, pattern admission, matches in text, and their first confidence."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.functions.constants import ALTERNATIVE_STOP, PATTERN_STOP
from lexspan.operators import hashed, overlap
from lexspan.operators.folds import folded
from lexspan.operators.intervals import best_in
from lexspan.staging import staged

#: Precedence of label types, and confidence by (type, several words).
PRECEDENCE = {"preferred": 0, "alternative": 1, "hidden": 2, "translation": 3}
CONFIDENCE = {("preferred", True): 0.90, ("preferred", False): 0.72, ("alternative", True): 0.65, ("alternative", False): 0.35, ("translation", True): 0.60, ("translation", False): 0.30}
DEFAULT_CONFIDENCE = 0.50

#: Characters of labels that an automaton holds at most, automata that a worker keeps, and texts whose matches leave together.
PART_CHARS, KEPT_PARTS, TEXTS = 4_000_000, 4, 200
#: A table of labels of up to so many bytes, counted as JSON, goes to every task; a larger one is joined as Spark chooses, but for those whose keys
#: have most concepts, up to so many labels.
BROADCAST_BYTES, BROADCAST_LABELS = 32 << 20, 200_000
#: Keys whose codes go to every task, sixteen bytes each, so that what is found is known there to be a label.
KNOWN_KEYS = 16_000_000
#: Tokens are runs of word characters and single signs.
TOKEN = re.compile(r"\w+|[^\w\s]")


def precedence(label_type: Column) -> Column:
    return F.coalesce(*[F.when(label_type == k, v) for k, v in PRECEDENCE.items()], F.lit(len(PRECEDENCE)))


def admitted(labels: DataFrame, stop: list[str] = PATTERN_STOP, least: int = 3) -> DataFrame:
    """Labels of at least ``least`` characters that are no stop word; alternative ones must be longer, and no common word."""
    low = F.lower("label")
    safe = (F.length("label") > 3) & (F.contains("label", F.lit(" ")) | ~low.isin(ALTERNATIVE_STOP))
    return labels.filter((F.length("label") >= least) & ~low.isin(stop) & ((F.col("label_type") != "alternative") | safe))


def single_index(labels: DataFrame) -> DataFrame:
    """Per lower-case label the concept of the strongest label type; the last of equal ones."""
    w = W.partitionBy("label_key").orderBy(precedence(F.col("label_type")), F.col("iri").desc())
    keyed = labels.withColumn("label_key", F.lower("label"))
    return keyed.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def multi_index(labels: DataFrame) -> DataFrame:
    """Per lower-case label all its concepts, each once by its strongest type."""
    w = W.partitionBy("label_key", "iri").orderBy(precedence(F.col("label_type")), "label")
    keyed = labels.withColumn("label_key", F.lower("label"))
    return keyed.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


class Matcher:
    """Labels in one automaton, each with its code; made once for each Python worker and part of a lexicon."""

    _made: dict[str, Matcher] = {}

    def __init__(self, keys: list[str], codes: list[int] | None = None) -> None:
        import ahocorasick

        self.keys, self.codes = keys, codes or list(range(len(keys)))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, k in enumerate(keys):
            self.automaton.add_word(k, i)
        if keys:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, name: str, keys: Broadcast) -> Matcher:
        if name not in cls._made:
            if len(cls._made) >= KEPT_PARTS:
                cls._made.clear()
            cls._made[name] = cls(*keys.value)
        return cls._made[name]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, label) of each occurrence, ignoring case, that no letter, digit or underscore touches."""
        low, at = _lowered(text)
        keys, out, n = self.keys, [], len(low)
        for last, i in self.automaton.iter(low) if keys else ():
            start, end = last + 1 - len(keys[i]), last + 1
            if end < n and ((c := low[end]).isalnum() or c == "_"):
                continue
            if start and ((c := low[start - 1]).isalnum() or c == "_"):
                continue
            out.append((start, end, i) if at is None else (at[start], at[end - 1] + 1, i))
        return out


def _lowered(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case, and the place in it of each character, where that isn't its own."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    # some capitals have two small letters: places are those of the text
    return "".join(c.lower() for c in text), [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]


def _tokens(text: str) -> int:
    return len(TOKEN.findall(text))


class Lexicon(NamedTuple):
    """``labels`` for passes over texts: in one automaton, each key with its code, or, where there are too many, in a filter of hashes; ``small`` if they are few enough to go to every task.

    ``codes`` tells the keys from what else the filter lets pass, if they are no more than KNOWN_KEYS. Keys of ``crowded`` concepts or more are
    few enough to go to every task.
    """

    labels: DataFrame
    automaton: Broadcast | None
    hashes: Broadcast | None
    longest: int
    small: bool
    codes: Broadcast | None = None
    crowded: int | None = None

    @property
    def key(self) -> str:
        """The column by which finds and labels meet."""
        return "code" if self.automaton or self.codes else "label_key"

    def joined(self, found: DataFrame) -> DataFrame:
        """Finds (code, ...) or (label_key, ...) with the columns of their labels, without those that are no labels.

        A key of many concepts that is found often gives most rows: such keys aren't gathered, they meet finds where those are.
        """
        columns = [c for c in found.columns if c != self.key] + [c for c in self.labels.columns if c not in ("code", "of_key")]
        if self.small or self.crowded is None:
            return found.join(F.broadcast(self.labels) if self.small else self.labels, self.key).select(*columns)
        found, many = staged(found, "found"), F.col("of_key") >= self.crowded
        return found.join(F.broadcast(self.labels.filter(many)), self.key).select(*columns).unionByName(found.join(self.labels.filter(~many), self.key).select(*columns))


def prepared(labels: DataFrame, part_chars: int = PART_CHARS) -> Lexicon:
    """Labels (label_key in lower case, ...) for a pass over texts; blank keys are left out.

    Up to ``part_chars`` characters of keys make one automaton. A key's code is a hash of it, so finds leave as numbers; that no two keys share one
    is counted, and another seed taken if they do. More keys go into a filter of bounded size, made in tasks, so that
    a text is read once, however large the lexicon is; up to KNOWN_KEYS of them have codes as well, unless two share one.
    """
    labels = staged(labels.filter(F.regexp_like("label_key", F.lit(r"(?U)\S"))), "labels")
    size = F.length(F.to_json(F.struct("*")))
    by_key = labels.groupBy("label_key").agg(F.sum(size.cast("long")).alias("size"), F.count(F.lit(1)).alias("of_key"))
    spark, seed = labels.sparkSession, -1
    while True:
        seed += 1
        code = F.xxhash64("label_key", F.lit(seed))
        keys = by_key.withColumn("code", code)
        length = F.length("label_key").cast("long")
        n, codes, chars, longest, size_of_all = keys.agg(F.count(F.lit(1)), F.countDistinct("code"), F.sum(length), F.max(length), F.sum("size")).first()
        if n == codes or chars > part_chars:
            break
    small = (size_of_all or 0) <= BROADCAST_BYTES
    if (chars or 0) > part_chars:
        if n <= KNOWN_KEYS and (coded := _coded(labels, by_key, chars, longest, small)):
            return coded
        return Lexicon(labels, None, spark.sparkContext.broadcast(hashed.table(labels, chars)), longest, small)
    all_keys = keys.select("label_key", "code").toArrow()
    return Lexicon(labels.withColumn("code", code), spark.sparkContext.broadcast((all_keys.column("label_key").to_pylist(), all_keys.column("code").to_pylist())), None, longest or 0, small)


def _coded(labels: DataFrame, by_key: DataFrame, chars: int, longest: int, small: bool) -> Lexicon | None:
    """Labels in a filter of hashes, with the codes of their keys and how many concepts a key has; none if two keys share a code."""
    sent = labels.sparkSession.sparkContext.broadcast
    one, beside = hashed.code("label_key")
    own = staged(by_key.select("label_key", "of_key", one.alias("code"), beside.alias("beside")), "keys")
    known = own.select("code", "beside").toArrow()
    codes = hashed.Known(*(known.column(c).to_numpy() for c in ("code", "beside")))
    if not codes.distinct():
        return None
    whole = staged(labels.join(own.select("label_key", "of_key", "code"), "label_key"), "labels")
    rows, crowded = 0, None
    for r in whole.groupBy("of_key").count().orderBy(F.desc("of_key")).toLocalIterator():
        rows += r["count"]
        if rows > BROADCAST_LABELS or r["of_key"] < 2:
            break
        crowded = r["of_key"]
    return Lexicon(whole, None, sent(hashed.table(own, chars)), longest, small, sent(codes), crowded)


def _passed(docs: DataFrame, known: Lexicon, rows: Callable[[str, list[tuple]], list[tuple]], schema: str, count_rows: bool = False) -> DataFrame:
    """(doc_id, what ``rows`` says of each text and its spans (start, end, code or label_key)), in one pass; ``count_rows`` adds a number of the row that a text is in."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"doc_id long, {schema}" + ", row long" * count_rows
    target = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    automaton, hashes, codes, longest, name = known.automaton, known.hashes, known.codes, known.longest, uuid.uuid4().hex

    def spans_of(texts: list[str]) -> Iterator[list[tuple]]:
        if automaton:
            matcher = Matcher.of(name, automaton)
            for text in texts:
                yield [(s, e, matcher.codes[k]) for s, e, k in matcher.spans(text)]
        else:
            lowered = [_lowered(x) for x in texts]
            for (low, at), found in zip(lowered, hashed.spans([low for low, _ in lowered], hashes, longest), strict=True):
                keys: list = [low[s:e] for s, e in found]
                if codes:
                    keys = codes.value.of(keys)
                yield [(s, e, k) if at is None else (at[s], at[e - 1] + 1, k) for (s, e), k in zip(found, keys, strict=True) if k is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                some, out = b.slice(i, TEXTS), []
                texts = [x or "" for x in some.column("text").to_pylist()]
                for doc_id, text, spans in zip(some.column("doc_id").to_pylist(), texts, spans_of(texts), strict=True):
                    row += 1
                    out += [(doc_id, *r, row) if count_rows else (doc_id, *r) for r in rows(text, spans)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def match(docs: DataFrame, labels: DataFrame, resolve: bool = False, longest: bool = False, surface: bool = True, part_chars: int = PART_CHARS, sentences: Callable[[str], list[tuple[int, int]]] | None = None) -> DataFrame:
    """Every occurrence of every label of ``labels`` (label_key in lower case, ...) between word borders: (doc_id, start, end, surface, label columns).

    Texts pass once through an automaton in Arrow batches, whatever the labels' words and signs; occurrences leave as numbers, and with their
    ``surface`` only where that is asked for. A lexicon of more than ``part_chars`` characters is looked up by hashes, and what they find joined with
    it. With ``resolve`` overlaps are resolved as in ``overlap.resolve``, with ``longest`` as in ``overlap.longest``: in the same pass where keys
    have codes, else when a join has left labels alone. ``sentences``, which gives a text's sentences in order, adds (sentence_start, sentence_end) of
    the one that ``intervals.best_container`` would choose, in the same pass.
    """
    known = prepared(labels, part_chars)
    here = known.key == "code"

    def taken(spans: list[tuple]) -> list[int]:
        if resolve:
            return overlap.kept([(r[0], r[1], 0.0) for r in spans])
        return overlap.longest_first([(r[0], r[1], r[2]) for r in spans])

    def rows(text: str, spans: list[tuple]) -> list[tuple]:
        out = [(s, e, _tokens(text[s:e]) if longest else 0, k) for s, e, k in spans]
        if here and (resolve or longest):
            out = [out[j] for j in taken(out)]
        if surface:
            out = [(*r, text[r[0] : r[1]]) for r in out]
        if sentences and out:
            borders = sentences(text)
            out = [(*r, *best_in(r[0], r[1], borders)) for r in out]
        return out

    more = ", surface string" * surface + ", sentence_start int, sentence_end int" * bool(sentences)
    found = _passed(docs, known, rows, f"start int, end int, tokens int, {known.key} {'long' if here else 'string'}{more}", not here)
    if not here and (resolve or longest):
        found = found.join(known.labels.select("label_key").distinct(), "label_key", "left_semi")

        def fold(group: list[dict]) -> list[dict]:
            group.sort(key=lambda r: (r["start"], r["end"]))
            return [group[j] for j in taken([(r["start"], r["end"], r["tokens"]) for r in group])]

        found = folded(found, ["doc_id", "row"], fold, found.schema)
    return known.joined(found.drop("tokens", "row"))


def counts(docs: DataFrame, labels: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, n, first_start, label columns): how often each text has each of its labels, counted where they are found; rows that share an id are counted apart."""
    known = prepared(labels, part_chars)

    def rows(_: str, spans: list[tuple]) -> list[tuple]:
        by: dict[int | str, list[int]] = {}
        for start, _, k in spans:
            if k in by:
                by[k][0] += 1
                by[k][1] = min(by[k][1], start)
            else:
                by[k] = [1, start]
        return [(n, first, k) for k, (n, first) in by.items()]

    return known.joined(_passed(docs, known, rows, f"n long, first_start int, {known.key} {'long' if known.key == 'code' else 'string'}"))


def match_own(docs: DataFrame, names: DataFrame, resolve: bool = True) -> DataFrame:
    """Occurrences of each document's own names (doc_id, label_key in lower case, ...), and of no other's: (doc_id, start, end, surface, columns of names).

    A document's names go to its task with its text, as one array, and a small automaton is made and used there; of equal keys the first
    by its other columns counts. What leaves is what is kept, resolved if asked. Nothing passes through the driver, and each text is scanned for its own names
    alone, however many documents there are. Blank names find nothing.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in names.columns if c != "doc_id"]
    own = names.filter(F.regexp_like("label_key", F.lit(r"(?U)\S"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("own"))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surface", T.StringType())]
    schema = T.StructType(fields + [names.schema[c] for c in rest])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, mine in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "own")), strict=True):
                by = {}
                for x in mine:
                    by.setdefault(x["label_key"], x)
                said = list(by.values())
                found = Matcher(list(by)).spans(text or "")
                if resolve:
                    found = [found[j] for j in overlap.kept([(s, e, 0.0) for s, e, _ in found])]
                out += [(doc_id, s, e, text[s:e], *(said[k][c] for c in rest)) for s, e, k in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return docs.select("doc_id", "text").join(own, "doc_id").mapInArrow(run, schema)


#: A word: a run of ASCII letters in lower case, digits, underscores and other characters than ASCII.
WORD = r"[a-z0-9_\x{80}-\x{10FFFF}]+"


def match_native(docs: DataFrame, labels: DataFrame, most_words: int | None = None) -> DataFrame:
    """Runs of words that equal a label, whatever stands between the words: (doc_id, word, label_key, n_words, label columns).

    Words are as ``WORD`` says; labels are words with single spaces. Runs are as long as the longest label, or as ``most_words`` says. Keys
    of up to PART_CHARS characters go to every task, where a text's words are looked up as they come, so that only what is found
    leaves; with more keys all runs are joined with them, in the JVM.
    """
    longest, chars = labels.agg(F.max(F.size(F.split("label_key", " "))), F.sum(F.length("label_key").cast("long"))).first()
    most_words = longest or 1 if most_words is None else most_words
    found = _known_runs(docs, labels, most_words) if (chars or 0) <= PART_CHARS else _all_runs(docs, most_words)
    return found.join(labels, "label_key").select("label_key", "doc_id", "word", "n_words", *[c for c in labels.columns if c != "label_key"])


def _all_runs(docs: DataFrame, most_words: int) -> DataFrame:
    """(doc_id, word, label_key, n_words): every run of words."""
    found = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w"))
    every: DataFrame | None = None
    for k in range(1, most_words + 1):
        runs = found.withColumnRenamed("w", "runs") if k == 1 else NGram(n=k, inputCol="w", outputCol="runs").transform(found)
        each = runs.select("doc_id", F.posexplode("runs").alias("word", "label_key"), F.lit(k).alias("n_words"))
        every = each if every is None else every.unionByName(each)
    return every


def _known_runs(docs: DataFrame, labels: DataFrame, most_words: int) -> DataFrame:
    """As ``_all_runs``, of those that are labels."""
    by_first: dict[str, list[tuple[list[str], str]]] = {}
    for r in labels.select("label_key").filter("label_key IS NOT NULL").distinct().toLocalIterator():
        parts = r["label_key"].split(" ")
        if len(parts) <= most_words:
            by_first.setdefault(parts[0], []).append((parts, r["label_key"]))
    sent, word = docs.sparkSession.sparkContext.broadcast(by_first), re.compile(WORD.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))
    kinds = [pa.int32(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = word.findall(text or "")
                for j, w in enumerate(words):
                    if w in known:
                        for parts, key in known[w]:
                            if words[j : j + len(parts)] == parts:
                                at.append(i)
                                found.append((j, key, len(parts)))
            if found:
                ids = b.column("doc_id").take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]], ["doc_id", "word", "label_key", "n_words"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word int, label_key string, n_words int")


def confidence(label_type: Column, label: Column) -> Column:
    several = F.size(F.split(F.btrim(label), r"\s+")) > 1
    found = F.lit(DEFAULT_CONFIDENCE)
    for (kind, many), value in CONFIDENCE.items():
        found = F.when((label_type == kind) & (several == F.lit(many)), value).otherwise(found)
    return found
