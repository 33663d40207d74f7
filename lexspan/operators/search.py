"""Concept search: query terms, candidates by blocking keys, relevance, ancestors, and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.functions import scoring, text
from lexspan.functions.constants import EXPANSIONS, SEARCH_STOP

STOP = SEARCH_STOP
THRESHOLD, ANCESTOR_LEAST, DECAY, LEVELS = 30.0, 50.0, 0.85, 3


def terms(query: Column) -> Column:
    """The phrase, its shorter runs of words, its content words of three letters or more, longest first, and its expansions."""
    words = F.split(F.lower(F.btrim(query)), r"\s+")
    runs = F.array_sort(text.n_grams(words, 2, 4), lambda a, b: F.length(b) - F.length(a))
    content = text.content_words(query, STOP)
    single = F.array_sort(F.filter(content, lambda w: F.length(w) >= 3), lambda a, b: F.length(b) - F.length(a))
    return F.array_distinct(F.concat(F.array(F.lower(F.btrim(query))), runs, single, expansions(content)))


def expansions(words: Column) -> Column:
    """Phrases of a word and what it also stands for."""
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*[F.lit(f"{k} {w}") for w in v]))])
    return F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))


def query_words(query: Column) -> Column:
    """Content words; of a query that has none, all its words."""
    content = text.content_words(query, STOP)
    return F.when(F.size(content) > 0, content).otherwise(F.array_distinct(text.words(query)))


def _keys(words: Column) -> Column:
    """Blocking keys: words and, of words of three letters or more, their beginnings. Words that match at all have one in common."""
    return F.array_distinct(F.concat(words, F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.concat(F.left(w, F.lit(3)), F.lit("*")))))


def _grams(c: Column, sizes: tuple[int, ...] = (4, 8)) -> Column:
    """All distinct runs of so many characters."""
    runs = lambda k: F.transform(F.when(F.length(c) >= k, F.sequence(F.lit(1), F.length(c) - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(k)))
    return F.array_distinct(F.flatten(F.array(*[runs(k) for k in sizes])))


def _lead(c: Column) -> Column:
    """The longest beginning that ``_grams`` of any text around it has, of a text of four characters or more."""
    return F.left(c, F.when(F.length(c) >= 8, 8).otherwise(4))


def _described(concepts: DataFrame) -> DataFrame:
    """Distinct (label, definition, preferred_label, alt_labels) with their words; the last two may be missing from ``concepts``."""
    c = concepts.withColumn("definition", F.coalesce("definition", F.lit("")))
    for name, kind in (("preferred_label", "string"), ("alt_labels", "array<string>")):
        c = c if name in concepts.columns else c.withColumn(name, F.lit(None).cast(kind))
    empty = F.array().cast("array<string>")
    c = c.withColumn("preferred_label", F.coalesce("preferred_label", F.lit(""))).withColumn("alt_labels", F.filter(F.coalesce("alt_labels", empty), lambda x: x.isNotNull()))
    content = lambda x: text.content_words(x, STOP)
    return c.withColumn("l_words", content(F.col("label"))).withColumn("d_words", content(F.col("definition"))).withColumn("p_words", content(F.col("preferred_label"))).withColumn("s_words", F.transform("alt_labels", content))


_TEXTS = ["label", "definition", "preferred_label", "alt_labels"]


def _variants(queries: DataFrame) -> DataFrame:
    """(query, phrase, words): each distinct query as it is, and its expansions."""
    q = queries.select("query").filter("query IS NOT NULL").distinct()
    phrases = F.array_distinct(F.concat(F.array(F.lower(F.btrim("query"))), expansions(text.content_words(F.col("query"), STOP))))
    return q.select("query", F.explode(phrases).alias("phrase")).filter("phrase <> ''").withColumn("words", query_words(F.col("phrase")))


def candidates(queries: DataFrame, concepts: DataFrame, top: int | None = None) -> DataFrame:
    """Pairs of a query or an expansion of it and a concept, all that the relevance can be above 0 of.

    They are equal, or share a word or a beginning of three letters in label, preferred label, alternative labels or
    definition, or one contains the other: the beginning of the shorter is then a gram of the longer. Texts that contain each other count from
    four characters on, but a definition counts for any query. A query of up to three characters scores the same by every definition that
    has it, so with ``top`` only the first so many of these, by iri, are candidates: no others can be among a query's ``top`` best.
    """
    q, c = _variants(queries), _described(concepts)
    whole = lambda df, name: df.filter(F.length(name) >= scoring.CONTAINED_LEAST)
    by_words = q.select("query", "phrase", F.explode(_keys(F.col("words"))).alias("key")).join(c.select("iri", F.explode(_keys(F.array_distinct(F.concat("l_words", "d_words", "p_words", F.flatten("s_words"))))).alias("key")), "key")
    names = whole(c.select("iri", F.explode(F.array(F.lower("label"), F.lower("preferred_label"), F.lower("definition"))).alias("name")), "name")
    within = whole(q, "phrase").select("query", "phrase", _lead(F.col("phrase")).alias("key")).join(names.select("iri", "name", F.explode(_grams(F.col("name"))).alias("key")), "key").filter(F.contains("name", "phrase"))
    labels = whole(c.select("iri", F.lower("label").alias("name")), "name")
    around = whole(q, "phrase").select("query", "phrase", F.explode(_grams(F.col("phrase"))).alias("key")).join(labels.withColumn("key", _lead(F.col("name"))), "key").filter(F.contains("phrase", "name"))
    same = c.select("iri", F.explode(F.array_distinct(F.array(F.lower("label"), F.lower("preferred_label")))).alias("phrase")).join(q.select("query", "phrase"), "phrase")
    # the grams of definitions that some short query asks for, and of each the first by iri
    short = q.filter(F.length("phrase") < scoring.CONTAINED_LEAST).select("query", "phrase")
    held = c.select("iri", F.explode(_grams(F.lower("definition"), (1, 2, 3))).alias("phrase")).join(short.select("phrase").distinct(), "phrase", "left_semi")
    if top is not None:
        held = held.withColumn("place", F.row_number().over(W.partitionBy("phrase").orderBy("iri"))).filter(F.col("place") <= top)
    brief = held.join(short, "phrase")
    pairs = by_words.select("query", "phrase", "iri")
    for more in (within, around, same, brief):
        pairs = pairs.union(more.select("query", "phrase", "iri"))
    return pairs.distinct().join(q, ["query", "phrase"]).join(c, "iri")


def search(queries: DataFrame, concepts: DataFrame, top: int = 10, threshold: float = THRESHOLD) -> DataFrame:
    """(query, iri, label, score, rank) of the best concepts for each query.

    Concepts are rows (iri, label, definition), with alternative labels as ``alt_labels`` array<string> and a
    ``preferred_label`` where there are any. Concepts that share all of these are scored once.
    """
    described = _described(concepts)
    texts = described.groupBy(*_TEXTS).agg(F.min("iri").alias("iri"))
    met = candidates(queries, texts, top)
    words = F.col("words")
    by_synonym = F.coalesce(F.array_max(F.transform("s_words", lambda s: scoring.word_overlap(words, s))), F.lit(0.0))
    overlaps = {"by_label": "l_words", "by_definition": "d_words", "by_preferred": "p_words"}
    every = met.withColumns({k: scoring.word_overlap(words, F.col(v)) for k, v in overlaps.items()} | {"by_synonym": by_synonym})
    score = scoring.relevance(F.col("phrase"), F.col("label"), F.col("definition"), F.col("by_label"), F.col("by_definition"), F.col("preferred_label"), F.col("by_preferred"), F.col("by_synonym"))
    # a query's score is the best of its own and its expansions'
    scored = every.withColumn("score", score).groupBy("query", "iri", *_TEXTS).agg(F.max("score").alias("score")).filter((F.col("score") >= threshold) & F.col("label").isNotNull())
    w = W.partitionBy("query").orderBy(F.col("score").desc(), "iri")
    # the best concepts are of the best texts, each by its first iri, and of a text they are among its first iris
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("iri", "rank")
    first = described.select("iri", *_TEXTS).withColumn("place", F.row_number().over(W.partitionBy(*_TEXTS).orderBy("iri"))).filter(F.col("place") <= top)
    found = best.join(first, _TEXTS)
    return found.select("query", "iri", "label", "score", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= top)


def with_ancestors(scored: DataFrame, closure: DataFrame) -> DataFrame:
    """Scored rows (query, iri, score) and, below those of 50 or more, ancestors up to three levels that aren't among them, decayed."""
    up = closure.filter(F.col("depth") <= LEVELS)
    more = scored.filter(F.col("score") >= ANCESTOR_LEAST).join(up, "iri").select("query", F.col("ancestor").alias("iri"), (F.col("score") * F.pow(F.lit(DECAY), F.col("depth"))).alias("score"))
    more = more.join(scored.select("query", "iri"), ["query", "iri"], "left_anti").groupBy("query", "iri").agg(F.max("score").alias("score"))
    return scored.select("query", "iri", "score").unionByName(more)


def hinted(found: DataFrame, hints: DataFrame) -> DataFrame:
    """Search results (query, iri, ..., branch, score, rank) ranked anew: those whose branch holds the query's hint (query, hint) first, then by score."""
    met = found.join(hints.dropDuplicates(["query"]), "query", "left")
    fits = F.coalesce(F.contains(F.lower("branch"), F.lower("hint")) & (F.col("hint") != ""), F.lit(False))
    w = W.partitionBy("query").orderBy(F.when(fits, 0).otherwise(1), F.col("score").desc(), "iri")
    return met.withColumn("rank", F.row_number().over(w)).drop("hint")


def resolve(mentions: DataFrame, concepts: DataFrame, top: int = 5, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Mentions (text, iri, confidence, and perhaps a ``hint`` of a branch) with a concept: by iri, else the best of a search of their distinct texts.

    ``asked_iri`` (empty for none) and ``asked_confidence`` are the mention's own. Found ones blend confidence and score 60 to 40; a hint puts concepts of its branch first among the ``top``. ``backups`` are the other
    candidates, best first. A concept of an excluded branch (``concepts`` may have a ``branch``) is no answer. Without a concept all are null.
    """
    c = concepts if "branch" in concepts.columns else concepts.withColumn("branch", F.lit(None).cast("string"))
    m = mentions if "hint" in mentions.columns else mentions.withColumn("hint", F.lit(None).cast("string"))
    known = c.select("iri", F.col("label").alias("known"), F.col("branch").alias("known_branch"))
    exact = m.withColumn("asked_iri", F.coalesce("iri", F.lit(""))).withColumn("asked_confidence", F.col("confidence")).join(known, "iri", "left")
    asked = exact.filter("known IS NULL").select(F.concat_ws("\x00", "text", "hint").alias("key"), "text", "hint").distinct()
    found = search(asked.select(F.col("text").alias("query")).distinct(), c, top).join(c.select("iri", "branch"), "iri")
    each = asked.join(found, asked["text"] == found["query"]).select(F.col("key").alias("query"), "hint", "iri", "label", "score", "branch")
    ranked = hinted(each.drop("hint"), each.select("query", "hint"))
    listed = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "iri", "label", "score", "branch"))).alias("all"))
    met = exact.withColumn("query", F.concat_ws("\x00", "text", "hint")).join(listed, "query", "left").drop("query")
    best, rest = F.get("all", F.lit(0)), F.transform(F.slice("all", 2, 5), lambda x: F.struct(x["iri"].alias("iri"), x["label"].alias("label"), x["score"].alias("score")))
    direct = F.col("known").isNotNull()
    out = met.select(
        "text", "asked_iri", "asked_confidence", F.when(direct, F.col("iri")).otherwise(best["iri"]).alias("iri"), F.coalesce("known", best["label"]).alias("label"), F.when(direct, F.col("known_branch")).otherwise(best["branch"]).alias("branch"),
        F.when(direct, F.col("confidence")).when(best.isNotNull(), scoring.blend(F.col("confidence"), best["score"] / 100, 0.6)).alias("confidence"), F.when(~direct, rest).alias("backups"),
    )
    gone = F.coalesce(F.col("branch").isin(*excluded), F.lit(False)) if excluded else F.lit(False)
    return out.select("text", "asked_iri", "asked_confidence", *[F.when(~gone, F.col(x)).alias(x) for x in ("iri", "label", "branch", "confidence", "backups")])
