"""Score expressions: word overlap, relevance, blends, and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an exact match of one, two, or more words scores, and the other levels of relevance.
EXACT = (82.0, 92.0, 97.0)
CONTAINS, CONTAINED, OVERLAP = 85.0, 78.0, 88.0
#: The same of preferred labels: exact, contains, overlap; and of synonyms, overlap alone.
PREFERRED, SYNONYM = (90.0, 84.0, 86.0), 82.0
CONTAINED_LEAST = 4  # letters of a contained label or query


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def blend(a: Column, b: Column, share: float) -> Column:
    return F.bround(a * share + b * (1 - share), 4)


def boosted(c: Column, most: float = 0.05) -> Column:
    """Agreement of two sources: the more room there is to 1, the more it adds."""
    return F.least(F.lit(1.0), c + most * (1 - c))


def word_match(a: Column, b: Column) -> Column:
    """How well one word stands for another: equal 1, beginning 0.8, common stem 0.7, else 0."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (i <= short), i).otherwise(n))
    begins = (short >= 3) & (F.startswith(a, b) | F.startswith(b, a))
    stem = (short >= 5) & (shared >= 4) & (shared >= short * 0.7)
    return F.when(a == b, 1.0).when(begins, 0.8).when(stem & (long > 0), 0.7).otherwise(0.0)


def _one_way(a: Column, b: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.aggregate(b, F.lit(0.0), lambda m, y: F.greatest(m, word_match(x, y))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(total / F.greatest(F.size(a), F.lit(1)))


def word_overlap(query: Column, target: Column) -> Column:
    """Mean best match of the query's words in the target's, or the other way at three quarters if the target has two words or more."""
    back = F.when(F.size(target) >= 2, _one_way(target, query) * 0.75).otherwise(0.0)
    return F.greatest(_one_way(query, target), back)


def set_overlap(a: Column, b: Column) -> Column:
    """Shared elements over those of the larger set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def relevance(query: Column, label: Column, definition: Column, label_overlap: Column, definition_overlap: Column, preferred: Column | None = None, preferred_overlap: Column | None = None, synonym_overlap: Column | None = None) -> Column:
    """0 to 99: exact by word count, containment either way of four letters or more, overlap of words, the preferred label and synonyms a little less.

    A definition adds at most 8 to what the names score; where they score nothing, its own score stands.
    """
    q, t = F.lower(F.btrim(query)), F.lower(label)
    n = F.size(F.split(q, r"\s+"))
    exact = F.when(n >= 3, EXACT[2]).when(n == 2, EXACT[1]).otherwise(EXACT[0])
    by_name = [
        F.when(F.contains(t, q) & (F.length(q) >= CONTAINED_LEAST), CONTAINS).otherwise(0.0),
        F.when(F.contains(q, t) & (F.length(t) >= CONTAINED_LEAST) & (F.length(t) / F.length(q) > 0.3), CONTAINED).otherwise(0.0),
        label_overlap * OVERLAP,
    ]
    if preferred is not None:
        p = F.lower(preferred)
        by_name.append(F.when(q == p, PREFERRED[0]).when(F.contains(p, q) & (F.length(q) >= CONTAINED_LEAST), PREFERRED[1]).otherwise(preferred_overlap * PREFERRED[2]))
    if synonym_overlap is not None:
        by_name.append(synonym_overlap * SYNONYM)
    by_definition = F.when(F.contains(F.lower(definition), q), 60.0).otherwise(definition_overlap * 55.0)
    named = F.greatest(*by_name)
    best = F.when(named > 0, named + F.least(by_definition * 0.12, F.lit(8.0))).otherwise(by_definition)
    return F.when((q == "") | (t == ""), 0.0).when(q == t, exact).otherwise(F.round(F.least(best, F.lit(99.0)), 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalized(a: Column) -> Column:
    """To length 1; a vector of zeros stays."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def triple_confidence(matches: Column, passive: Column) -> Column:
    return clamp(0.5 + 0.1 * matches - F.when(passive, 0.05).otherwise(0.0), 0.3, 0.85)
