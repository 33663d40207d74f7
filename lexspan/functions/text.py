"""Text expressions. All run in the JVM; white space and words are Unicode's, as ``(?U)`` says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's white space without newline and space; named one by one, since ``(?U)\\s`` is several times slower.
_BLANK = r"\t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space but newlines become a space, three or more newlines two, then lines and ends are trimmed."""
    c = F.regexp_replace(c, rf"[{_BLANK}][ {_BLANK}]*| [ {_BLANK}]+", " ")  # a single space is one already
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.btrim(F.regexp_replace(c, r" \n ?|\n ", "\n"), F.lit(" \n"))


def sentences(c: Column) -> Column:
    """Parts between an end mark and a capital, white space between them dropped; blank ones left out."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.btrim(s, F.lit(" \n\t\r")) != "")


def words(c: Column) -> Column:
    """Lower-case ASCII words of two letters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 2)


def content_words(c: Column, stop: list[str]) -> Column:
    return F.array_except(F.array_distinct(words(c)), F.array(*[F.lit(s) for s in stop]))


def n_grams(tokens: Column, low: int, high: int) -> Column:
    """All runs of low to high tokens, joined by spaces, shorter first."""
    n = F.size(tokens)
    runs = lambda k: F.transform(F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
    return F.flatten(F.array(*[runs(k) for k in range(low, high + 1)]))


def strip_namespace(c: Column, prefixes: list[str]) -> Column:
    return F.regexp_replace(c, "^(" + "|".join(prefixes) + "):", "")


def split_camel(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"))


def iri_hash(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def bookends(c: Column, head: int = 1000, tail: int = 500) -> Column:
    """A text's two ends; all of it if they would meet."""
    return F.when(F.length(c) > head + tail, F.concat(F.left(c, F.lit(head)), F.lit("\n...\n"), F.right(c, F.lit(tail)))).otherwise(c)


def lookback(text: Column, start: Column, size: int = 50) -> Column:
    """The characters before a span, in lower case."""
    return F.lower(F.substring(text, F.greatest(F.lit(1), start - size + 1), F.least(F.lit(size), start)))


def escape_markup(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unfenced(c: Column) -> Column:
    """What stands in a Markdown code fence; without one, the text."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    return F.btrim(F.when(inner != "", inner).otherwise(c))


def dehyphenate(c: Column) -> Column:
    """Text of pages: words cut at line ends joined, then lines that go on in lower case unless a sentence ended, then lines of a bare number between others dropped."""
    c = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    c = F.regexp_replace(c, r"(?<![.!?:;\n])\n(?=[a-z])", " ")
    return F.regexp_replace(c, r"(?U)\n\s*[0-9]+\s*\n", "\n")


def relation_name(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("_")))
