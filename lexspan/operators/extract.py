"""Entities that patterns and models find, with code point offsets, and individuals merged from them within a document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspan.operators.folds import folded

#: Words that patterns are made of.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ONES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["hundred", "thousand", "million", "billion", "trillion"]
UNITS = ["second", "minute", "hour", "day", "week", "month", "year", "decade"]
CIRCUITS = ["First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh", "Federal", "D.C.", "DC"]
COURTS = ["Superior", "District", "Circuit", "Appellate", "Family", "Probate", "Surrogate", "Surrogate's", "Municipal", "Juvenile", "Small Claims", "County"]
STREETS = ["Street", "St", "Avenue", "Ave", "Boulevard", "Blvd", "Road", "Rd", "Drive", "Dr", "Lane", "Ln", "Way", "Court", "Ct", "Place", "Pl", "Plaza", "Circle", "Cir", "Terrace", "Ter", "Pike", "Highway", "Hwy"]
MEANS = ["mean", "means", "shall mean", "is defined as", "refers to", "shall refer to", "has the meaning", "hereby defined as"]
CONDITIONS = ["if", "unless", "provided that", "subject to", "on condition that", "on the condition that", "in the event", "in the event that", "notwithstanding", "except that", "except where", "except when", "except as", "contingent upon"]
CONSTRAINTS = ["no more than", "no less than", "no fewer than", "at least", "at most", "not to exceed", "shall not exceed", "must not exceed", "will not exceed", "up to", "up to and including", "a maximum of", "a minimum of", "not more than", "not less than", "not fewer than", "no later than"]
STOP_ENTITIES = [
    "de novo", "de facto", "de jure", "de minimis", "ex parte", "ex rel", "habeas corpus", "in camera", "in forma pauperis", "in limine", "in personam", "in re", "in rem", "inter alia", "mens rea",
    "nolo contendere", "nunc pro tunc", "per curiam", "per se", "prima facie", "pro bono", "pro hac vice", "pro se", "pro tem", "pro tempore", "quantum meruit", "quasi", "res judicata",
    "stare decisis", "sua sponte", "sub judice", "sui generis", "voir dire", "appellant", "appellee", "petitioner", "respondent", "plaintiff", "defendant", "amicus curiae", "amici curiae",
]
ORGANIZATION_ENDS = ["LLP", "LLC", "L.L.P.", "L.L.C.", "Inc", "Corp", "Corporation", "Ltd", "Limited", "PC", "P.C.", "PA", "P.A.", "PLLC", "P.L.L.C.", "LP", "L.P.", "PLC", "GmbH", "AG", "SA", "S.A.", "Co.", "Associates", "Partners", "Group", "Holdings", "Foundation", "International", "Bancorp", "Bank", "Trust"]


def _any(words: list[str]) -> str:
    """One of these, the longest first, with any white space for their spaces."""
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True)) + ")"


class Extractor(NamedTuple):
    pattern: str
    confidence: float
    least: int = 1
    group: int = 0
    kind: str = ""  # what its finds are called
    folded: bool = False  # the pattern is in lower case, and looked for in the text's lower case
    gates: tuple[str, ...] = ()  # a text whose lower case has none of these has no find
    starts: tuple[str, ...] = ()  # a find begins with one of these, in any case; without any it may begin anywhere


_MONTH = ("(?:" + "|".join(f"{m}|{m[:3]}\\.?" for m in MONTHS) + "|Sept\\.?)").lower()
_AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]+)?"
_QUOTED = '["“]([a-z][\\w\\s]{1,60}?)["”]'
_NAME = r"[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)*"

#: Confidences are fixed values.
EXTRACTORS: dict[str, Extractor] = {
    "money": Extractor(rf"[$€£¥₹]\s*{_AMOUNT}(?:\s*(?:{_any(SCALES)}|[kmbt])\b(?:\s+dollars?\b)?)?|\b{_AMOUNT}\s*(?:dollars?|cents?|pounds?|euros?|usd|eur|gbp|jpy)\b|\b(?:{_any(ONES + TENS + SCALES)}[\s-]+)+(?:dollars?|cents?|pounds?|euros?)\b", 0.93, 2, kind="Monetary Amount", folded=True, gates=('$', '€', '£', '¥', '₹', 'dollar', 'cent', 'pound', 'euro', 'usd', 'eur', 'gbp', 'jpy')),
    "date": Extractor(rf"\b{_MONTH}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}\b|\b[0-9]{{1,2}}\s+{_MONTH}\s+[0-9]{{4}}\b|\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b|\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}\b|\bthe\s+[0-9]{{1,2}}(?:st|nd|rd|th)\s+day\s+of\s+{_MONTH}(?:,?\s+[0-9]{{4}}\b)?", 0.92, kind="Date", folded=True, gates=('/', '-', 'jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec')),
    "duration": Extractor(rf"(?:\b[0-9]+(?:\.[0-9]+)?|\b{_any(ONES + TENS)})(?:\s*\([0-9]+\))?[\s-]+(?:business\s+|calendar\s+)?{_any(UNITS)}s?\b", 0.90, kind="Duration", folded=True, gates=('second', 'minute', 'hour', 'day', 'week', 'month', 'year', 'decade')),
    "percent": Extractor(rf"\b[0-9]+(?:\.[0-9]+)?\s*%|\b(?:[0-9]+(?:\.[0-9]+)?|{_any([*ONES, *TENS, 'hundred'])})\s+per\s?cent\b|\b[0-9]+(?:\.[0-9]+)?\s+basis\s+points?\b", 0.93, kind="Percentage", folded=True, gates=('%', 'cent', 'basis')),
    "court": Extractor(
        rf"(?i:(?:United States|U\.S\.) (?:(?:District|Circuit|Bankruptcy|Tax) Court|Supreme Court|Court of Appeals))|(?i:Supreme Court of) (?:(?i:the United States)|{_NAME})|(?i:\b{_any(CIRCUITS)} Circuit\b)"
        rf"|(?i:\b[SNWCE]\.D\.\s*(?:[A-Z]\.)?[A-Z][a-z]*\.?)|(?i:Court of (?:Appeals?|Common Pleas|Claims|Chancery))(?: (?i:for|of) (?:(?i:the) )?{_NAME})?|(?i:\b{_any(COURTS)} Court\b)(?: (?i:of|for) (?:(?i:the) )?{_NAME})?",
        0.91, kind="Court", gates=('court', 'circuit', '.d.'),
        starts=("united", "u.s.", "supreme", *CIRCUITS, *[f"{c}.d." for c in "snwce"], "court", *COURTS),
    ),
    "definition": Extractor(rf"{_QUOTED}\s+{_any(MEANS)}\b", 0.88, 1, 1, kind="Definition", folded=True, gates=('"', '“')),
    "condition": Extractor(rf"\b{_any(CONDITIONS)}\b", 0.85, kind="Condition", folded=True, gates=('if', 'unless', 'provided', 'subject', 'condition', 'event', 'notwithstanding', 'except', 'contingent')),
    "constraint": Extractor(rf"\b{_any(CONSTRAINTS)}\b", 0.85, kind="Constraint", folded=True, gates=('than', 'least', 'most', 'exceed', 'up', 'maximum', 'minimum')),
    "address": Extractor(rf"\b[0-9]{{1,5}}\s+{_NAME}\s+{_any(STREETS)}\b\.?(?:,?\s+(?:Suite|Ste|Apt|Unit|Floor|Fl|Room|Rm)\.?\s*[0-9A-Z]+\b)?(?:,?\s+{_NAME})?(?:,?\s+[A-Z]{{2}}\b)?(?:\s+[0-9]{{5}}(?:-[0-9]{{4}})?\b)?", 0.87, 10, kind="Address", gates=('st', 'ave', 'blvd', 'boulevard', 'road', 'rd', 'drive', 'dr', 'lane', 'ln', 'way', 'court', 'ct', 'pl', 'cir', 'ter', 'pike', 'highway', 'hwy')),
    "trademark": Extractor(r"[A-Z]\w*(?: [A-Z]\w*)* ?[®™]", 0.93, kind="Trademark", gates=('®', '™')),
    "copyright": Extractor(rf"(?i:©|\(c\)|Copyright(?:\s*(?:©|\(c\)))?)\s*[0-9]{{4}}(?:\s*[-–]\s*[0-9]{{4}})?(?:\s+{_NAME}(?:,? (?:Inc|LLC|Ltd|Corp)\.?)?)?", 0.93, kind="Copyright", gates=('©', '(c)', 'copyright')),
    "email": Extractor(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0.90, kind="Email", gates=('@',)),
    "citation": Extractor(r"\b[0-9]+ (?:U\.S\.|F\.(?:2d|3d|4th)|S\. ?Ct\.|F\. ?Supp\.(?: [23]d)?) [0-9]+\b|\b[0-9]+ (?:U\.S\.C\.|USC|C\.F\.R\.|CFR)\s*(?:§+ ?)?[0-9]+(?:\.[0-9]+)?[a-z]?\b", 0.92, kind="Legal Citation", gates=('u.s.', 'f.', 's. ct', 's.ct', 'usc', 'c.f.r', 'cfr')),
}

#: Which source's span leads when two are one individual.
PRIORITY = {"citation": 100, "citation_url": 95, "regex": 80, "ner": 70, "model": 50, "other": 0}

_FOUND = "doc_id long, label string, start int, end int, text string, value string, confidence double, error string"
_KINDS = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())


def register(name: str, extractor: Extractor) -> None:
    """Adds an extractor; a pattern that doesn't compile is refused here, not in a task."""
    re.compile(extractor.pattern)
    EXTRACTORS[name] = extractor


def _beginnings(starts: tuple[str, ...]) -> re.Pattern[str] | None:
    """Finds each place where one of ``starts`` may begin, by its first three characters, one character at a time; what matches ``s`` and ``i`` in any case counts as them."""
    if not starts:
        return None
    said = lambda x: "".join({"s": "[sſ]", "i": "[iıİ]"}.get(c) or re.escape(c) for c in x)
    by: dict[str, set[str]] = {}
    for x in starts:
        by.setdefault(said(x[:1].lower()), set()).add(said(x[1:3].lower()))
    return re.compile("|".join(f"{first}(?={'|'.join(sorted(rest))})" for first, rest in sorted(by.items())))


def _compiled(names: list[str] | None) -> dict[str, tuple[Extractor, re.Pattern[str], re.Pattern[str] | None]]:
    return {n: (EXTRACTORS[n], re.compile(EXTRACTORS[n].pattern), _beginnings(EXTRACTORS[n].starts)) for n in names or EXTRACTORS}


def _matches(rx: re.Pattern[str], beginnings: re.Pattern[str] | None, text: str, low: str) -> Iterator[re.Match[str]]:
    """As ``rx.finditer(text)``, tried only where a find may begin."""
    if beginnings is None:
        yield from rx.finditer(text)
        return
    end = 0
    for b in beginnings.finditer(low):
        if b.start() >= end and (m := rx.match(text, b.start())):
            yield m
            end = m.end()


def _low(text: str) -> str:
    """The text in lower case, character by character: one that would become two stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _finds(text: str, chosen: dict[str, tuple[Extractor, re.Pattern[str], re.Pattern[str] | None]]) -> Iterator[tuple]:
    """(label, start, end, text, value, confidence, error); an extractor that fails gives one row with its error and no span."""
    low = _low(text)
    for name, (e, rx, beginnings) in chosen.items():
        if e.gates and not any(g in low for g in e.gates):
            continue
        try:
            found = []
            for m in _matches(rx, beginnings, low if e.folded else text, low):
                start, end = m.span()
                whole = text[start:end]
                start += len(whole) - len(whole.lstrip())
                whole = whole.strip()
                if len(whole) >= e.least:
                    value = text[slice(*m.span(e.group))].strip() if e.group else whole
                    found.append((name, start, start + len(whole), whole, value, e.confidence, None))
        except Exception as x:  # one extractor's failure is its own
            found = [(name, None, None, None, None, None, f"{type(x).__name__}: {x}")]
        yield from found


def extract(docs: DataFrame, names: list[str] | None = None, errors: bool = False) -> DataFrame:
    """(doc_id, label, start, end, text, value, confidence, error) for each find of the named extractors; ends are trimmed with the text.

    With ``errors`` also a row without a span for each text that an extractor failed on.
    """
    chosen = _compiled(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, *f) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for f in _finds(t or "", chosen) if errors or f[-1] is None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], [f.split()[0] for f in _FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


# Citations


#: What a citation of each form is an instance of.
CITATION_CLASSES = {"case": "Caselaw", "short": "Caselaw", "id": "Caselaw", "supra": "Caselaw", "statute": "Statute", "regulation": "Statute", "journal": "Legal Scholarship", "other": "Legal Citation"}

_REPORTERS = r"(?:U\.\s?S\.|S\.\s?Ct\.|L\.\s?Ed\.(?:\s?2d)?|F\.(?:\s?(?:2d|3d|4th))?|F\.\s?Supp\.(?:\s?[23]d)?|[A-Z][a-z]*\.(?:\s?[23]d)?)"

#: Forms of citations: a pattern with named parts, its normal form, and a template of its address, if it has any.
CITATION_FORMS: dict[str, tuple[str, str, str]] = {
    "statute": (r"\b(?P<title>[0-9]+)\s+U\.?\s?S\.?\s?C\.?(?:\s*§+)?\s*(?P<section>[0-9]+[a-z]{0,2}(?:-[0-9]+)?)\b", "{title} U.S.C. § {section}", "https://www.law.cornell.edu/uscode/text/{title}/{section}"),
    "regulation": (r"\b(?P<title>[0-9]+)\s+C\.?\s?F\.?\s?R\.?(?:\s*§+)?\s*(?P<section>[0-9]+(?:\.[0-9]+)?[a-z]?(?:-[0-9]+)?)\b", "{title} C.F.R. § {section}", "https://www.law.cornell.edu/cfr/text/{title}/{section}"),
    "journal": (r"\b(?P<volume>[0-9]+)\s+(?P<journal>[A-Z][a-z]+\.?(?:\s[A-Z][a-z]*\.?)*\sL\.\s?(?:Rev|J)\.)\s+(?P<page>[0-9]+)\b", "{volume} {journal} {page}", ""),
    "short": (rf"\b(?P<volume>[0-9]+)\s+(?P<reporter>{_REPORTERS})(?:,)?\s+at\s+(?P<page>[0-9]+)\b", "{volume} {reporter}, at {page}", ""),
    "case": (rf"\b(?P<volume>[0-9]+)\s+(?P<reporter>{_REPORTERS})\s+(?P<page>[0-9]+)\b(?:\s+\((?P<year>[0-9]{{4}})\))?", "{volume} {reporter} {page}", "https://cite.case.law/{slug}/{volume}/{page}/"),
    "id": (r"\b[Ii]d\.(?:\s+at\s+(?P<page>[0-9]+))?", "Id.", ""),
    "supra": (r"\bsupra(?:,?\s+note\s+(?P<note>[0-9]+))?\b", "supra", ""),
}


#: Where a form may begin, if it begins with a number: each is followed by white space and a capital. Other forms are looked for where the text has their word.
_NUMBERED, _UNNUMBERED = re.compile(r"\b[0-9]+(?=\s+[A-Z])"), {"id": "d.", "supra": "supra"}


def _forms() -> list[tuple[str, re.Pattern[str], str, str]]:
    return [(form, re.compile(p), normal, url) for form, (p, normal, url) in CITATION_FORMS.items()]


def _cited(text: str, forms: list[tuple[str, re.Pattern[str], str, str]]) -> list[tuple]:
    """(start, end, text, form, class, normal_form, url, confidence) of a text's citations, in order."""
    out: list[tuple] = []
    numbers = [m.start() for m in _NUMBERED.finditer(text)]
    for form, rx, normal, url in forms:
        word = _UNNUMBERED.get(form)
        for m in _begun(rx, text, numbers) if word is None else rx.finditer(text) if word in text else ():
            if any(m.start() < e and s < m.end() for s, e, *_ in out):
                continue
            parts = {k: re.sub(r"\s+", " ", v) for k, v in m.groupdict().items() if v}
            parts["slug"] = re.sub(r"[^a-z0-9]+", "-", parts.get("reporter", "").lower().replace(". ", ".").replace(".", "")).strip("-")
            said = normal.format(**parts) + (f" ({parts['year']})" if "year" in parts else "")
            out.append((m.start(), m.end(), m.group(), form, CITATION_CLASSES[form], said if said != m.group() else None, url.format(**parts) or None, 0.92))
    return sorted(out)


def _begun(rx: re.Pattern[str], text: str, places: list[int]) -> Iterator[re.Match[str]]:
    """As ``rx.finditer(text)``, where a match can only begin at these places."""
    end = 0
    for i in places:
        if i >= end and (m := rx.match(text, i)):
            yield m
            end = m.end()


def citations(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, text, form, class, normal_form, url, confidence): what an earlier form has found isn't found again within it.

    ``normal_form`` is null where the text is in it already, ``url`` where the form has no address.
    """
    schema = "doc_id long, start int, end int, text string, form string, class string, normal_form string, url string, confidence double"
    kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _forms()
        for b in batches:
            out = [(d, *f) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for f in _cited(t or "", forms)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_more_citations(found: DataFrame, more: DataFrame) -> DataFrame:
    """Citations with those of another extractor (doc_id, start, end, text, normal_form, url) whose span isn't among them, at 0.90."""
    new = more.join(found.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti")
    return found.unionByName(new.select("doc_id", "start", "end", "text", F.lit("other").alias("form"), F.lit(CITATION_CLASSES["other"]).alias("class"), "normal_form", "url", F.lit(0.90).alias("confidence")))


# Spans of an entity recogniser


#: Class and confidence by the recogniser's label.
ENTITY_CLASSES = {"PERSON": ("Person", 0.80), "ORG": ("Organization", 0.78), "GPE": ("Location", 0.78), "LOC": ("Location", 0.78)}


def entities(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end, text, class, confidence) of recognised spans (doc_id, start, end, text, tag): phrases that are no entities left out.

    A person whose name has the ending of an organization is one.
    """
    kind = F.coalesce(*[F.when(F.col("tag") == t, c) for t, (c, _) in ENTITY_CLASSES.items()])
    sure = F.coalesce(*[F.when(F.col("tag") == t, s) for t, (_, s) in ENTITY_CLASSES.items()])
    ends = r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(re.escape(w) for w in sorted(ORGANIZATION_ENDS, key=len, reverse=True)) + r")(?![A-Za-z0-9_])"
    stop = F.lower(F.btrim("text")).isin(STOP_ENTITIES)
    kept = spans.filter(F.col("tag").isin(*ENTITY_CLASSES) & ~stop)
    return kept.select("doc_id", "start", "end", "text", F.when((F.col("tag") == "PERSON") & F.col("text").rlike(ends), "Organization").otherwise(kind).alias("class"), sure.alias("confidence"))


# Individuals


_PERSON = "name string, mention string, start int, end int, source string, links array<string>, normal_form string, url string"
_PERSON_KINDS = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
BLOCK = 256


def as_individuals(df: DataFrame, source: Column, link: Column, name: Column | None = None) -> DataFrame:
    """Rows with spans as individuals; ``normal_form`` and ``url`` stay where there are any."""
    more = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("normal_form", "url")]
    return df.select("doc_id", (F.col("text") if name is None else name).alias("name"), F.col("text").alias("mention"), "start", "end", source.alias("source"), F.array(link).alias("links"), *more)


class _Kept:
    """A document's individuals as they are kept, found again by span, name and mention without looking at all of them."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self._names: dict[str, int] = {}  # the first kept one that a name belongs to
        self._kept_names: list[str] = []
        self._mentions: dict[str, int] = {}
        self._blocks: dict[int, list[int]] = {}

    def find(self, r: dict) -> int | None:
        """The first kept one that r belongs to; without any r is kept."""
        said, start, end = r["name"], r["start"], r["end"]
        name = said.lower().strip()
        mention = name if r["mention"] == said else r["mention"].lower().strip()
        first = self._names.get(name)
        if first is None:
            for i, x in enumerate(self._kept_names):
                if name in x or x in name:
                    self._names[name] = first = i
                    break
        also = self._mentions.get(mention)
        if also is not None and (first is None or also < first):
            first = also
        blocks = range(start // BLOCK, max(start, end - 1) // BLOCK + 1)
        for b in blocks:
            for i in self._blocks.get(b, ()):  # in the order in which they were kept
                if first is not None and i >= first:
                    break
                x = self.rows[i]
                if x["start"] < end and start < x["end"]:
                    first = i
                    break
        if first is not None:
            return first
        i = len(self.rows)
        self.rows.append({**r, "links": list(r["links"] or []), "n_merged": 1, "sources": {r["source"]}})
        self._kept_names.append(name)
        self._mentions.setdefault(mention, i)
        for b in blocks:
            self._blocks.setdefault(b, []).append(i)
        return None

    def merge(self, i: int, r: dict) -> None:
        into = self.rows[i]
        into["links"] += [x for x in r["links"] or [] if x not in into["links"]]
        into["n_merged"] += 1
        into["sources"].add(r["source"])
        for c in ("normal_form", "url"):
            into[c] = into[c] or r[c]


def _merged(rows: list[dict]) -> list[tuple]:
    """Merged into the first kept one that overlaps, has the name, a name within it or around it, or the mention.

    The stronger source comes first, then the earlier span; a merge of two sources is a hybrid, which keeps its strength.
    """
    kept = _Kept()
    for r in sorted(rows, key=lambda r: (-PRIORITY.get(r["source"], 0), r["start"], r["end"], r["name"])):
        i = kept.find(r)
        if i is not None:
            kept.merge(i, r)
    return [(k["name"], k["mention"], k["start"], k["end"], k["source"] if len(k["sources"]) == 1 else "hybrid", k["links"], k["normal_form"], k["url"], k["n_merged"]) for k in kept.rows]


def _table(out: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), *_PERSON_KINDS, pa.int32())
    return [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]


_MERGED = f"doc_id long, {_PERSON}, n_merged int"
_MERGED_NAMES = [f.split()[0] for f in _MERGED.split(", ")]


def individuals(df: DataFrame) -> DataFrame:
    """Individuals (doc_id, name, mention, start, end, source, links, normal_form, url) of a document merged, with ``n_merged``.

    For rows of any origin, gathered by document. What patterns find needn't be gathered: see ``found_individuals``.
    """
    for c in ("normal_form", "url"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))

    def fold(rows: list[dict]) -> list[dict]:
        return [dict(zip(_MERGED_NAMES, (rows[0]["doc_id"], *r), strict=True)) for r in _merged(rows)]

    return folded(df.select(*[c for c in _MERGED_NAMES if c != "n_merged"]), ["doc_id"], fold, StructType.fromDDL(_MERGED))


def found_individuals(docs: DataFrame, names: list[str] | None = None, more: str | None = None, cited: bool = False) -> DataFrame:
    """What the extractors find in (doc_id, text), merged within each document in the pass that finds it: no shuffle.

    With ``cited`` what ``citations`` finds joins in, in the same pass. ``more`` names a column of individuals from elsewhere, array<struct> with the fields of ``individuals``, that join in.
    """
    chosen = _compiled(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = _forms() if cited else []
        for b in batches:
            out = []
            given = b.column(more).to_pylist() if more else [None] * b.num_rows
            for d, t, also in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), given, strict=True):
                rows = [{"name": v, "mention": x, "start": s, "end": e, "source": "citation" if n == "citation" else "regex", "links": [chosen[n][0].kind or n], "normal_form": None, "url": None} for n, s, e, x, v, _, error in _finds(t or "", chosen) if error is None]
                rows += [{"name": x, "mention": x, "start": s, "end": e, "source": "citation", "links": [kind], "normal_form": normal, "url": url} for s, e, x, _, kind, normal, url, _ in _cited(t or "", forms)] if forms else []
                out += [(d, *r) for r in _merged(rows + list(also or []))]
            yield pa.RecordBatch.from_arrays(_table(out), _MERGED_NAMES)

    return docs.select("doc_id", "text", *([more] if more else [])).mapInArrow(run, _MERGED)


def gathered(df: DataFrame, name: str = "more") -> DataFrame:
    """Individuals as one array a document, as ``found_individuals`` takes them."""
    fields = [f.split()[0] for f in _PERSON.split(", ")]
    for c in ("normal_form", "url"):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    return df.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias(name))


def filled_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Class links (link_id, label, iri, branch) whose iri is missing get that of the label, ignoring case."""
    known = labels.select(F.lower("label").alias("key"), F.col("iri").alias("known_iri"), F.col("branch").alias("known_branch"))
    met = links.withColumn("key", F.lower("label")).join(known, "key", "left")
    bare = F.coalesce(F.col("iri"), F.lit("")) == ""
    return met.withColumn("branch", F.when(bare, F.col("known_branch")).otherwise(F.col("branch"))).withColumn("iri", F.when(bare, F.col("known_iri")).otherwise(F.col("iri"))).drop("key", "known_iri", "known_branch")
