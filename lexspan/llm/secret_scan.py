"""Secret scans: patterns of assignments, access keys and hexadecimal runs, and a token-efficiency test for what has no pattern.

Text of any kind that people write is compressed well by a byte-pair vocabulary; random strings are not. So
runs of at least ``LEAST`` key characters are encoded, and one that gives fewer than ``RATIO`` characters
a token is random, unless it is

* a digest: hexadecimal digits as many as a usual hash has, such a hash in base 64 behind its name, or one of ``KNOWN``;
* an identifier: a UUID, digits only, or words, numbers and camel-case humps put together, of ``HUMP`` letters on average;
* within what patterns have found already.

Spans are places of code points in the whole text, ends exclusive. Everything happens within the row, so
nothing is shuffled. Null or empty text has no spans. Repeated rows are scanned each.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexspan.llm.common import small

#: The patterns, the order of kinds, and how long what counts must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_LEAST = 8
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST, RATIO, HUMP = 20, 2.0, 3.5
#: A run is encoded in pieces of so many characters, so that time is linear in its length.
PIECE = 256

#: Lengths of hexadecimal digests of 128 to 512 bits.
DIGESTS = {32, 40, 48, 56, 64, 96, 128}
#: Digests of nothing at all that stand in many texts: SHA-256 and SHA-1 in base 64.
KNOWN = frozenset({"47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "2jmj7l5rSw0yVb/vlWAYkK/YBwk="})
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NAMED_HASH = re.compile(r"(?:sha|SHA)(?:1|224|256|384|512)[-_/][A-Za-z0-9+/_-]+={0,2}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

NEW = ["n_assign", "n_access", "n_hex", "n_random", "detections"]
_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class Efficiency:
    """Characters a token under one vocabulary; made once for each Python worker."""

    _made: dict[str, Efficiency] = {}

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str, pattern: str) -> Efficiency:
        if path not in cls._made:
            cls._made[path] = cls(path, pattern)
        return cls._made[path]

    def ratio(self, run: str) -> float:
        return len(run) / sum(len(self._encoding.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def is_digest(run: str) -> bool:
    return bool((len(run) in DIGESTS and _HEX_ONLY.fullmatch(run)) or _NAMED_HASH.fullmatch(run)) or run in KNOWN


def is_identifier(run: str) -> bool:
    """A UUID, digits only, or humps that are long enough, on average, to be words; digits make no word longer."""
    if _UUID.fullmatch(run) or not re.search("[A-Za-z]", run):
        return True
    humps = _HUMPS.findall(run)
    letters = sum(len(h) for h in humps if not h.isdigit())
    return letters >= HUMP * len(humps)


def spans(text: str, efficiency: Efficiency, known: frozenset[str] = KNOWN) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of kinds."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    union = _union(found)
    i = 0
    for m in RUN.finditer(text):
        start, end, run = m.start(), m.end(), m.group()
        while i < len(union) and union[i][1] <= start:
            i += 1
        inside = i < len(union) and union[i][0] <= start and end <= union[i][1]
        if not inside and run not in known and not is_digest(run) and not is_identifier(run) and efficiency.ratio(run) < RATIO:
            found.append((start, 3, end))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _union(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order; spans that touch are one stretch."""
    out: list[tuple[int, int]] = []
    for start, _, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def scan(df: DataFrame, path: str, pattern: str, text: str = "text", known: frozenset[str] = KNOWN) -> DataFrame:
    """``df`` without its text, with n_assign, n_access, n_hex, n_random long and detections array<struct<kind, start, end>>.

    Columns of ``df`` that have the name of a new one give way to it. ``known`` are further strings that are no
    secrets; the list goes to every task, so it is meant to be short.
    """
    kept = [c for c in df.columns if c not in (text, *NEW)]
    fields = [df.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in NEW[:4]] + [T.StructField("detections", _TYPE)]
    schema = T.StructType(fields)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = Efficiency.of(path, pattern)
        for b in small(batches):
            found = [spans(x, efficiency, known) if x else [] for x in b.column(text).to_pylist()]
            columns = [b.column(c) for c in kept]
            columns += [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in KINDS]
            columns.append(pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in f] for f in found], target.field("detections").type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.select(*[F.col(f"`{c}`") for c in (*kept, text)]).mapInArrow(run, schema)


def redact(df: DataFrame, path: str, pattern: str, text: str = "text", known: frozenset[str] = KNOWN) -> DataFrame:
    """``df`` with ``[kind]`` in place of each span of its text; spans that overlap become one, by the name of the first. Null stays null."""
    schema, names = df.schema, df.columns
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = Efficiency.of(path, pattern)
        for b in small(batches):
            shown = []
            for x in b.column(text).to_pylist():
                out, at = [], 0
                for kind, start, end in spans(x, efficiency, known) if x else []:
                    if start >= at:
                        out += [x[at:start], f"[{kind}]"]
                    at = max(at, end)
                shown.append(x if x is None else "".join(out) + x[at:])
            columns = [pa.array(shown, pa.string()) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def digested(found: DataFrame) -> DataFrame:
    """Detections as strings: base_sha256 over those of the patterns, spans over all."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.array_join(F.transform(F.filter("detections", lambda x: x["kind"] != "random"), said), ",")
    return found.withColumn("base_sha256", F.sha2(base, 256)).withColumn("spans", F.array_join(F.transform("detections", said), ",")).drop("detections")
