"""Licence scans in native expressions: ordered signature rules behind a keyword prefilter.

A text is normalised to lower-case words. Texts without any anchor word stop there. For the others
each rule is gated by its keyword, the surviving rules' patterns give detections as intervals of
words, and a detection is dropped if another one of at least its priority contains it; of equal
intervals the higher priority stays, then the earlier rule. Everything happens within the row: no
shuffle, so neither copies nor sources can make a hot group.

Null or empty text: no words, no labels, score 0. Repeated rows are scanned each.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import lower_ascii
from lexspan.llm.license_rules import ANCHORS, rules

#: All but words, in lower-cased text; and the base phrases with their labels.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_RULE_TYPE = "array<struct<n:int,label:string,prio:int,weight:double,kw:string,rx:string>>"


def _own(phrase: str) -> str:
    """A phrase as it stands in padded text, where each word has a space of its own on either side."""
    return " " + phrase.replace(" ", "  ") + " "


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def _detections() -> str:
    """All rules' intervals (start, -end, -prio, n, label, weight) over ``pad``, sorted."""
    places = f"""
        aggregate(
          sequence(1, size(m)),
          struct(0 AS at, CAST(array() AS array<struct<a:int,b:int,p:int,n:int,label:string,weight:double>>) AS found),
          (acc, i) -> named_struct(
            'at', acc.at + CAST(({_spaces("s[i - 1]")} + {_spaces("m[i - 1]")}) / 2 AS int),
            'found', concat(acc.found, array(named_struct(
              'a', acc.at + CAST({_spaces("s[i - 1]")} / 2 AS int),
              'b', -(acc.at + CAST(({_spaces("s[i - 1]")} + {_spaces("m[i - 1]")}) / 2 AS int)),
              'p', -r.prio, 'n', r.n, 'label', r.label, 'weight', r.weight)))),
          acc -> acc.found)"""
    one = f"flatten(transform(array(struct(regexp_extract_all(pad, r.rx, 0) AS m, split(pad, r.rx, -1) AS s)), x -> CASE WHEN size(x.m) > 0 THEN {places.replace('s[i', 'x.s[i').replace('m[i', 'x.m[i').replace('size(m)', 'size(x.m)')} ELSE CAST(array() AS array<struct<a:int,b:int,p:int,n:int,label:string,weight:double>>) END))"
    return f"array_sort(flatten(transform(filter(rules, r -> contains(pad, r.kw)), r -> {one})))"


def _kept() -> str:
    """Labels and the best weight of detections that no earlier one of their priority or more contains."""
    # in this order a containing interval comes first, so the furthest end so far, per priority, decides
    return """
        aggregate(
          dets,
          struct(CAST(array() AS array<string>) AS labels, 0.0D AS best, 0 AS e1, 0 AS e2, 0 AS e3),
          (acc, d) -> named_struct(
            'labels', CASE WHEN -d.b > CASE -d.p WHEN 3 THEN acc.e3 WHEN 2 THEN acc.e2 ELSE acc.e1 END THEN array_union(acc.labels, array(d.label)) ELSE acc.labels END,
            'best', CASE WHEN -d.b > CASE -d.p WHEN 3 THEN acc.e3 WHEN 2 THEN acc.e2 ELSE acc.e1 END THEN greatest(acc.best, d.weight) ELSE acc.best END,
            'e1', greatest(acc.e1, -d.b),
            'e2', CASE WHEN -d.p >= 2 THEN greatest(acc.e2, -d.b) ELSE acc.e2 END,
            'e3', CASE WHEN -d.p >= 3 THEN greatest(acc.e3, -d.b) ELSE acc.e3 END))"""


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with words, base places, labels, score and the detections themselves.

    Adds n_words, n_base, first_word, last_word long, base_labels, labels string, score double and
    detections array<struct<a, b, p, n, label, weight>> (words from a to -b); columns of ``df`` with
    these names give way.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    own = [c for c in df.columns if c not in (text, *new)]
    kept = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)]  # no name of df's can clash with one made below
    held = [f"own_{i}" for i in range(len(own))]
    norm = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(F.col(f"`{text}`"), F.lit(""))), NOT_WORD, " "))
    x = df.select(*kept, norm.alias("norm"))
    gate = F.lit(False)
    for a in ANCHORS:
        gate = gate | F.contains("norm", F.lit(a))
    x = x.select(*held, F.expr(f"CASE WHEN norm = '' THEN 0 ELSE {_spaces('norm')} + 1 END").cast("long").alias("n_words"), F.when(gate, F.concat(F.lit(" "), F.replace("norm", F.lit(" "), F.lit("  ")), F.lit(" "))).alias("pad"))
    table = F.from_json(F.lit(json.dumps(rules())), _RULE_TYPE)
    count = lambda p: F.expr(f"CAST((length(pad) - length(replace(pad, '{p}', ''))) / {len(p)} AS long)")
    phrases = [(_own(p), label, p.count(" ") + 1) for p, label in PHRASES.items()]
    x = x.select("*", table.alias("rules"), *[count(p).alias(f"n_{label}") for p, label, _ in phrases])
    has = [F.col(f"n_{label}") > 0 for _, label, _ in phrases]
    first = [F.when(h, F.expr(f"CAST({_spaces(f"substring_index(pad, '{p}', 1)")} / 2 AS long)")) for h, (p, _, _) in zip(has, phrases, strict=True)]
    last = [F.when(h, F.col("n_words") - F.expr(f"CAST({_spaces(f"substring_index(pad, '{p}', -1)")} / 2 AS long)") - k) for h, (p, _, k) in zip(has, phrases, strict=True)]
    base = F.array_compact(F.array(*[F.when(h, label) for h, (_, label, _) in zip(has, phrases, strict=True)]))
    x = x.select(
        *held,
        "n_words",
        F.coalesce(sum((F.col(f"n_{label}") for _, label, _ in phrases), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        base.alias("base"),
        F.when(F.col("pad").isNotNull(), F.expr(_detections())).alias("dets"),
    )
    x = x.select("*", F.when(F.size("dets") > 0, F.expr(_kept())).alias("kept"))
    labels = F.array_sort(F.array_union("base", F.coalesce("kept.labels", F.array().cast("array<string>"))))
    return x.select(
        *[F.col(h).alias(c) for h, c in zip(held, own, strict=True)],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("kept.best", F.lit(0.0)).alias("score"),
        F.coalesce("dets", F.array().cast("array<struct<a:int,b:int,p:int,n:int,label:string,weight:double>>")).alias("detections"),
    )


def oracle() -> str:
    """The same in DuckDB: base places from lists of words, detections by lists, containment by comparing pairs."""
    values = ",\n".join("({n}, '{label}', {prio}, {weight}, '{kw}', '{rx}')".format(**r) for r in rules())
    gate = " OR ".join(f"contains(norm, '{a}')" for a in ANCHORS)
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    places = " UNION ALL ".join(
        f"SELECT k, {label!r} AS label, i AS pos FROM words, unnest(range(len(w) - {p.count(' ')})) AS t(i) WHERE " + " AND ".join(f"w[i + {j + 1}] = '{word}'" for j, word in enumerate(p.split(" ")))
        for p, label in PHRASES.items()
    )
    return f"""
WITH rules(n, label, prio, weight, kw, rx) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT k, doc_id, regexp_extract_all(t, '{WORD}') AS w FROM docs),
base AS (SELECT k, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, list(DISTINCT label) AS each FROM ({places}) GROUP BY k),
gated AS (SELECT k, array_to_string(w, ' ') AS norm FROM words),
padded AS (SELECT k, ' ' || replace(norm, ' ', '  ') || ' ' AS pad FROM gated WHERE {gate}),
hits AS (SELECT k, n, label, prio, weight, regexp_extract_all(pad, rx) AS m, string_split_regex(pad, rx) AS s FROM padded JOIN rules ON contains(pad, kw)),
each AS (SELECT k, n, label, prio, weight, m, list_transform(s, lambda x: {spaces("x")}) AS ns, list_transform(m, lambda x: {spaces("x")}) AS nm, i FROM hits, unnest(range(1, len(m) + 1)) AS t(i)),
dets AS (SELECT k, n, label, prio, weight, (list_sum(ns[1:i]) + coalesce(list_sum(nm[1:i - 1]), 0)) // 2 AS a, (list_sum(ns[1:i]) + list_sum(nm[1:i])) // 2 AS b FROM each),
kept AS (SELECT k, label, weight FROM dets d WHERE NOT EXISTS (
  SELECT 1 FROM dets e WHERE e.k = d.k AND e.prio >= d.prio AND e.a <= d.a AND e.b >= d.b AND (e.a < d.a OR e.b > d.b OR e.prio > d.prio OR e.n < d.n))),
own AS (SELECT k, list(DISTINCT label) AS each, max(weight) AS best FROM kept GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(base.labels, '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.each, []), coalesce(own.each, [])))), ','), '') AS labels,
  CAST(coalesce(best, 0) AS DOUBLE) AS score
FROM words LEFT JOIN base USING (k) LEFT JOIN own USING (k)"""
