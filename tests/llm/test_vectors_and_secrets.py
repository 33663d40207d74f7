"""Secret scans, clusters and codes against plain versions, and their odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.llm import byte_bpe, drake, secret_scan, vector_codes, vector_grid
from lexspan.llm.queries import QUERIES

RANKS = P.path("byte_bpe_50k.tiktoken")
EFFICIENCY = secret_scan.Efficiency.of(RANKS, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def plain_base(x):
    """The patterns one after another, each kind by itself, lengths looked at afterwards."""
    found = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", x):
        if len(m.group(1)) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m.group()) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def plain_random(x, base):
    """Runs that the vocabulary hardly compresses, outside of base spans."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", x):
        run = m.group()
        inside = all(any(a <= i < b for _, a, b in base) for i in range(m.start(), m.end()))
        if inside or secret_scan.is_digest(run) or secret_scan.is_identifier(run) or run in secret_scan.KNOWN:
            continue
        if len(run) / sum(len(LIBRARY.encode_ordinary(run[i : i + 256])) for i in range(0, len(run), 256)) < 2:
            out.append(("random", m.start(), m.end()))
    return out


def ordered(found):
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


def test_op11(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table that has any
    d = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    texts = dict(zip(d.doc_id, d.text, strict=True))
    rows = QUERIES["op11_secret_scan"](spark, sf).collect()
    assert len(rows) == len(texts)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) > 0
    for r in rows:
        x = texts[r["doc_id"]] or ""
        base = plain_base(x)
        said = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert r["spans"] == said(ordered(base + plain_random(x, base)))


_pieces = st.sampled_from(["token", "TOKEN=", "secret: ", "api_key", "apiKEY", "='", '"', " ", ":", "=", "passwd", "password", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "deadbeef", "x", "\n", "ſecret=", "toKen=", "é", "𝒳", "q8Zx1vR7mT", "pL0kW3nB6y", "word_and_more", "/"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_pieces, max_size=30))
def test_secret_spans(parts):
    x = "".join(parts)
    base = plain_base(x)
    assert secret_scan.spans(x, EFFICIENCY) == ordered(base + plain_random(x, base))


def test_random_strings():
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = ["".join(rng.choices(letters, k=32)) for _ in range(300)]
    assert sum(any(s[0] == "random" for s in secret_scan.spans(f"see {x} there", EFFICIENCY)) for x in made) > 290
    plain = ["internationalisation_of_names", "getUserAccountSettingsByName", "src/main/java/org/example/Application", "453957876362148645395787", "123e4567-e89b-12d3-a456-426614174000", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "=" * 60, "-" * 80, "_" * 40]
    assert not [x for x in plain if secret_scan.spans(x, EFFICIENCY)]
    assert not [s for s in secret_scan.spans("A" * 64 + " " + hashlib.sha256(b"x").hexdigest().upper(), EFFICIENCY)]  # a digest in capitals
    known = made[0]
    assert not secret_scan.spans(known, EFFICIENCY, secret_scan.KNOWN | {known})


def test_secrets_odd_rows(spark):
    key = "AKIA" + "9Z" * 8
    long = "word " * 60_000 + key + "b7" * 40_000
    rows = [(1, f"𝒳 {key}", "a"), (1, f"𝒳 {key}", "a"), (2, None, None), (3, "", "a"), (None, "password = hunter2hunter2", "b"), (4, long, "b")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_hex string").withColumn("kind", F.lit("mine"))
    found = secret_scan.scan(odd, RANKS, P.PATTERN)
    assert found.columns == ["doc_id", "kind", "n_assign", "n_access", "n_hex", "n_random", "detections"]
    by = {r["doc_id"]: r for r in secret_scan.digested(found).collect()}
    assert found.count() == 6 and {r["kind"] for r in by.values()} == {"mine"}
    assert by[1]["spans"] == "access:2:22"  # code points
    assert (by[2]["spans"], by[3]["spans"], by[2]["n_hex"]) == ("", "", 0) and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[None]["spans"] == "assign:0:25"
    assert by[4]["spans"] == f"access:300000:{300000 + len(key)},hex:{300000 + len(key)}:{len(long)}"
    assert secret_scan.scan(odd.limit(0), RANKS, P.PATTERN).count() == 0
    shown = {r["doc_id"]: r["text"] for r in secret_scan.redact(odd, RANKS, P.PATTERN).collect()}
    assert (shown[1], shown[2], shown[None]) == ("𝒳 [access]", None, "[assign]")


# Clusters


def plain_clusters(vectors, starts, rounds):
    """Every distance of every vector in every round, in Python's whole numbers."""
    c = [list(s) for s in starts]
    dist = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for r in range(rounds + 1):
        to = [min(range(len(c)), key=lambda j, v=v: (dist(v, c[j]), j)) for v in vectors]
        if r < rounds:
            for j in range(len(c)):
                own = [v for v, t in zip(vectors, to, strict=True) if t == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return to, [dist(v, c[t]) for v, t in zip(vectors, to, strict=True)], c


def test_clusters_take_few_distances(spark):
    """Where vectors have clusters, bounds save most of the distances, and fewer of them come to be kept."""
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 9, (40, 16))
    rows = [(i, (middles[i % 40] + rng.normal(0, 0.5, 16)).tolist()) for i in range(4000)]
    found = drake.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=40, rounds=10, scale=64, dim=16)
    assert found.passes[0][:2] == (160_000, 160_000)  # the first round has no bounds yet
    assert sum(taken for taken, _, _ in found.passes[1:]) < 0.4 * sum(of for _, of, _ in found.passes[1:])
    assert found.passes[0][2] == 10 and found.passes[-1][2] < 10


@pytest.mark.parametrize("seed", range(6))
def test_clusters_like_plain_rounds(spark, seed):
    """Few values, so that ties, equal vectors and equal centroids are many; rounds enough for bounds to move often."""
    rng = random.Random(seed)
    dim, k, rounds = (2, 9, 6) if seed % 2 else (3, 12, 5)
    rows = [(i if i % 17 else None, [float(rng.randint(-4, 4)) for _ in range(dim)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = drake.cluster(df, k=k, rounds=rounds, scale=1, dim=dim)
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    to, far, c = plain_clusters([[int(x) for x in v] for _, v in rows], [[int(x) for x in v] for _, v in hashed[:k]], rounds)
    assert found.centroids == c
    ours = sorted((r["id"] or -1, r["cluster"], r["distance"]) for r in found.rows.collect())
    assert ours == sorted((i or -1, t, d) for (i, _), t, d in zip(rows, to, far, strict=True))


def test_bounds_hold():
    """After many moves every bound still is one, and the centroid is the nearest."""
    rng = np.random.default_rng(5)
    x, c = rng.integers(-60, 60, (500, 8)), rng.integers(-60, 60, (20, 8))
    b, kept = drake.rescan(x, c, 5), 5
    for step in range(12):
        new = c + rng.integers(-4 - 40 * (step == 6), 5, c.shape)
        b, needed, distances = drake.moved(x, new, np.sqrt(((new - c) ** 2).sum(1).astype(float)), b, kept)
        c, kept = new, max(2, kept - (step % 4 == 3))
        d = np.sqrt(((x[:, None, :] - c) ** 2).sum(2).astype(float))
        exact = ((x[:, None, :] - c) ** 2).sum(2)
        assert (exact.argmin(1) == b.cluster).all()
        assert (d[np.arange(len(x)), b.cluster] <= b.up).all()
        assert (np.take_along_axis(d, b.near, 1) >= b.low).all()
        other = np.ones_like(d, bool)
        np.put_along_axis(other, np.c_[b.near, b.cluster], False, 1)
        assert (np.where(other, d, math.inf).min(1) >= b.rest).all()
        assert (distances <= len(c) + 1 + b.low.shape[1]).all() and (needed <= b.low.shape[1]).all()


def test_cluster_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 64, "x"), (1, [0.5] * 64, "x"), (None, [-0.01] * 64, None), (3, [nan] * 64, "x"), (4, [inf] * 64, "x"), (5, None, "x"), (6, [None] * 64, "x"), (7, [1.0] * 63, "x"), (8, [], "x")]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    got = sorted(((r["vec_id"] or -1, r["cluster"], r["distance"], r["inertia"]) for r in drake.report(drake.cluster(odd)).collect()))
    assert got == [(-1, 2, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)]
    assert drake.report(drake.cluster(odd.filter("vec_id > 2"))).count() == 0
    assert drake.report(drake.cluster(odd.limit(0))).count() == 0
    one = drake.report(drake.cluster(odd.filter("vec_id = 1"), k=1)).collect()
    assert [r["centroid_sha256"] for r in one] == [hashlib.sha256(",".join(["32"] * 64).encode()).hexdigest()] * 2
    with pytest.raises(Exception, match="beyond"):
        drake.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).rows.count()


def test_squared_is_exact():
    rng = np.random.default_rng(6)
    for most in (10, 1 << 20, vector_grid.LIMIT):
        x, c = rng.integers(-most + 1, most, (50, 64)), rng.integers(-most + 1, most, (7, 64))
        assert vector_grid.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]


# Codes


def plain_codes(vectors, parts, entries, rounds):
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    dist = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for r in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e, x=v[p], b=books[p]: (dist(x, b[e]), e)) for p in range(parts)] for v in cut]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [v[p] for v, c in zip(cut, codes, strict=True) if c[p] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return codes, [sum(dist(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes, strict=True)], books


@pytest.mark.parametrize("seed", range(4))
def test_codes_like_full_search(spark, seed):
    rng = random.Random(seed)
    rows = [(i // 2, [float(rng.randint(-3, 3)) for _ in range(12)], i % 3 or None) for i in range(200)]
    rows.sort(key=lambda r: (r[0], r[1]))
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "vec_id long, embedding array<double>, label int")
    books = vector_codes.train(df, parts=4, entries=20, rounds=3, scale=1, dim=12)
    codes, errors, entries = plain_codes([[int(x) for x in v] for _, v, _ in rows], 4, 20, 3)
    assert books.entries.tolist() == entries
    ours = sorted((r["vec_id"], r["code"], r["error"]) for r in vector_codes.encode(df, books).collect())
    assert ours == sorted((i, "".join(f"{x:02x}" for x in c), e) for (i, _, _), c, e in zip(rows, codes, errors, strict=True))
    back = vector_codes.decode(vector_codes.encode(df.filter("vec_id = 7"), books), books).collect()
    for r in back:
        assert r["embedding"] == [float(x) for p in range(4) for x in entries[p][int(r["code"][2 * p : 2 * p + 2], 16)]]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 2**32))
def test_partial_distances(m, d, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-3, 4, (m, d)), rng.integers(-4, 5, (60, d))
    far = ((x[:, None, :] - book) ** 2).sum(2)
    index, best, squares = vector_codes.nearest(x, book)
    assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


def test_partial_distances_drop_most():
    rng = np.random.default_rng(7)
    book, x = rng.normal(0, 60, (64, 4)).astype(int), rng.normal(0, 60, (4000, 4)).astype(int)
    assert vector_codes.nearest(x, book)[2] < 0.6 * 4000 * 64 * 4


def test_code_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.5] * 64, None, "x"), (1, [0.5] * 64, 3, "x"), (None, [-0.01] * 64, None, "x"), (3, [nan] * 64, 3, "x"), (5, None, 3, "x"), (6, [None] * 64, 3, "x"), (7, [1.0] * 63, 3, "x")]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    got = sorted((r["vec_id"] or -1, r["code"], r["error"], r["label_error"]) for r in vector_codes.coded(odd).collect())
    assert got == [(-1, "02" * 16, 0, 0), (1, "00" * 16, 0, 0), (1, "00" * 16, 0, 0)]
    assert vector_codes.coded(odd.limit(0)).count() == 0
    books = vector_codes.train(odd)
    clash = vector_codes.encode(odd.withColumn("error", F.lit("mine")), books)
    assert clash.columns == ["vec_id", "label", "code", "error"] and dict(clash.dtypes)["error"] == "bigint"
