import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from compare import assert_same, connect
from tokenizers import Tokenizer

from lexspan.llm import byte_bpe, chat, media, partenum, winnowing
from lexspan.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    return dict(zip(d.doc_id, d.text, strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    assert_same(spark, connect(sf), sf, QUERIES[name], ORACLE_SQL[name])


def test_op2(spark, sf, docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in QUERIES["op2_token_counts"](spark, sf).collect():
        n = len(t.encode(docs[r["doc_id"]] or "", add_special_tokens=False))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((docs[r["doc_id"]] or "").encode()), n > 512)


def plain_cuts(data):
    """Ends of chunks by a gear hash that goes byte by byte."""
    ends, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(media._GEARS[byte])) % 2**32
        n = i + 1 - start
        if (n >= media.LEAST and h >> 19 & media.MASK == 0) or n == media.MOST:
            ends.append(i + 1)
            start = i + 1
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def test_op3(spark, sf, docs):
    rows = QUERIES["op3_media_chunks"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        b = (docs[r["doc_id"]] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:  # the standard library's idea of 8-bit mono
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        mean = sum(p) / len(p) - 128
        signs = [x >= 128 for x in p]
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert abs(float(said["mean"]) - mean) < 1e-3
        assert abs(float(said["rms"]) - (sum((x - 128) ** 2 for x in p) / len(p)) ** 0.5) < 1e-3
        assert abs(float(said["zcr"]) - sum(x != y for x, y in zip(signs, signs[1:], strict=False)) / len(p)) < 1e-4
        share = [sum(1 for x in p if x // 16 == k) / len(p) for k in range(16)]
        assert [float(x) for x in said["bands"].split(",")] == pytest.approx(share, abs=1e-4)
        assert float(said["entropy"]) == pytest.approx(-sum(s * math.log2(s) for s in share if s), abs=1e-3)


def test_op3_cuts(docs):
    rng = random.Random(2)
    for data in [*((x or "").encode() for x in docs.values() if x and len(x) > 3_000), rng.randbytes(300_000), bytes(200_000), b"ab" * 5_000, b""]:
        assert media.cuts(data) == plain_cuts(data)


def test_op5(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    rows = {r["conv_id"]: r for r in QUERIES["op5_chat_format"](spark, sf).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7]["loss_chars"] == len(said) and rows[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    for c, g in d.groupby("conv_id"):
        turns = "".join(f"{a}\n{b}\n" for a, b in zip(g.role, g.text, strict=True))
        loss = "".join(b for a, b in zip(g.role, g.text, strict=True) if a == "assistant")
        shown = "".join(f"{chat.TURN}{chat.escape(a)}{chat.SEP}{chat.escape(b)}{chat.END}" for a, b in zip(g.role, g.text, strict=True))
        assert (rows[c]["n_turns"], rows[c]["turns_sha256"], rows[c]["loss_sha256"]) == (len(g), hashlib.sha256(turns.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
        assert (rows[c]["loss_chars"], rows[c]["formatted_chars"]) == (len(loss), len(shown))


def test_op6_targets(spark, sf):
    d = QUERIES["op6_source_mix"](spark, sf).toPandas()
    assert (d.taken <= 2 * d["size"]).all()
    by = d.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert abs(by.target.sum() - 1.5 * d["size"].sum()) < 1
    assert (by.target <= 2 * by.source_size + 1e-6).all()
    assert ((by.taken - by.target).abs() <= d["size"].max()).all()


def test_op7(spark, sf, docs):
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in QUERIES["op7_byte_bpe"](spark, sf).collect():
        x = docs[r["doc_id"]] or ""
        ids = t.encode_ordinary(x)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())


def test_op8_held_out(spark):
    """On 10,000 documents, as 200 have too few labels to learn from."""
    sf = "/root/testdata/sf0.1"
    d = QUERIES["op8_toxicity"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert ((d.score >= 0) & (d.score <= 1)).all() and ((d.score >= 0.3) == (d.predicted == 1)).all()
    h = d[d.held_out]
    hit = ((h.predicted == 1) & (h.toxic == 1)).sum()
    assert hit / (h.toxic == 1).sum() > 0.85 and hit / (h.predicted == 1).sum() > 0.9


def plain_winnow(x, k=8, window=8):
    """(hash, position) chosen by looking at every window, and all grams of short texts."""
    points = [ord(c) + 1 for c in x]
    power = [1]
    for _ in range(64):
        power.append(power[-1] * 0x9E3779B97F4A7C15 % 2**64)

    def gram(i, n):
        h = sum(p * power[n - 1 - j] for j, p in enumerate(points[i : i + n])) % 2**64
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64
        return (h ^ h >> 29) >> 32

    n = len(points)
    if n < 2 * (k + window - 1):
        half = 1
        while half * 2 <= (n + 1) // 2:
            half *= 2
        sizes = [s for s in ([k] if half >= k else [half, 2 * half]) if s <= n] if n else []
        return [(gram(i, s), i) for i in range(n) for s in sizes if i + s <= n]
    hashes = [gram(i, k) for i in range(n - k + 1)]
    chosen = {min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)}
    return [(hashes[j], j) for j in sorted(chosen)]


def plain_written(found):
    return " ".join(f"{h:08x}{p - q:02x}" for (h, p), q in zip(found, [0, *(p for _, p in found)], strict=False))


def plain_likeness(a, b):
    a, b = ({h for h, _ in x} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op9(spark, sf, docs):
    """All columns against a winnowing that looks at every window; long texts are left to the next test."""
    order = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in QUERIES["op9_winnowing"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, k in enumerate(order):
        x, y = docs[k] or "", docs[order[(i + 1) % len(order)]] or ""
        h = len(x) // 2
        e = x[: len(x) - h] + y[:h]
        assert (rows[k]["n_chars"], rows[k]["edited_sha256"]) == (len(x), hashlib.sha256(e.encode()).hexdigest())
        if len(x) + len(y) > 6_000:
            continue
        a, b, c = plain_winnow(x), plain_winnow(e), plain_winnow(y)
        assert (rows[k]["fingerprint"], rows[k]["edited_fingerprint"]) == (plain_written(a), plain_written(b))
        assert rows[k]["near_edited"] == pytest.approx(plain_likeness(a, b)) and rows[k]["near_next"] == pytest.approx(plain_likeness(a, c))


def test_winnow_ties():
    for x in ["ab" * 40, "a" * 50, "abcabcabd" * 9, "x" * 29, "x" * 30, "xy" * 7, "", "q"]:
        h, p = winnowing.winnow(x)
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == plain_winnow(x)


def brute_components(docs):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, x in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(table))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    where = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in where[s]:
                shared[j] += 1
            where[s].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_op10(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_ngram_jaccard"](spark, sf).collect()}
    assert got == brute_components(docs)


def test_op10_signing_cost(monkeypatch):
    """A set's elements, which are mixed already, are dealt to splits by one multiplication: only what splits hold is mixed, and linked sets still meet."""
    a = partenum.shingles(" ".join(f"w{i}" for i in range(900)))
    b = np.sort(np.r_[a[40:], partenum.mix(np.arange(50, dtype=np.uint64))])
    sizes, plain = [], partenum.mix
    monkeypatch.setattr(partenum, "mix", lambda x, seed=0: sizes.append(len(x)) or plain(x, seed))
    for level in range(len(partenum.LEVELS)):
        partenum.signatures(a, level)  # what depends on the seed alone is kept
        sizes.clear()
        met = np.intersect1d(partenum.signatures(a, level), partenum.signatures(b, level))
        assert len(met) > 0 and not {len(a), len(b)} & {*sizes} and len(sizes) == sum(len(partenum.bands(len(x))) for x in (a, b))
        assert len(np.intersect1d(partenum.signatures(a, level), partenum.signatures(plain(a), level))) == 0


def test_op10_groups(spark, monkeypatch):
    """Families of near copies around the threshold, with small bounds, so that every path is taken."""
    monkeypatch.setattr(partenum, "SMALL", 3)
    monkeypatch.setattr(partenum, "BLOCK_ITEMS", 1500)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, n = {}, 0
    for _ in range(3):
        base = [word() for _ in range(120)]
        for _ in range(50):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = word()
            docs[n], n = " ".join(w), n + 1
    shared = " ".join(word() for _ in range(50))
    for _ in range(40):
        docs[n], n = shared + " " + " ".join(word() for _ in range(40)), n + 1
    docs |= {n: "", n + 1: None, n + 2: "one", n + 3: "ONE ", n + 4: "a b c d e", n + 5: "a b c d e"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.join(df).collect()}
    assert got == brute_components(docs)
