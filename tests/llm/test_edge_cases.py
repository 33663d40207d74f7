"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns whose names clash."""

import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspan.llm import byte_bpe, chat, common, fixity, license_rules, license_scan, media, mixing, partenum, safe_split, token_counts, toxicity, winnowing

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
LONG = "word " * 40_000 + "x" * 30_000
ROWS = [(1, "Hello world", "en", "a"), (1, "Hello world", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "mit license text", "en", None), (4, LONG, "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("score", F.lit("mine")).withColumn("n_tokens", F.lit("mine")).withColumn("norm", F.lit("mine"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license(odd, none):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == 6 and {r["norm"] for r in rows} == {"mine"}
    by = {r["doc_id"]: r for r in rows}
    assert (by[2]["n_words"], by[2]["n_base"], by[2]["first_word"], by[2]["labels"], by[2]["score"]) == (0, 0, None, "", 0.0)
    assert (by[None]["first_word"], by[None]["last_word"], by[None]["base_labels"]) == (0, 0, "mit")
    assert license_scan.scan(none).count() == 0


def test_license_suppression(spark):
    text = "Licensed under the Apache License, Version 2.0. All rights reserved. MIT License; mit license"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == "apache,apache-2.0,mit,proprietary"  # the shorter notices lie within the longer
    assert (r["n_base"], r["first_word"], r["last_word"]) == (3, 3, 13)
    assert len(license_rules.rules()) > 200


def test_counts(odd, none):
    rows = token_counts.count_tokens(odd, JSON).collect()
    assert sorted(r["n_bytes"] for r in rows) == sorted(len((x[1] or "").encode()) for x in ROWS)
    assert all(isinstance(r["n_tokens"], int) for r in rows)
    assert token_counts.count_tokens(none, JSON).count() == 0


LIBRARY = Tokenizer.from_file(JSON)
ODD = st.lists(st.sampled_from([*" ab\n\t'é漢字。，😀\x1c\x85\u3000 0!<|>.;한あ²½_", "<|endoftext|>", "don't", "'ll", "\n\n", "a1", "3.14"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_counts_like_the_library(x):
    t = token_counts.Counter.of(JSON)
    want = len(LIBRARY.encode(x, add_special_tokens=False))
    assert t.lengths([x]) == [want]
    assert t.lengths([x], block=3) == [want]  # however small the blocks
    assert "".join(safe_split.blocks(x, 5)) == x


def test_count_batches():
    sizes = [5, 5, 30, 1, 1, 9, 9]
    assert [sizes[p] for p in token_counts.packs(sizes, 11)] == [[5, 5], [30], [1, 1, 9], [9]]
    assert list(token_counts.packs([], 11)) == []
    for x in ("漢字かな混じり文。" * 5_000, "short line\n" * 9_000, "a1b2" * 9_000, "漢" * 50_000):
        assert token_counts.Counter.of(JSON).lengths([x]) == [len(LIBRARY.encode(x, add_special_tokens=False))]
    assert len(safe_split.blocks("漢字かな混じり文。" * 5_000, 4_096)) > 9 and len(safe_split.blocks("short line\n" * 9_000, 4_096)) > 20
    assert safe_split.cut_through("<a 1>") and not safe_split.cut_through("<|endoftext|>")


def test_bpe(odd, none):
    rows = byte_bpe.encode_decode(odd, RANKS, P.PATTERN).collect()
    assert {"ids"} == set(byte_bpe.encode(odd, RANKS, P.PATTERN).columns) - set(byte_bpe.digests(odd, RANKS, P.PATTERN).columns)
    assert all(r["round_trip"] and r["decoded"] == (r["text"] or "") and len(r["ids"]) == r["n_tokens"] for r in rows)
    assert byte_bpe.digests(none, RANKS, P.PATTERN).count() == 0


def test_bpe_like_the_library():
    e = byte_bpe.Encoder.of(RANKS, P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(3)
    samples = ["".join(rng.choice("abe  \n\t'st!0é漢😀́\xa0ing theA<|") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for x in [*samples, " " * 3000, "the" * 3000, "é" * 2000, LONG]:
        ids, text = e.encode(x)
        assert ids.tolist() == t.encode_ordinary(x) and text == " ".join(map(str, ids))


def test_bpe_bounds(monkeypatch):
    """Tables that are cleared within a match, and a memo that holds next to nothing, change no id."""
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 20)
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 2_000)
    e = byte_bpe.Encoder(byte_bpe.load_ranks(RANKS), P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(6)
    for x in ["".join(rng.choice("etaoinshrdlu") for _ in range(5_000)), "the cat " * 300, "漢字" * 500]:
        assert e.encode(x)[0].tolist() == t.encode_ordinary(x)
        assert len(e.machine._states) <= 21 and len(e._ids) <= 7


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=12))
def test_utf8_stream(data, sizes):
    s, out, at = byte_bpe.Utf8Stream(), "", 0
    for n in [*sizes, len(data)]:
        out, at = out + s.feed(data[at : at + n]), at + n
    assert out + s.finish() == data.decode("utf-8", "replace")


def test_media(odd, none):
    rows = media.round_trip(odd).collect()
    assert len(rows) == 6
    assert {r["payload_bytes"] for r in rows if r["n_bytes"] == 0} == {64}
    assert media.round_trip(none).count() == 0


def test_media_cuts():
    rng = random.Random(1)
    data = rng.randbytes(200_000)
    assert b"".join(media.chunks(data)) == data
    tail = set(media.chunks(data)[2:])
    assert len(tail & set(media.chunks(b"new head" + data))) >= len(tail) - 3  # cuts follow the content
    assert media.samples_of(media.store_form(b"abc" * 20)) == b"abc" * 20


def _replica(rows):
    """(file_id, record_offset, data) of (file_id, data), by the rule that pack follows."""
    out, ends = [], {}
    name = lambda d: hashlib.md5(d.split(b"urn:page:")[1].split(b">")[0]).hexdigest() if b"urn:page:" in d else hashlib.md5(b"").hexdigest()
    for f, d in sorted(rows, key=lambda r: (r[0], name(r[1]), hashlib.sha256(r[1]).hexdigest())):
        out.append((f, ends.get(f, 0), bytearray(d)))
        ends[f] = ends.get(f, 0) + len(d)
    return out


def _warc(i, html="<p>x</p>"):
    return f"WARC/1.0\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()


REPLICA = "file_id long, record_offset long, data binary"


def test_fixity(spark):
    """Each kind of fault, one long record, one id twice, and a file that only one replica has."""
    ours = {i: (i % 3, _warc(i, f"<p>{i}</p>" * (1 if i != 9 else 60_000))) for i in range(90)}
    theirs = dict(ours)
    theirs[7] = (1, ours[7][1][:-5])  # shorter: what follows it shifts
    theirs[8] = (2, ours[8][1].replace(b"<p>", b"<q>"))
    theirs[9] = (0, ours[9][1][:100_000] + b"?" + ours[9][1][100_001:])
    theirs[10] = (2, ours[10][1])
    del theirs[11]
    theirs[500] = (0, _warc(500))
    theirs[501] = (5, _warc(501))
    theirs["b"] = (1, b"no record at all")
    a, b = (spark.createDataFrame(_replica(x.values()), REPLICA) for x in (ours, theirs))
    twice = [(0, _warc(600, "one")), (0, _warc(600, "two"))]
    b2 = spark.createDataFrame(_replica([*theirs.values(), twice[0]]), REPLICA)
    rows = fixity.audit(a, b).collect()
    by = {r["record_id"]: r for r in rows}
    assert {k: r["status"] for k, r in by.items() if r["status"] != "intact"} == {"7": "damaged", "8": "damaged", "9": "damaged", "10": "moved", "11": "missing", "500": "extra", "501": "extra", "": "extra"}
    assert len(rows) == 93 and (by["10"]["file_id"], by["10"]["replica_file_id"]) == (1, 2)
    assert [by[k]["well_formed"] for k in ("7", "8", "9", "11", "")] == [False, True, True, None, False]
    place = {bytes(d): (f, at) for f, at, d in _replica(x for x in theirs.values())}
    assert all((r["replica_file_id"], r["replica_offset"]) == place[theirs[int(k)][1]] for k, r in by.items() if k and r["status"] != "missing")
    a2 = spark.createDataFrame(_replica([*ours.values(), *twice]), REPLICA)
    assert sorted((r["record_sha256"] == hashlib.sha256(twice[0][1]).hexdigest(), r["status"]) for r in fixity.audit(a2, b2).collect() if r["record_id"] == "600") == [(False, "missing"), (True, "intact")]
    same = fixity.audit(a, a).collect()
    assert {r["status"] for r in same} == {"intact"} and all(r["root_sha256"] == r["replica_root_sha256"] for r in same)
    assert fixity.audit(a.limit(0), b.limit(0)).count() == 0
    assert {r["status"] for r in fixity.audit(a.limit(0), b).collect()} == {"extra"} and {r["status"] for r in fixity.audit(a, b.limit(0)).collect()} == {"missing"}


def test_fixity_tree(spark):
    """Roots by a plain recursion over the bytes, and offsets that are part of the hashes."""
    rows = _replica([(0, _warc(i)) for i in range(40)])

    def node(found, digits):
        if digits > fixity.LEVELS:
            ((at, d),) = found
            return at, hashlib.sha256(d).hexdigest(), at + len(d)
        below = {}
        for at, d in found:
            path = hashlib.md5(bytes(d).split(b"urn:page:")[1].split(b">")[0]).hexdigest()
            below.setdefault((path[:digits], at) if digits > fixity.LEVELS - 1 else path[: digits + 1], []).append((at, d))
        parts = sorted(node(x, digits + 1) for x in below.values())
        start, end = parts[0][0], max(p[2] for p in parts)
        return start, hashlib.sha256((",".join(f"{h}:{s - start}:{e - s}" for s, h, e in parts) + f"|{end - start}").encode()).hexdigest(), end

    root = lambda rows: fixity.tree(fixity.leaves(spark.createDataFrame(rows, REPLICA))).first()["root"].hex()
    assert root(rows) == node([(at, d) for _, at, d in rows], 0)[1]
    assert root([(f, at + (i > 20), d) for i, (f, at, d) in enumerate(rows)]) != root(rows)  # a gap of one byte
    assert root([(f, at + 7, d) for f, at, d in rows]) == root(rows)  # the whole file shifted


def test_fixity_pages(spark):
    """Nulls, repeated rows and other columns of pages."""
    rows = [(i, f"u{i}", f"<p>{i}</p>", "mine") for i in range(300)] + [(None, None, None, "mine")] * 3 + [(5, "u5", "other", "mine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, data string")
    found = fixity.audited(pages, per_file=64).collect()
    assert [r["copies"] for r in found if r["record_length"] and r["page_id"] is None] == [3]
    assert sum(1 for r in found if r["page_id"] == 5 and r["record_length"]) == 2
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:6], 16)
    want = lambda d: "missing" if d % 211 == 5 else "damaged" if d % 101 == 7 or d % 103 == 9 else "moved" if d % 223 == 6 else "intact"
    assert all(r["status"] == want(draw(r["page_id"])) for r in found if r["page_id"] is not None)
    assert {r["status"] for r in found} >= {"missing", "damaged", "intact"}
    assert len({r["file_id"] for r in found if r["file_id"] is not None}) == 5
    assert fixity.audited(pages.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "|im_end|>", "|>", "[INST]", "[", "/INST]", "</s>", "<s>", "⁠", "<<SYS>>", "a", " "]), max_size=12))
def test_escapes(parts):
    x = "".join(parts)
    e = chat.escape(x)
    assert chat.unescape(e) == x and not any(c in e for c in chat.CONTROL)


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|turn|>"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0), RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


def test_chat_long_and_clashing(spark):
    long = "<|turn|> [INST] word " * 20_000
    rows = [(1, i, "assistant" if i % 2 else "user", x, 9, "mine") for i, x in enumerate(["hi", long, None, "⁠", "<⁠|turn|>"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids long, head string")
    turns = chat.format_turns(df, RANKS, P.PATTERN)
    r = chat.read_back(turns, RANKS, P.PATTERN).first()
    learned = long + "⁠"
    assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    shown = "".join(f"{chat.TURN}{x[2]}{chat.SEP}{chat.escape(x[3] or '')}{chat.END}" for x in rows)
    assert r["formatted_chars"] == len(shown)
    codec = chat.Codec.of(RANKS, P.PATTERN)
    assert codec.render([i for t in turns.orderBy("turn").collect() for i in t["ids"]]) == shown


def test_mixing_clashes_and_shared_ids(spark):
    rows = [(None if i % 2 else 7, f"w{i} " * 3, "s", i, 1, "x") for i in range(2000)] + [(i, "w " * 9000, "t", i, 1, "x") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, of long, mix_times long, mix_copy string")
    got = mixing.repeated(df)
    assert got.columns == df.columns
    by = {r["source"]: r for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert abs(by["s"]["taken"] - by["s"]["target"]) <= 60  # shared ids, and yet near the target
    assert got.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == sum(r["taken"] for r in by.values())


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 6 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(odd).columns == odd.columns
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), "s" + str(min(i % 9, 3))) for i in range(4000)], "doc_id long, text string, source string")
    by = mixing.mix(many).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 7 for r in by)


def test_mixing_divides_repeated_rows(spark):
    """A source, null too, that is one repeated row meets its target by rows, of which equal ones may differ in other columns."""
    rows = [(5, "one two three", "a", i) for i in range(3001)] + [(6, "w " * 11, None, i) for i in range(1500)] + [(i, "x " * 9, "b", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(7)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        mine = by.setdefault(r["source"], [0, r["target"]])
        mine[0] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert set(by) == {"a", "b", None}
    assert all(abs(taken - target) <= size / 2 for (taken, target), size in ((by["a"], 3), (by[None], 11), (by["b"], 9)))
    again = mixing.repeated(df)
    assert again.columns == df.columns
    size = {"a": 3, None: 11, "b": 9}
    assert {r["source"]: r["count"] * size[r["source"]] for r in again.groupBy("source").count().collect()} == {k: v[0] for k, v in by.items() if v[0]}
    assert mixing.mix(df).groupBy("doc_id", "taken").count().orderBy("doc_id", "taken").collect() == mixing.mix(df.repartition(3)).groupBy("doc_id", "taken").count().orderBy("doc_id", "taken").collect()


def test_fixity_copies_leave_a_task_once(spark, monkeypatch):
    def batch(rows):
        return pa.RecordBatch.from_pylist([{"file_id": f, "path": p, "sha": d, "data": d * 9, "copies": c} for f, p, d, c in rows])

    given = [[(1, "p", b"a", 1), (1, "p", b"a", 2), (1, "q", b"b", 1)], [(1, "p", b"a", 4), (2, "p", b"a", 1)], [], [(1, "q", b"b", 1), (1, "p", b"a", 1)]]
    for most in (100_000, 2):
        monkeypatch.setattr(fixity, "MET_RECORDS", most)
        out = [r for b in fixity._collapsed(iter([batch(x) if x else batch(given[0]).slice(0, 0) for x in given])) for r in b.to_pylist()]
        sums = {}
        for r in out:
            key = r["file_id"], r["path"], r["sha"]
            sums.setdefault(key, [0, set()])
            sums[key][0] += r["copies"]
            sums[key][1].add(r["data"])
        assert {k: v[0] for k, v in sums.items()} == {(1, "p", b"a"): 8, (1, "q", b"b"): 2, (2, "p", b"a"): 1}
        assert all(v[1] - {None} == {k[2] * 9} for k, v in sums.items())
    assert list(fixity._collapsed(iter([]))) == []


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, labels).count() == 0
    x = dict(zip(toxicity.NAMES, toxicity.features("You IDIOT!! you id1ot", toxicity.Lexicon({"idiot": 2.0}, {})), strict=True))
    assert x["insults"] == 50.0 and x["second"] == 50.0 and x["near_second"] == 50.0 and x["obfuscated"] == 0.25 and x["shouted"] == 0.25
    assert toxicity.features("", toxicity.Lexicon({}, {})) == [0.0] * len(toxicity.NAMES)


def test_toxicity_labels(spark):
    """Labels of held-out rows never matter; conflicting labels are both used; columns may have any name."""
    rng = random.Random(8)
    text = lambda bad: " ".join(rng.choice(["you idiot", "stupid clown", "hate"] if bad and rng.random() < 0.4 else ["plain", "words", "of", "prose", "here"]) for _ in range(30))
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t, _ in rows], "doc_id long, text string, score string, features string")
    labels = lambda flip: spark.createDataFrame([(i, 1, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    one, two = ({r["doc_id"]: (r["score"], r["held_out"]) for r in toxicity.score(docs, labels(f)).collect()} for f in (False, True))
    assert one == two and sum(h for _, h in one.values()) > 100
    held = [(one[i][0] >= 0.3) == bool(y) for i, _, y in rows if one[i][1]]
    assert sum(held) / len(held) > 0.95


def test_winnowing_ties(spark):
    """Shared and missing ids are divided among ranges; every row still gets its successor."""
    rows = [(i % 3 if i % 4 else None, f"text number {i % 40} " * 3) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), -tie[r[1]], r[1]))
    want = sorted((str(a[0]), hashlib.sha256(winnowing.edited_text(a[1], b[1]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True))
    dealt = winnowing.with_next(df, 9)
    got = dealt.mapInArrow(lambda bs: (p.rename_columns(winnowing._NAMES).select(["doc_id", "edited_sha256"]) for p in winnowing._pairs(bs)), "doc_id long, edited_sha256 string")
    assert sorted((str(r[0]), r[1]) for r in got.collect()) == want
    assert dealt.select(F.spark_partition_id().alias("p"), "range").distinct().groupBy("p").count().filter("count > 1").count() == 0


def test_winnowing(spark, odd, none):
    rows = winnowing.edits(odd).collect()
    assert len(rows) == 6
    assert winnowing.edits(none).count() == 0
    alone = winnowing.edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdef") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    noise = lambda n: "".join(rng.choice("ghijkl") for _ in range(n))
    a, b = (set(winnowing.winnow(noise(200) + shared + noise(90))[0].tolist()) for _ in range(2))
    assert a & b  # the guarantee


def test_winnowing_short(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(n)) for n in range(1, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["near_edited"] > 0 for r in winnowing.edits(docs).collect())
    for x in texts:  # the half that an edit keeps, whatever follows it
        for following in ("", "z", "zzzz", "z" * 200):
            assert winnowing.likeness(winnowing.winnow(x)[0], winnowing.winnow(winnowing.edited_text(x, following))[0]) > 0
    hashes, positions = winnowing.winnow(texts[-1])
    read = [(int(w[:8], 16), int(w[8:], 16)) for w in winnowing.written(hashes, positions).split(" ")]
    assert [h for h, _ in read] == hashes.tolist() and np.cumsum([g for _, g in read]).tolist() == positions.tolist()


def test_jaccard_links(spark, odd, none):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(90):  # a family of near copies, some linked and some not, larger than SMALL
        words = base.copy()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = f"x{i}"
        docs.append(" ".join(words))
    docs += [" ".join(f"y{j}" for j in range(40)), " ".join(f"y{j}" for j in range(42)), "", "one", "one"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    sets = [set(partenum.shingles(x).tolist()) for x in docs]
    linked = [[i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    each, pairs = partenum.links(df)
    node = {r["doc_id"]: r["node"] for r in each.collect()}
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert found == {(node[i], node[j]) for i in node for j in node if linked[i][j] and node[i] < node[j]}
    assert {r["doc_id"]: r["n_links"] for r in partenum.link_counts(df).collect()} == {i: sum(x) for i, x in enumerate(linked)}
    assert partenum.link_counts(odd).count() == 6 and partenum.link_counts(none).count() == 0


def test_jaccard_tie_of_long_texts():
    both = 1_491_316  # 180 times this isn't a float32, and rounds down
    x, y = np.arange(both), np.arange(both * 9 // 4 - both)
    items = pa.ListArray.from_arrays(pa.array([0, len(x), len(x) + len(y)], pa.int32()), pa.array(np.concatenate([x, y])))
    assert both * 100 == 80 * len(y)
    for first in ([True, True], [True, False], [False, True]):
        found = partenum._compare(pa.table({"node": pa.array([1, 2], pa.int64()), "items": items, "first": pa.array(first)}))
        assert [set(r.values()) for r in found.to_pylist()] == [{1, 2}]


@pytest.mark.parametrize("level", range(len(partenum.LEVELS)))
def test_jaccard_signatures(level):
    """Sets at the threshold share a signature at each level, whatever their size."""
    rng = random.Random(level)
    for n in [*range(1, 40), 63, 64, 65, 100, 127, 128, 129, 400, 1000]:
        for _ in range(8):
            one = rng.sample(range(1 << 60), n)
            gone = rng.randint(0, n // 9)
            new = rng.randint(0, n // 5)
            a, b = np.array(sorted(one), np.uint64), np.array(sorted(one[gone:] + rng.sample(range(1 << 60), new)), np.uint64)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(partenum.signatures(a, level), partenum.signatures(b, level)))


def test_jaccard_sketches():
    """No linked pair is ruled out, and most that are a little below the threshold are."""
    rng = random.Random(11)
    out = 0
    for n in [*range(1, 30), 63, 64, 65, 200, 900]:
        for share in (0.8, 0.81, 0.6):
            both = [rng.getrandbits(64) for _ in range(n)]
            more = int(n / share) - n
            cut = rng.randint(0, more)
            a, b = np.unique(np.array(both + [rng.getrandbits(64) for _ in range(cut)], np.uint64)), np.unique(np.array(both + [rng.getrandbits(64) for _ in range(more - cut)], np.uint64))
            linked = 100 * n >= 80 * (len(a) + len(b) - n)
            found = partenum.may_link(partenum.sketch(a), partenum.sketch(b), (len(a), len(b)))
            assert found or not linked
            out += not found
    assert out > 25


def test_components(spark, monkeypatch):
    """A star, a path and a ring; the star's centre counts as a node with very many edges."""
    monkeypatch.setattr(partenum, "HOT", 3)
    monkeypatch.setattr(partenum, "FEW", 50)
    star = [(5, 100 + i) for i in range(400)]
    path = [(1000 + i, 1001 + i) for i in range(60)]
    ring = [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    df = spark.createDataFrame(star + path + ring + ring, "a long, b long")
    got = {r["node"]: r["comp"] for r in partenum.components(df).collect()}
    assert got == {x: 5 if x < 1000 else 1000 if x < 2000 else 2000 for pair in star + path + ring for x in pair}
    assert partenum.components(df.limit(0)).count() == 0


def test_staging(spark, tmp_path, monkeypatch):
    """Off one machine a shared folder must be named; tables that nobody reads any more are deleted; a session's settings stay."""
    made = []
    df = common.staged(spark.range(5), "test", made)
    assert df.count() == 5
    common.discard(spark, made)
    assert made == [] and not list(Path(common.shared_dir(spark).removeprefix("file://")).rglob("test-*"))

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        common.shared_dir(Elsewhere)
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    common.table(spark, "/root/testdata/sf0.001", "documents").count()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    batch = pa.record_batch({"x": pa.array(["a" * 1000] * 10)})
    assert [b.num_rows for b in common.small(iter([batch, batch.slice(0, 0)]), rows=4)] == [4, 4, 2]
    assert [b.num_rows for b in common.small(iter([batch]), size=2500)] == [2] * 5


def test_representatives(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (2, b), (2, a + " z"), (None, a + " y"), (None, b + " y"), (3, ""), (None, "alone"), (None, "alone"), (4, "same id"), (4, "same id, other text")]
    kept = partenum.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, a), (2, b), (3, ""), (None, "alone"), (4, "same id"), (4, "same id, other text")]  # the last two are linked with nothing
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_jaccard(odd, none):
    rows = {r["doc_id"]: r for r in partenum.join(odd).collect()}
    assert (rows[2]["n_shingles"], rows[2]["component_id"]) == (0, 2) and rows[1]["component_id"] == 1
    assert partenum.join(none).count() == 0
    kept = partenum.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == 5


def test_staged_tables_leave_no_shuffle_files(spark, tmp_path):
    """A staged table's shuffle files are deleted when it is written, not when the driver collects its garbage."""
    from lexspan.staging import CLEANUP, staged

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folder.getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(CLEANUP)
    made = staged(spark.range(50_000).repartition(8, "id"), "shuffled")
    assert spark.conf.get(CLEANUP) == setting
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert made.count() == 50_000


def test_a_worker_keeps_one_operators_tables(spark):
    """Near duplicates drop the encoder that a stage before has left in the worker."""
    encoder = byte_bpe.Encoder.of(RANKS, P.PATTERN)
    assert byte_bpe.Encoder._made and encoder
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "k1": [1], "k2": [1], "text": ["a b c d e f"]})
    assert [b.num_rows for b in partenum._describe(iter([rows]))] == [1]
    assert not byte_bpe.Encoder._made


def test_sets_that_share_common_lines_alone_are_not_compared_in_blocks(spark, monkeypatch):
    """Texts of common lines and of words of their own meet in large buckets of both levels, but not by their rare elements; copies still link."""
    monkeypatch.setattr(partenum, "SMALL", 4)
    rng = random.Random(4)
    lines = [" ".join(f"line{i}word{j}" for j in range(40)) for i in range(3)]
    docs = [" ".join([*lines, *(f"own{i}x{rng.random()}" for _ in range(60))]) for i in range(60)]
    docs += [docs[0] + " more", docs[30] + " other"]
    tied, plain = [], partenum._blocks
    monkeypatch.setattr(partenum, "_blocks", lambda ties, *rest: tied.append(ties.count()) or plain(ties, *rest))
    found = {r["doc_id"]: r["component_id"] for r in partenum.join(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert not sum(tied)
    assert found == {**{i: i for i in range(60)}, 60: 0, 61: 30}


def test_blocks_meet_in_rounds(spark, monkeypatch):
    """What a round copies is bounded, and all rounds together find what one finds."""
    monkeypatch.setattr(partenum, "BLOCK_SETS", 4)
    texts = [(i, " ".join(f"w{i // 8}x{j}" if j else f"z{i}" for j in range(30))) for i in range(40)]
    df = spark.createDataFrame(texts, "node long, text string")
    ties = df.filter("node > 0").select(F.lit(0).cast("long").alias("a"), F.col("node").alias("b"))
    rounds, plain = [], partenum.staged
    monkeypatch.setattr(partenum, "staged", lambda d, tag, made=None: rounds.append(tag) or plain(d, tag, made))
    got = {}
    for most in (1, 1 << 30):
        made: list[str] = []
        rounds.clear()
        links = partenum._blocks(ties, None, df, made, most)
        assert (rounds.count("forest") > 1) == (most == 1)
        got[most] = {(r["node"], r["comp"]) for r in partenum.components(links, made).collect()}
    assert got[1] == got[1 << 30] == {(i, i // 8 * 8) for i in range(40)}
