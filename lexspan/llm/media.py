"""Media columns: content-defined chunks of payloads, deduplicated by joins, and media rebuilt from ordered chunk lists.

A payload is stored as the samples of an 8-bit mono wave file. A rolling gear hash over the stored bytes
sets the cuts, so equal stretches of different media give equal chunks. The chunk store has each digest
once, whichever rows it came from; a medium is the ordered list of its digests. Reading back joins the
lists with the store, puts the chunks in order, and checks the digest of the whole.

Equal payloads are one medium, however many rows have it; media of one chunk, the most, are rebuilt where
the join leaves them. Null text is an empty payload of 64 zeros. Repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import small, staged

PAD = 64
LEAST, MOST, MASK = 4096, 65536, (1 << 13) - 1  # chunk sizes: at least, at most, and about 8 KB on from the least
MET_DIGESTS = 200_000
RATE = 8000


def _gears() -> np.ndarray:
    """A number for each byte, drawn from its digest."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


_GEARS = _gears()


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def store_form(samples: bytes) -> bytes:
    """A wave file of these samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a wave file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a wave file without samples")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The hash at a byte is that of the 32 bytes up to it: older ones have been shifted out."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _GEARS[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:  # spans are doubled: that of the older half is shifted by the newer half's length
        newer = h.copy()
        newer[span:] += h[:-span] << np.uint32(span)
        h, span = newer, span * 2
    marks = np.flatnonzero((h >> np.uint32(19)) & np.uint32(MASK) == 0) + 1
    ends, start = [], 0
    while n - start > LEAST:
        i = np.searchsorted(marks, start + LEAST)
        end = min(int(marks[i]) if i < len(marks) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in cuts(data):
        out.append(data[start:end])
        start = end
    return out


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:20]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        n, sha, lists = [], [], []
        for x in b.column("text").to_pylist():
            media = store_form(payload(x))
            n.append(len((x or "").encode()))
            sha.append(hashlib.sha256(media).hexdigest())
            lists.append([_digest(c) for c in chunks(media)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, packed), without those that this task has just had."""
    packer, met = zstandard.ZstdCompressor(level=5, write_checksum=False), set()
    for b in small(batches):
        digests, packed = [], []
        for x in b.column("text").to_pylist():
            for c in chunks(store_form(payload(x))):
                d = _digest(c)
                if d in met:
                    continue
                if len(met) >= MET_DIGESTS:
                    met.clear()
                met.add(d)
                digests.append(d)
                packed.append(packer.compress(c))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["digest", "packed"])


def manifest(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, digests) of texts: the medium's SHA-256 and its ordered chunk list."""
    return df.select("doc_id", "text").mapInArrow(_describe, "doc_id long, n_bytes long, media string, digests array<binary>")


def chunk_store(df: DataFrame) -> DataFrame:
    """(digest, packed): each distinct chunk once, compressed."""
    return df.select("text").mapInArrow(_chunk_rows, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))


def feature(samples: bytes) -> str:
    """What the samples look like: level, spread, crossings of the middle, and how the values are spread over 16 bands."""
    x = np.frombuffer(samples, np.uint8)
    level = x.astype(np.float64) - 128.0
    crossings = int(np.count_nonzero(np.diff(level >= 0)))
    share = np.bincount(x >> 4, minlength=16) / len(x)
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"mean={level.mean():.4f};rms={np.sqrt((level**2).mean()):.4f};zcr={crossings / len(x):.5f};entropy={entropy:.4f};bands=" + ",".join(f"{s:.4f}" for s in share)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Media of rows (media, place, of, digest, packed) that come in order; the result is read from the rebuilt bytes."""
    unpacker = zstandard.ZstdDecompressor()
    parts: list[bytes] = []
    for b in small(batches):
        out: list[tuple] = []
        for media, place, of, packed in zip(*(b.column(c).to_pylist() for c in ("media", "place", "of", "packed")), strict=True):
            if place != len(parts):
                raise ValueError(f"medium {media} lacks chunk {len(parts)}")
            parts.append(unpacker.decompress(packed))
            if len(parts) < of:
                continue
            whole, parts = b"".join(parts), []
            found = hashlib.sha256(whole).hexdigest()
            if found != media:
                raise ValueError(f"medium {media} was rebuilt as {found}")
            samples = samples_of(whole)
            out.append((media, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(whole), found, feature(samples)))
        if out:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def round_trip(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): sizes, digests and features of its medium, read back from the chunk store."""
    rows = staged(manifest(df), "manifest")
    store = chunk_store(df)
    lists = rows.groupBy("media").agg(F.first("digests").alias("digests"))
    places = lists.select("media", F.size("digests").alias("of"), F.posexplode("digests").alias("place", "digest"))
    met = places.join(store, "digest")
    made = "media string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    single = met.filter("of = 1").mapInArrow(_rebuilt, made)
    multiple = met.filter("of > 1").repartition("media").sortWithinPartitions("media", "place").mapInArrow(_rebuilt, made)
    read = staged(single.unionByName(multiple), "media")
    return rows.select("doc_id", "n_bytes", "media").join(read, "media", "left").drop("media")
