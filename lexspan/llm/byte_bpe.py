"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges, given as token ranks, are compiled on demand into a transducer over bytes.

* An encoding is right exactly if each of its tokens stands alone as one token and each pair of
  neighbours, merged from its bytes, gives that pair back. So for every prefix of the input there
  is one last token, and it is found from the last token of a shorter prefix.
* A state of the nondeterministic machine is one such prefix whose rest so far opens some token,
  with the tokens not yet emitted on the way to it. A state of the transducer is the set of these,
  all but what they have in common: that much is certain, and is emitted. What follows a certain
  border is encoded as if the input began there, so the state forgets what it has emitted. Only
  prefixes within the longest token's length can be open, so the lookahead is bounded.
* Transitions are made when first met and kept; the tables are cleared at a bound, also within a
  match, which costs time but changes nothing.

Decoding takes ids in pieces of any size and gives back text through an incremental UTF-8 machine:
a character may be spread over tokens and over pieces. Bytes that form no character become U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexspan.llm import safe_split
from lexspan.llm.common import retained, small

MAX_STATES = 150_000
MAX_PAIRS = 400_000
#: Bounds of the memo of words: a word of more characters is never kept, and all are dropped when they take more bytes than this,
#: of which every entry takes some beside its contents.
MEMO_WORD, MEMO_BYTES, MEMO_ENTRY = 24, 256 << 20, 320


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """The definition: join the neighbours of lowest rank, leftmost first, until none of a rank under ``below`` can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b, below) for a, b in pairwise(parts)]
        least = min(found)
        if least >= below:
            break
        best = found.index(least)
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """States are numbered as they are met; 0 is the start. A rank serves as the token's id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._child: dict[int, int] = {}  # node * 256 + byte: node, of the tree of all tokens
        self._token, self._inner = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self._child.get(node << 8 | byte)
                if below is None:
                    below = self._child[node << 8 | byte] = len(self._token)
                    self._token.append(-1)
                    self._inner.append(False)
                    self._inner[node] = True
                node = below
            self._token[node] = rank
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        start = ((0, ()),)
        self._ids = {start: 0}
        self._states = [start]
        # a state's moves: for a byte the moves of the state that it leads to, and what is emitted; at -1 the state's own number
        self._next: list[dict[int, Any]] = [{-1: 0}]

    def _made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes this one; of a byte, itself twice; of one that merges never make, None."""
        if token not in self._parts:
            whole = self.bytes_of[token]
            if len(whole) == 1:
                self._parts[token] = (token, token)
            else:
                below = merge_by_rank(whole, self.ranks, token)
                halves = [self.ranks[x] for x in below]
                self._parts[token] = (halves[0], halves[1]) if len(halves) == 2 else None
        return self._parts[token]

    def _fits(self, a: int, b: int) -> bool:
        """Whether the two stay apart as neighbours: no join across their border comes before both are made."""
        key = a << 32 | b
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > MAX_PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        bytes_of, ranks = self.bytes_of, self.ranks
        before = 1 << 60  # joins of a higher rank come too late to matter
        while True:
            joined = ranks.get(bytes_of[a] + bytes_of[b])
            if joined is not None and joined < before and self._made_of(joined) == (a, b):
                return False
            # undo the later of the two; of equal ones the right, as the leftmost join comes first
            for side in ("a", "b") if a > b else ("b", "a"):
                if side == "a" and len(bytes_of[a]) > 1:
                    before, a = a, self._made_of(a)[1]
                    break
                if side == "b" and len(bytes_of[b]) > 1:
                    before, b = b + 1, self._made_of(b)[0]
                    break
            else:
                return True

    def _step(self, state: int, byte: int) -> tuple[dict[int, Any], tuple[int, ...]]:
        """The transition: open prefixes grow by a byte; the one that closes a token opens anew."""
        child, tokens, inner = self._child, self._token, self._inner
        live, closed = [], None
        for node, path in self._states[state]:
            below = child.get(node << 8 | byte)
            if below is None:
                continue
            if closed is None:
                token = tokens[below]
                if token >= 0 and self._made_of(token) and (not path or self._fits(path[-1], token)):
                    closed = (*path, token)
            if inner[below]:
                live.append((below, path))
        if closed is None:
            raise ValueError(f"the ranks lack byte {byte}")
        live.append((0, closed))
        same, least = 0, min(len(p) for _, p in live)
        while same < least and all(p[same] == closed[same] for _, p in live):
            same += 1
        return self._next[self._number(tuple((n, p[same:]) for n, p in live))], closed[:same]

    def _number(self, state: tuple) -> int:
        found = self._ids.get(state)
        if found is None:
            found = self._ids[state] = len(self._states)
            self._states.append(state)
            self._next.append({-1: found})
        return found

    def _new_move(self, here: dict[int, Any], byte: int) -> tuple[dict[int, Any], tuple[int, ...]]:
        if len(self._states) >= MAX_STATES:  # only the state that the input is in lives on
            state = self._states[here[-1]]
            self._clear()
            here = self._next[self._number(state)]
        move = here[byte] = self._step(here[-1], byte)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern; a match that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        here = self._next[0]
        for byte in piece:
            move = here.get(byte)
            here, emitted = move if move is not None else self._new_move(here, byte)
            if emitted:
                out += emitted
        out += self._states[here[-1]][-1][1]  # the prefix that is the whole input comes last
        return out


class Encoder:
    """Ids of texts: the pattern's matches, each through the transducer. Words recur; their ids are kept, up to a bound."""

    _made: dict[tuple[str, str], Encoder] = retained()

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self._ids: dict[str, bytes] = {}
        self._decimals: dict[str, str] = {}
        self._held = 0
        size = max(ranks.values()) + 1
        tokens = [self.machine.bytes_of.get(i, b"") for i in range(size)]
        self._said = [str(i) for i in range(size)]
        self._flat = np.frombuffer(b"".join(tokens), np.uint8)
        self._length = np.array([len(x) for x in tokens], np.int64)
        self._start = np.cumsum(self._length) - self._length

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(load_ranks(path), pattern)
        return cls._made[path, pattern]

    def _word(self, word: str) -> tuple[bytes, str]:
        encode, said = self.machine.encode, self._said
        if word[1:].isalpha() and word[0] == " ":  # letters after a space are one match
            ids = encode(word.encode())
        else:
            ids = [i for m in self.pattern.findall(word) for i in encode(m.encode())]
        return array("I", ids).tobytes(), " ".join([said[i] for i in ids])

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The text's ids, as numbers and as decimals joined by spaces. Cuts at safe places leave the pattern's matches as they are."""
        if not text:
            return np.zeros(0, "<u4"), ""
        first, *rest = safe_split.words(text)
        if self._held > MEMO_BYTES:
            self._ids.clear()
            self._decimals.clear()
            self._held = 0
        ids, decimals = list(map(self._ids.get, rest)), list(map(self._decimals.get, rest))
        if None in ids:
            for i, found in enumerate(ids):
                if found is None:
                    ids[i], decimals[i] = self._kept(rest[i])
        head = self._word(first)
        return np.frombuffer(b"".join([head[0], *ids]), "<u4"), " ".join([head[1], *decimals])

    def _kept(self, word: str) -> tuple[bytes, str]:
        """Ids of a word after a space, from the memo or into it, if its bounds allow."""
        found = self._ids.get(word)
        if found is not None:
            return found, self._decimals[word]
        made = self._word(" " + word)
        if len(word) <= MEMO_WORD and self._held <= MEMO_BYTES:
            self._ids[word], self._decimals[word] = made
            self._held += MEMO_ENTRY + 4 * len(word) + len(made[0]) + len(made[1])
        return made

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, end to end."""
        n = self._length[ids]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        return self._flat[np.repeat(self._start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


#: The lead bytes of UTF-8, as (first, last, bytes that follow, bounds of the next byte).
_LEADS = (
    (0x00, 0x7F, 0, 0x80, 0xBF),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
_LEAD = {b: (n, lo, hi) for first, last, n, lo, hi in _LEADS for b in range(first, last + 1)}


class Utf8Stream:
    """Incremental decoding: the state is the bytes of a character that isn't whole yet."""

    def __init__(self) -> None:
        self._open = b""

    def feed(self, data: bytes) -> str:
        data = self._open + data
        cut = self._boundary(data)
        self._open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self._open = self._open, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _boundary(data: bytes) -> int:
        """Where the last character begins if the bytes after could still complete it; else the end."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            need, lo, hi = _LEAD.get(lead, (0, 0, 0))
            tail = data[len(data) - back + 1 :]
            if need >= back and (not tail or lo <= tail[0] <= hi):
                return len(data) - back
            break
        return len(data)


class StreamDecoder:
    """Bytes and text from ids that come in pieces."""

    def __init__(self, encoder: Encoder) -> None:
        self._encoder, self._utf8 = encoder, Utf8Stream()

    def feed(self, ids: np.ndarray) -> tuple[bytes, str]:
        data = self._encoder.bytes_of(ids)
        return data, self._utf8.feed(data)

    def finish(self) -> str:
        return self._utf8.finish()


#: Ids that the streaming decoder takes at a time.
FEED_IDS = 8192


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with token ids, and the text and bytes that the ids decode to, as digests and whole.

    Adds ``n_tokens`` long, ``ids`` array<int>, ``ids_sha256``, ``decoded`` string, ``decoded_sha256``
    and ``round_trip`` boolean; columns of ``df`` with these names give way. Null text counts as
    empty: no ids. Rows that repeat give the same values each. ``encode`` leaves the texts out,
    ``digests`` the ids too.
    """
    return _apply(df, path, pattern, text, ids=True, texts=True)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """As ``encode_decode``, without the text column and the decoded text."""
    return _apply(df, path, pattern, text, ids=True, texts=False)


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """As ``encode_decode``, without the ids and the text themselves, and without the text column."""
    return _apply(df, path, pattern, text, ids=False, texts=False)


def _apply(df: DataFrame, path: str, pattern: str, text: str, ids: bool, texts: bool) -> DataFrame:
    new = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * texts
    names = {f.name for f in new}
    kept = [c for c in df.columns if c not in names and (texts or c != text)]
    schema = T.StructType([df.schema[c] for c in kept] + new)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, pattern)
        for b in small(batches):
            out: dict[str, list] = {f.name: [] for f in new}
            for x in b.column(text).to_pylist():
                x = x or ""
                found, decimals = encoder.encode(x)
                data, back = hashlib.sha256(), []
                decoder = StreamDecoder(encoder)
                for i in range(0, len(found), FEED_IDS):
                    some, chars = decoder.feed(found[i : i + FEED_IDS])
                    data.update(some)
                    back.append(chars)
                back.append(decoder.finish())
                decoded = "".join(back)
                out["n_tokens"].append(len(found))
                out["ids_sha256"].append(hashlib.sha256(decimals.encode()).hexdigest())
                out["decoded_sha256"].append(data.hexdigest())
                out["round_trip"].append(decoded == x)
                if ids:
                    out["ids"].append(found.astype("i4"))
                if texts:
                    out["decoded"].append(decoded)
            columns = [b.column(c) for c in kept] + [pa.array(out[f.name], target.field(f.name).type) for f in new]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)
