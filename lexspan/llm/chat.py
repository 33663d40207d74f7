"""Chat formatting at token level.

Each segment (a role, a text) is encoded by itself, and turns are marked by reserved ids that no text can
produce, spliced in between. Where each turn starts, and with it the loss mask, follows from prefix
sums of segment lengths. Control strings that occur in content are escaped all the same, so that the
formatted text, too, can be taken apart again.

A conversation stays a list of turns in order, not one row, so a very long one never has to fit in memory.

Null text or role counts as empty; rows with equal turn follow by role, then text, null first, and
repeated rows each count. A null conv_id is a conversation. Only the role "assistant" is learned from.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.llm.byte_bpe import load_ranks
from lexspan.llm.common import small

LEARNED = "assistant"

#: The reserved marks of the template, and the control strings of common templates.
TURN, SEP, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = (TURN, SEP, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<start_of_turn>", "<end_of_turn>")

_GUARD = "\u2060"  # stands after a control string's first character, once more for each time it is escaped


def _pattern(guards: str) -> re.Pattern[str]:
    """Control strings with guards in them: the first character, the guards, and whatever rest goes with that character, longest first."""
    rests = {c: sorted((re.escape(s[1:]) for s in CONTROL if s[0] == c), key=len, reverse=True) for c in sorted({s[0] for s in CONTROL})}
    return re.compile("|".join(f"(?<={re.escape(c)})({_GUARD}{guards})(?={'|'.join(r)})" for c, r in rests.items()))


_FOUND, _ESCAPED = _pattern("*"), _pattern("+")


def escape(text: str) -> str:
    """No control string is left; ``unescape`` gives the text back."""
    return _FOUND.sub(lambda m: m.group() + _GUARD, text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group()[1:], text) if _GUARD in text else text


class Codec:
    """One tokenizer with three ids more than its ranks, for the marks."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str) -> None:
        ranks = load_ranks(path)
        self.model = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.turn, self.sep, self.end = first, first + 1, first + 2

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode_turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Ids of a turn, and where its text starts and ends among them."""
        head = [self.turn, *self.model.encode_ordinary(escape(role)), self.sep]
        body = self.model.encode_ordinary(escape(text))
        return [*head, *body, self.end], len(head), len(head) + len(body)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode_bytes(ids).decode("utf-8")

    def render(self, ids: list[int]) -> str:
        """The formatted text, marks written out."""
        marks = {self.turn: TURN, self.sep: SEP, self.end: END}
        out, run = [], []
        for i in ids:
            if i in marks:
                out += [self.decode(run), marks[i]]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.decode(run)])


def format_turns(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, text, ids, token_start, loss_start, loss_end), in order within each conversation.

    ``ids`` is the turn's part of the conversation's ids and starts at ``token_start``; the ids of
    [loss_start, loss_end) of the conversation are learned from.
    """
    schema = "conv_id long, turn long, role string, text string, ids array<int>, head int, body int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for b in small(batches):
            found = [codec.encode_turn(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            columns = [b.column("conv_id").cast(pa.int64()), b.column("turn").cast(pa.int64()), b.column("role"), b.column("text"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "text", "ids", "head", "body"])

    order = ("turn", "role", "text")
    turns = df.select("conv_id", "turn", "role", "text").mapInArrow(run, schema).repartition("conv_id")
    before = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("token_start", F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0).cast("long")))
    learned = F.coalesce(F.col("role") == LEARNED, F.lit(False))
    turns = turns.select("conv_id", "turn", "role", "text", "ids", "token_start", F.when(learned, F.col("token_start") + F.col("head")).alias("loss_start"), F.when(learned, F.col("token_start") + F.col("body")).alias("loss_end"))
    return turns.sortWithinPartitions("conv_id", *order)


def read_back(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation, from the ids and the mask alone: its turns' digest, the learned text's, and sizes.

    ``turns`` is as ``format_turns`` returns it: a conversation's rows stand together, in order.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        state: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*done, strict=True) if done else [[]] * 6
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return made

        for b in small(batches):
            flat, ends = b.column("ids").values.to_numpy(), b.column("ids").offsets.to_pylist()
            for conv, i, j, start, lo, hi in zip(b.column("conv_id").to_pylist(), ends[:-1], ends[1:], *(b.column(c).to_pylist() for c in ("token_start", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if start != state[6]:
                    raise ValueError(f"conversation {conv}: a turn starts at {start}, not at {state[6]}")
                ids = flat[i:j].tolist()
                sep = ids.index(codec.sep)
                if ids[0] != codec.turn or ids[-1] != codec.end:
                    raise ValueError(f"conversation {conv}: a turn without its marks")
                role, text = codec.decode(ids[1:sep]), codec.decode(ids[sep + 1 : -1])
                learned = unescape(codec.decode(ids[lo - start : hi - start])) if lo is not None else ""
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(TURN) + len(role) + len(SEP) + len(text) + len(END)
                state[6] += len(ids)
            if done:
                yield flush()
        close()
        yield flush()

    return turns.select("conv_id", "ids", "token_start", "loss_start", "loss_end").mapInArrow(run, schema)
