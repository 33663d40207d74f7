"""Token counts: Arrow functions that return lengths only.

Long texts are cut at safe boundaries into blocks of bounded bytes, blocks of many rows are packed into
batches of about equal bytes, and each batch goes to the library in one call. Nothing is kept between
batches, so memory is that of one batch, or of one match of the pattern that can't be cut.

Null text counts as empty: 0 tokens. Repeated rows are counted each. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexspan.llm import safe_split
from lexspan.llm.common import small

BLOCK_BYTES = 1 << 16
BATCH_BYTES = 1 << 20


def n_bytes(x: str) -> int:
    return len(x) if x.isascii() else len(x.encode())


def packs(sizes: list[int], size: int = BATCH_BYTES) -> Iterator[slice]:
    """Stretches of items whose bytes add up to about ``size``; a larger item stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > size:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


class Counter:
    """Lengths of texts under one tokenizer file; made once for each Python worker."""

    _made: dict[str, Counter] = {}

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            import json
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._lengths = lambda xs: [len(e) for e in model.encode_batch_fast(xs, add_special_tokens=False)]
            said = json.loads(model.to_str())
            split = said["pre_tokenizer"] or {}
            plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and said["normalizer"] is None
            self._safe = bool(plain) and not any(safe_split.cut_through(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"])
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda xs: [len(e) for e in model.encode(xs, num_threads=1)]
            self._safe = False  # its pieces may depend on the start of the text

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def lengths(self, xs: list[str], block: int = BLOCK_BYTES) -> list[int]:
        row, pieces, sizes = [], [], []
        for i, x in enumerate(xs):
            n = n_bytes(x)
            cut = safe_split.blocks(x, max(1, block * len(x) // n)) if self._safe and n > block else [x]
            row += [i] * len(cut)
            pieces += cut
            sizes += [n] if len(cut) == 1 else map(n_bytes, cut)
        out = [0] * len(xs)
        for part in packs(sizes):
            for i, n in zip(row[part], self._lengths(pieces[part]), strict=True):
                out[i] += n
        return out


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512, bytes_col: str = "n_bytes", tokens_col: str = "n_tokens", over_col: str = "over_limit") -> DataFrame:
    """``df`` without its text column, with UTF-8 bytes, tokens and whether they exceed ``limit``.

    A column of ``df`` that has the name of a new one gives way to it.
    """
    kept = [c for c in df.columns if c not in (text, bytes_col, tokens_col, over_col)]
    fields = [df.schema[c] for c in kept] + [T.StructField(bytes_col, T.LongType()), T.StructField(tokens_col, T.LongType())]
    schema = T.StructType(fields)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for b in small(batches):
            xs = [x or "" for x in b.column(text).to_pylist()]
            columns = [b.column(c) for c in kept]
            columns += [pa.array([n_bytes(x) for x in xs], pa.int64()), pa.array(counter.lengths(xs), pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.select(*kept, text).mapInArrow(run, schema).withColumn(over_col, F.col(tokens_col) > limit)
