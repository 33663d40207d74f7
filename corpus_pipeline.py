"""The corpus pipeline: documents to token ids, in stages that are each written as Parquet and read again.

toxicity        documents that the classifier rejects go;
near_duplicates one document of each component of the n-gram Jaccard join stays, the least doc_id;
mix             each document comes as often as the mix of sources takes it, up to twice or not at all;
byte_bpe        each text's ids, and whether they decode to it.

All but the last stage return the columns of documents. Null texts pass the first three stages as
empty texts do: not toxic by content, linked with nothing; of size 0, so the mix takes none of them.
The second stage goes by rows: of a component one row stays, whatever ids are shared; a row with a null doc_id only if
no other row of the component has one. Repeated rows with empty texts are one document.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import byte_bpe, mixing, partenum, toxicity
from lexspan.llm.common import discard, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below the threshold, scored in one pass over whole texts."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = max(docs.columns, key=len) + "_score"  # longer than any column's
    return model.scored(docs, docs.columns, name=name).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts the document with the least doc_id; empty texts all stay."""
    return partenum.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256, round_trip."""
    return byte_bpe.encode(docs.select("doc_id", "source", "text"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [("toxicity", not_toxic), ("near_duplicates", one_of_each), ("mix", mixed), ("byte_bpe", encoded)]

#: A trained classifier can't be said in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        made: list[str] = []
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", made)
        discard(spark, before)
        before = made
    return docs
