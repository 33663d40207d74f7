"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexspan.llm import byte_bpe, chat, drake, fixity, license_scan, media, mixing, partenum, secret_scan, token_counts, toxicity, vector_codes, winnowing
from lexspan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).drop("detections")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a WARC file, audited against a replica with damaged, missing, extra and moved records."""
    return fixity.audited(table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    return chat.read_back(chat.format_turns(talks.unionByName(extra), path, pattern), path, pattern)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("source")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digested(secret_scan.scan(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN))


def op12_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.report(drake.cluster(table(spark, sf_dir, "embeddings")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


_ALL = [op1_license_scan, op2_token_counts, op3_media_chunks, op4_warc_fixity, op5_chat_format, op6_source_mix, op7_byte_bpe, op8_toxicity, op9_winnowing, op10_ngram_jaccard]
_ALL += [op11_secret_scan, op12_drake_clusters, op13_vector_codes]
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op1_license_scan": license_scan.oracle(), "op4_warc_fixity": fixity.oracle(), "op6_source_mix": mixing.oracle(), "op12_drake_clusters": drake.oracle(), "op13_vector_codes": vector_codes.oracle()}
