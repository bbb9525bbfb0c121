"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import decode_ids, encode_texts
from tidemark.llm.decontamination import contamination_report
from tidemark.llm.divergence import oracle as divergence_sql
from tidemark.llm.divergence import source_divergence
from tidemark.llm.licenses import oracle as licenses_sql
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.lm_scoring import score_documents
from tidemark.llm.mixing import mix
from tidemark.llm.near_duplicates import near_duplicate_report
from tidemark.llm.pii import find_pii
from tidemark.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_heads
from tidemark.llm.prefix_trie import oracle as prefix_trie_sql
from tidemark.llm.quality import quality_report
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.token_output import encode_documents, read_tokens
from tidemark.llm.topk_search import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = decode_ids(encode_texts(_table(spark, sf_dir, "documents"), ranks), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie(with_shared_heads(turns, family=5, lengths=9))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


QUERIES = {f.__name__: f for f in (op1_token_output, op2_mixing, op3_topk_search, op4_decontamination, op5_quality, op6_token_counts, op7_licenses, op8_ngram_jaccard, op9_lm_scoring, op10_pii, op11_byte_bpe, op12_prefix_trie, op13_source_divergence)}

ORACLE_SQL: dict[str, str] = {"op7_licenses": licenses_sql(), "op12_prefix_trie": prefix_trie_sql(), "op13_source_divergence": divergence_sql()}
