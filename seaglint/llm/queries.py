"""Queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaglint.llm.alignment import alignment
from seaglint.llm.chunk_bpe import round_trip
from seaglint.llm.license_scan import license_scan
from seaglint.llm.disclosure import private_digest
from seaglint.llm.line_crf import quality_rules, train
from seaglint.llm.log_bilinear import language_scores
from seaglint.llm.mixing import fair_queue
from seaglint.llm.oracles import license_sql, mixing_sql, repeats_sql
from seaglint.llm.order_minhash import edited_fingerprints
from seaglint.llm.phrase_dedup import remove_repeats
from seaglint.llm.quality_qda import quality_scores
from seaglint.llm.simhash import fingerprints
from seaglint.llm.token_counts import token_counts
from seaglint.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op3_mixing": mixing_sql(),
    "op7_phrase_dedup": repeats_sql(),
}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark, folder):
    return license_scan(documents(spark, folder))


@query
def op2_order_minhash(spark, folder):
    return edited_fingerprints(documents(spark, folder))


@query
def op3_mixing(spark, folder):
    queue = fair_queue(documents(spark, folder))
    return queue.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op8_token_counts(spark, folder):
    counted = token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op9_chunk_bpe(spark, folder):
    coded = round_trip(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op5_line_crf(spark, folder):
    docs = documents(spark, folder)
    field = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    judged = quality_rules(docs, field)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")


@query
def op6_simhash(spark, folder):
    return fingerprints(documents(spark, folder))


@query
def op10_quality_qda(spark, folder):
    return quality_scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query
def op7_phrase_dedup(spark, folder):
    kept = remove_repeats(documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_log_bilinear(spark, folder):
    return language_scores(documents(spark, folder))


@query
def op11_pointer_alignment(spark, folder):
    return alignment(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_block_whitening(spark, folder):
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query
def op13_disclosure(spark, folder):
    return private_digest(documents(spark, folder))
