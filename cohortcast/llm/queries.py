"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcast.llm import alignment, arrow_files, conversations, decontam, jaccard, langid, line_dedup, mixing, packing, pii, shard, sql, token_count, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, checking: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if checking is not None:
            ORACLES[name] = checking
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op2_vector_near_dedup", sql.VECTORS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"))


@query("op4_feistel_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_rows(table(spark, sf_dir, "documents"), shards=40)


@query("op5_ngram_jaccard", sql.JACCARD)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_texts(table(spark, sf_dir, "documents"), percent=90, words=3)


@query("op6_arrow_tokens")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_files.token_digest(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


@query("op7_byte_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def line_digest(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_line_dedup", sql.LINES)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10))


@query("op9_benchmark_passages", sql.PASSAGES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.digest(found).drop("n_near_items")


@query("op10_pii_spans", sql.PII)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(
        table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
    )


@query("op12_conversation_trie", sql.TRIE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_mix_sources", sql.MIX)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
