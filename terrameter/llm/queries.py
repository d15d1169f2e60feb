"""One query for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dual_tree, embedding_dedup, exact_dedup, importance, language_id, mixing, quality_classifier, quality_rules, secret_scan, simhash, token_counts
from .sentencepiece_codec import encode_documents
from .text import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record")
    records = rows.unionByName(extra).select("conv_id", "turn", record)
    return chat.conversation_digests(chat.format_records(records, ["conv_id", "turn"], "record"), "conv_id", ["turn", "role", "text"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.length_table(token_counts.token_lengths(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_report(_table(spark, sf_dir, "documents"), secret_scan.train())


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return rows.select("*", (~quality_rules.keeps("base-1")).alias("base_failed"), quality_rules.keeps("full-1").alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("shares").alias("n_languages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return quality_classifier.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), plan=importance.Plan(of_fit=True))


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_mix_sources, op2_chat_format, op3_token_counts, op4_secret_scan, op5_embedding_dedup,
        op6_quality_rules, op7_language_id, op8_sentencepiece, op9_simhash_dedup, op10_quality_classifier,
        op11_exact_dedup, op12_importance_resampling, op13_dual_tree_lloyd,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.SQL,
        "op2_chat_format": chat.SQL,
        "op5_embedding_dedup": embedding_dedup.SQL,
        "op6_quality_rules": quality_rules.SQL,
        "op9_simhash_dedup": simhash.SQL,
        "op11_exact_dedup": exact_dedup.SQL,
        "op12_importance_resampling": importance.SQL,
        "op13_dual_tree_lloyd": dual_tree.SQL,
    }
