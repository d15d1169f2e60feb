"""A training-data pipeline over ``documents``: five stages, each one operator of ``terrameter.llm``.

Language ID (documents without a learned language go), SimHash near-dedup (one document of each group
stays), secret scans (secrets are masked), mixing sources to target weights (documents are repeated
or left out), SentencePiece encoding and decoding.  Every stage is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrameter.llm import language_id, mixing, secret_scan
from terrameter.llm.sentencepiece_codec import encode_documents
from terrameter.llm.simhash import simhash_groups
from terrameter.llm.store import drop, written


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside its text, so that no other column can clash with an operator's."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which no learned language can be told: those without a letter."""
    found = language_id.identify(_packed(docs), language_id.fit(docs), keep=["row"])
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep exactly one row of each group, the one with the smallest id (null ids last) and text hash.

    Rows are told apart by id and text hash, so null and repeated ids neither join groups nor empty
    them.  Texts are dealt once, by that key; only repeated keys are grouped.
    """
    text = docs["text"].cast("string")
    parts = {"no_id": docs["doc_id"].isNull(), "id": docs["doc_id"], "h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)}
    keyed = docs.select(F.struct(*[c.alias(k) for k, c in parts.items()]).alias("key"), text.alias("text"))
    # a group's component is its smallest key, which only rows of one text have: it names the group and the row that stays
    groups = simhash_groups(keyed, "key").where("key = component_id").groupBy("key").agg(F.count("*").alias("n_rows"))
    heads = written(groups.select("n_rows", *[F.col(f"key.{k}").alias(f"head_{k}") for k in parts]))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(f"own_{k}") for k, c in parts.items()])
    same = [F.col(f"own_{k}").eqNullSafe(F.col(f"head_{k}")) for k in parts]
    # dealt by key at every size: heads grow with the documents, so they are never broadcast
    rows = rows.join(heads.hint("shuffle_hash"), same)
    kept = rows.where("n_rows = 1").select("row")
    if not heads.where("n_rows > 1").isEmpty():
        again = rows.where("n_rows > 1").groupBy(*[f"head_{k}" for k in parts]).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.unionByName(again.select("row"))
    return kept.select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask what the forest takes for a secret; every document stays, with n_chars of its new text."""
    found = secret_scan.scan_documents(_packed(docs), secret_scan.train())
    masked = F.col("row").withField("text", F.col("text")).withField("n_chars", F.length("text").cast("bigint"))
    return found.select(F.when(F.size("findings") > 0, masked).otherwise(F.col("row")).alias("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources reach their target weights."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text, encoded and decoded."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: SQL expresses neither the mixture inference nor the forest; a test compares run() with a version that takes one document at a time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            drop(before)  # its only reader is done; the input itself is no written table and stays
    return docs
