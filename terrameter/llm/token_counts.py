"""Exact token counts from a histogram of encoded lengths.

Documents are encoded once and counted by length.  Suffix sums over the lengths answer totals,
quantiles and truncated totals for every context limit exactly.  The table has one row for each
length that occurs; sums run over blocks of lengths, so the windows without a partition see one row for
every 1024 lengths: some thousand rows where the longest document has millions of tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import bounded_batches, written

BLOCK = 1024
_encodings: dict[bytes, tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The worker's encoding of a rank file's bytes; it is built once."""
    key = hashlib.sha256(ranks).digest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


# White space as the library's patterns know it, in runs that overflow its matcher's stack near a million.
_WHITE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_LONG_RUN = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{10000,}}")
_GREEDY_SPACE = r"|\s+(?!\S)|\s+"  # how a pattern must end for a run to be one piece but for its last character


def n_tokens(enc: tiktoken.Encoding, text: str) -> int:
    """Tokens of a whole text.

    A long run of white space is cut where the pattern cuts it: all of it is one piece, less the last
    character where more text follows.  So the pieces and their tokens are those of the whole text.
    """
    n = at = 0
    if enc._pat_str.endswith(_GREEDY_SPACE):
        for run in _LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            n += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
            at = end
    return n + len(enc.encode_ordinary(text[at:]))


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens) of every whole text; null and empty texts have 0.

    The rank file is read on the driver and broadcast: its size is that of one fixed vocabulary.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    bounded_batches(docs.sparkSession)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for b in batches:
            n = pa.array((n_tokens(enc, t.as_py() or "") for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], [id_col, "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def length_table(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, read as a context limit.

    length, n_docs; docs_over and tokens_over (longer documents and their tokens); total_tokens;
    truncated_tokens (all documents cut to ``length``); lost_tokens; docs_within and quantile (share
    of documents with at most ``length``).  An empty table gives an empty result.
    """
    counts = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    counts = written(counts.withColumn("block", F.floor(F.col("length") / BLOCK)))
    tokens = F.col("n_docs") * F.col("length")
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("bigint")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(tokens).alias("b_tokens"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("b_docs").over(later), none).alias("after_docs"), F.coalesce(F.sum("b_tokens").over(later), none).alias("after_tokens"),
        F.sum("b_docs").over(every).alias("all_docs"), F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(blocks, "block").select(
        "length", "n_docs", "all_docs", "total_tokens",
        (F.col("after_docs") + F.coalesce(F.sum("n_docs").over(own), none)).alias("docs_over"),
        (F.col("after_tokens") + F.coalesce(F.sum(tokens).over(own), none)).alias("tokens_over"),
    )
    kept = F.col("total_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")
    return out.select(
        "length", "n_docs", "docs_over", "tokens_over", "total_tokens", kept.alias("truncated_tokens"), (F.col("total_tokens") - kept).alias("lost_tokens"),
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"), ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut to ``limit``, which need not occur as a length."""
    return table.agg(F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("length"), F.lit(limit))), F.lit(0)).alias("tokens"))


def length_quantile(table: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share ``q`` of all documents does not exceed."""
    return table.where(F.col("quantile") >= q).agg(F.min("length").alias("length"))
