"""Column expressions on words, shared by the operators that stay inside the JVM.

A word is a maximal run of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\u000b\f\r"


def words(text: Column) -> Column:
    """Array of the words; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as a long, without keeping them."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, w: n + F.when(w != "", 1).otherwise(0))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n
