"""Quality rules as a bitmask ledger, inside the JVM.

Every rule is evaluated once for each document.  The ledger stores the measurements and one bit for
each failed rule; versioned policies are masks over these bits, and what any rule alone decides (its
ablation) follows from counting bit patterns, without another look at the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import count_chars, let, words

SYMBOLS = "#*$%&|<>"



def _rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "many_symbols": 100 * F.col("n_symbols") > 20 * n,
        "repeated_lines": (F.col("n_dup_lines") > 3) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 14 * n,
    }


#: Masks by policy version: the rules that reject a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    names = list(_rules())
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _repeated(w: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Windows are compared by a 64-bit hash.  Texts without an equal pair stop after one hash set.
    """
    none = F.lit(0)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            same = lambda i, p: F.get(pairs, i)["h"] == p["h"]
            hit = F.filter(pairs, lambda p, i: F.coalesce(same(i - 1, p), F.lit(False)) | F.coalesce(same(i + 1, p), F.lit(False)))
            at = F.sort_array(F.transform(hit, lambda p: p["i"]))
            start = F.struct(F.lit(-3).alias("last"), none.alias("n"))
            return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(placed, twice))

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(none, F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, none).otherwise(let(hashes, covered))

    return let(w, windows).cast("bigint")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of every whole text; a null text measures as the empty one."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    seen = docs.select(docs[id_col].alias("doc_id"), text.alias("_t"))
    seen = seen.select(
        "doc_id",
        let(words(F.col("_t")), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.length(F.array_join(w, "")).cast("bigint").alias("chars"), _repeated(w).alias("rep"))).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("_l"),
        count_chars(F.col("_t"), SYMBOLS).alias("n_symbols"),
    )
    return seen.select(
        "doc_id", F.col("_w.n").alias("n_words"), F.col("_w.chars").alias("word_chars"), "n_symbols", F.col("_l.n").alias("n_lines"), F.col("_l.dup").alias("n_dup_lines"), F.col("_w.rep").alias("n_repeat_words")
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fail_bits`` of every row of ``docs``.

    Null and empty texts have no words and fail few_words.  Repeated rows and null ids stay; other
    columns are ignored; an empty table gives an empty ledger.
    """
    bits = sum((F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(_rules().values())), F.lit(0))
    return measured(docs, id_col, text_col).withColumn("fail_bits", bits.cast("bigint"))


def keeps(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and kept without it."""
    names = list(_rules())
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]]))
    one = patterns.select("bits", "n", rule.alias("r"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    bit = F.col("r.bit")
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(bit) != 0)("failed"), total(F.col("bits") == bit)("failed_alone"), total((F.col("bits") == bit) | (F.col("bits") == 0))("kept_without")
    )


SQL = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, [x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> ''] AS ws,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM base),
i AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM i),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN p USING (r)),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
             + 8 * (n_dup_lines > 3 AND 100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT)::BIGINT AS fail_bits
  FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits & 63 = 0 AS kept FROM b
"""
