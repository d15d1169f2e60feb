"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 2 bits share a variant within 1 bit of both.  Every
distinct fingerprint emits itself and its 64 one-bit variants; fingerprints that meet on a variant
are within 2 bits of each other, which a bit count verifies.  A variant is shared by 65 fingerprints
at most, so no group grows with the data, whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import bounded_batches, written

BITS = 64
_SLAB = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the shingles of ``width`` lower-cased words, repeats included, as an unsigned int.

    A text with fewer words has one shingle, all its words; one with none (or null) has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z, splits on ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[len(words) - n :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _SLAB):  # long texts in slabs: memory stays bounded
        pairs = zip(starts[at : at + _SLAB].tolist(), last[at : at + _SLAB].tolist(), strict=False)
        h = np.array([digest(joined[s:e], 42) for s, e in pairs], np.uint64)[: n - at]
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the fingerprint of every text as a signed long."""
    kind = docs.schema[id_col].dataType
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((_signed(fingerprint(t.as_py())) for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["id", "fp"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("id", kind), StructField("fp", LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def ball_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, enough of them to join all within 2 bits.

    The fingerprints on a variant are all within 2 bits of each other, so a chain of them carries
    the same components as all their pairs.
    """
    flips = F.array([F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("bigint")) for b in range(BITS)])
    met = distinct.select("fp", F.explode(flips).alias("variant"))
    chain = Window.partitionBy("variant").orderBy("fp")
    pairs = met.select("fp", F.lag("fp").over(chain).alias("prev")).where("prev is not null")
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("prev"))) <= 2).select(F.col("prev").alias("a"), F.col("fp").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) of every row of ``docs``, repeated rows and null ids included.

    component_id is the smallest id reachable over links of 2 or fewer differing bits; rows with the
    same fingerprint are linked.  Texts without words (null, empty) have fingerprint 0 and link like
    any other.  An empty table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col))
    least = written(fps.groupBy("fp").agg(F.min("id").alias("least")))
    parts = connected_components(ball_links(least.select("fp")), "a", "b")
    of = least.join(parts, least.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    of = written(of)
    roots = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(roots, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# The primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _sql(width: int = 3, seed: int = 42) -> str:
    """The same groups in another engine's SQL: XXH64 in 128-bit arithmetic, all pairs of fingerprints, reachability."""

    def wide(x: int | str) -> str:
        return f"{x}::UHUGEINT"

    p1, p2, p3, p4, p5 = map(wide, _PRIMES)
    word = wide(1 << 64)

    def turned(x: str, by: int) -> str:
        return f"(({x}) * {wide(1 << by)} % {word} + ({x}) // {wide(1 << 64 - by)})"

    def mixed(acc: str, lane: str) -> str:
        return f"({turned(f'({acc} + {lane} * {p2} % {word}) % {word}', 31)} * {p1} % {word})"

    def little(at: str, n: int) -> str:
        """``n`` bytes of the hexadecimal text x from the 0-based byte ``at``, the lowest first."""
        return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT::UHUGEINT"

    mask = (1 << 64) - 1
    begin = [seed + _PRIMES[0] + _PRIMES[1], seed + _PRIMES[1], seed, seed - _PRIMES[0]]
    stripes = [f"list_reduce(list_prepend({b & mask}::UHUGEINT, [{little(f'32 * k + {8 * i}', 8)} for k in range(0, n // 32)]), lambda a, y: {mixed('a', 'y')})" for i, b in enumerate(begin)]
    joined = " + ".join(turned(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18)))
    lanes = ", ".join(mixed("0::UHUGEINT", f"v{i}") for i in range(4))
    tail = "n // 32 * 32"
    bits = " + ".join(f"(2 * sum(c * (h // {wide(1 << b)} % 2)::BIGINT) > sum(c))::INT::UHUGEINT * {wide(1 << b)}" for b in range(BITS))
    later = ", ".join(f"lead(word, {i}) OVER w" for i in range(1, width))
    return rf"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents),
u AS (SELECT r, len(words) AS m, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, m, i, concat_ws(' ', word, {later}) AS s FROM u WINDOW w AS (PARTITION BY r ORDER BY i)),
shingle AS (SELECT r, s, count(*) AS c FROM g WHERE i <= greatest(1, m - {width - 1}) GROUP BY r, s),
x0 AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM (SELECT DISTINCT s FROM shingle)),
x1 AS (SELECT *, {", ".join(f"{e} AS v{i}" for i, e in enumerate(stripes))} FROM x0),
x2 AS (SELECT s, x, n, {wide("n")} + CASE WHEN n < 32 THEN {(seed + _PRIMES[4]) & mask}::UHUGEINT
  ELSE list_reduce([({joined}) % {word}, {lanes}], lambda a, y: (xor(a, y) * {p1} + {p4}) % {word}) END AS h FROM x1),
x3 AS (SELECT s, x, n, list_reduce(list_prepend(h % {word}, [{little(f"{tail} + 8 * k", 8)} for k in range(0, n % 32 // 8)]),
  lambda a, y: ({turned(f"xor(a, {mixed('0::UHUGEINT', 'y')})", 27)} * {p1} + {p4}) % {word}) AS h FROM x2),
x4 AS (SELECT s, x, n, CASE WHEN n % 8 < 4 THEN h ELSE ({turned(f"xor(h, {little('n // 8 * 8', 4)} * {p1} % {word})", 23)} * {p2} + {p3}) % {word} END AS h FROM x3),
x5 AS (SELECT s, list_reduce(list_prepend(h, [{little("n // 4 * 4 + k", 1)} for k in range(0, n % 4)]), lambda a, y: {turned(f"xor(a, y * {p5} % {word})", 11)} * {p1} % {word}) AS h FROM x4),
x6 AS (SELECT s, xor(h, h // {wide(1 << 33)}) * {p2} % {word} AS h FROM x5),
x7 AS (SELECT s, xor(h, h // {wide(1 << 29)}) * {p3} % {word} AS h FROM x6),
hashed AS (SELECT s, xor(h, h // {wide(1 << 32)}) AS h FROM x7),
f AS (SELECT r, ({bits})::UBIGINT AS fp FROM shingle JOIN hashed USING (s) GROUP BY r),
docs AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN f USING (r)),
one AS (SELECT fp, min(doc_id) AS least FROM docs GROUP BY fp),
link AS (SELECT a.fp AS a, b.fp AS b FROM one a JOIN one b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach AS (SELECT fp AS a, fp AS b FROM one UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
part AS (SELECT a AS fp, min(least) AS component_id FROM reach JOIN one ON one.fp = reach.b GROUP BY a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM docs JOIN part USING (fp)
"""


SQL = _sql()
