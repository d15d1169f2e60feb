"""Mixing sources to target weights, by Efraimidis-Spirakis sampling inside the JVM.

A source's target words are met by complete epochs first.  The rest is a weighted sample without
replacement: every document draws an exponential key divided by its quality weight, and documents
are taken in key order up to the rest.  Keys fall into buckets whose sizes are summed first; the one
bucket on which a source's budget ends is split again and again until it holds few rows, and only
those are sorted.  Where all keys of it are one, it is split by size, and then by the hash of the row;
rows that are equal in all of these are the same row repeated, and are counted instead of sorted.  So
no task sorts a share of a source, whatever its size, its weights and its repetitions are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, written
from .text import count_chars, n_words

BUCKETS = 4096
FINE = 8192  # rows of a source that may be sorted in one task, or repeated from one row


def quality_weight(text: Column, size: Column) -> Column:
    """From 0.1 to 1: documents with many markup symbols for their words are drawn later."""
    return F.greatest(F.lit(0.1), 1.0 - count_chars(text, "#*$%&|<>") / F.greatest(size, F.lit(1)))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight for a uniform u that depends on the id (the text, where the id is null) and the seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def row_hash(docs: DataFrame) -> Column:
    """52 bits, exact as a double, of a row's columns; those of types without a hash go by their JSON."""
    odd = [f.name for f in docs.schema if any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    parts = [F.to_json(F.struct(docs[c])) if c in odd else docs[c] for c in docs.columns]
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1))


def keyed(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False) -> DataFrame:
    """_id, _source, _size (words; null text: 0), _key, _hash and, if ``whole``, the row itself as _row."""
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if whole else []
    df = docs.select(*row, row_hash(docs).alias("_hash"), docs[id_col].alias("_id"), docs[source_col].cast("string").alias("_source"), docs[text_col].cast("string").alias("_text"), n_words(docs[text_col].cast("string")).alias("_size"))
    return df.withColumn("_key", sampling_key(F.col("_id"), F.col("_text"), quality_weight(F.col("_text"), F.col("_size")), seed)).drop("_text")


#: The columns by which documents are drawn, in order.
ORDER = ("_key", "_size", "_hash")
_BOUNDS = [f"{side}{c}" for c in ORDER for side in ("lo", "hi")]


def _ends(rows: DataFrame, bucket: Column) -> DataFrame:
    """Words, rows with words and their ranges of the drawing columns, of each source and bucket."""
    some = F.col("_size") > 0
    bounds = [of(F.when(some, F.col(c))).alias(f"{side}{c}") for c in ORDER for side, of in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("_source", bucket.cast("int").alias("_bucket")).agg(F.sum("_size").alias("in_bucket"), F.count_if(some).alias("n"), *bounds)


def _ending(buckets: DataFrame, plan: DataFrame) -> DataFrame:
    """(_s, end) with the bucket on which each source's rest ends: its bounds, n and the words before it."""
    run = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    run_up = buckets.withColumn("upto", F.sum("in_bucket").over(run))
    ends = run_up.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).where("before + upto > rest")
    end = F.struct("_bucket", (F.col("before") + F.col("upto") - F.col("in_bucket")).alias("before"), *[buckets[c] for c in _BOUNDS], buckets["n"])
    return ends.groupBy(F.col("_source").alias("_s")).agg(F.min_by(end, "_bucket").alias("end"))


def _among() -> Column:
    """Whether a row with words is in its source's ending range."""
    inside = [F.col(c).between(F.col(f"lo{c}"), F.col(f"hi{c}")) for c in ORDER]
    return F.coalesce((F.col("_size") > 0) & inside[0] & inside[1] & inside[2], F.lit(False))


def _before() -> Column:
    """Whether a row with words is drawn before its source's ending range.  Only a single value's rows are split by the next column."""
    less = F.lit(False)
    for c in reversed(ORDER):
        low, high = F.col(f"lo{c}"), F.col(f"hi{c}")
        less = (F.col(c) < low) | ((low == high) & (F.col(c) == low) & less)
    return F.coalesce((F.col("_size") > 0) & less, F.lit(False))


def source_plan(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, fine: int = FINE) -> DataFrame:
    """One row per source: _of, source_size, target, epochs, rest, and the range of draws in which rest ends.

    ``rows``: what ``keyed`` gives, written, as it is read again for each split.  Sources in code point
    order, null last, weigh ``weights`` in turn and share all words; a target stops at ``cap`` times
    its source's words and the excess goes to the others by weight.  At most ``fine`` rows are in
    the range, or all of them are one row repeated.  Windows without a partition see one row per source.
    """
    spread = F.least(F.floor((1.0 - F.exp(-F.col("_key"))) * BUCKETS), F.lit(BUCKETS - 1))
    buckets = written(_ends(rows, spread))
    sizes = buckets.groupBy("_source").agg(F.sum("in_bucket").alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    sizes = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1)).withColumn("most", F.col("source_size") * cap)
    filling = Window.orderBy(F.col("most") / F.col("w"), F.col("_source").asc_nulls_last())
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumns(
        {
            "level": (F.sum("source_size").over(everything) - (F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")))
            / F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)),
            "place": F.row_number().over(filling),
        }
    )
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct("place", "level"))
    sizes = sizes.withColumn("share", F.min(fits).over(everything)["level"])
    target = F.least(F.col("most").cast("double"), F.col("share") * F.col("w"))
    plan = sizes.select("_source", "source_size", target.alias("target"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.select(F.col("_source").alias("_of"), "source_size", "target", "epochs", "rest", F.lit(0).cast("bigint").alias("before"))
    names = ["_of", "source_size", "target", "epochs", "rest"]

    def narrowed(plan: DataFrame, buckets: DataFrame) -> DataFrame:
        found = plan.join(_ending(buckets, plan.select("_of", "rest", "before")), F.col("_of").eqNullSafe(F.col("_s")), "left")
        return written(found.select(*names, F.coalesce("end.before", "before").alias("before"), *[F.col(f"end.{c}").alias(c) for c in (*_BOUNDS, "n")]))

    plan = narrowed(plan, buckets)
    drop(buckets)
    several = [F.col(f"lo{c}") < F.col(f"hi{c}") for c in ORDER]
    too_wide = F.coalesce((F.col("n") > fine) & (several[0] | several[1] | several[2]), F.lit(False))
    while not (wide := plan.where(too_wide)).isEmpty():
        inner = rows.join(wide.select("_of", *_BOUNDS), F.col("_source").eqNullSafe(F.col("_of"))).where(_among())
        place = [(F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}")) for c in ORDER]
        at = F.when(several[0], place[0]).when(several[1], place[1]).otherwise(place[2])
        inner = inner.withColumn("_part", F.least(F.floor(at * BUCKETS), F.lit(BUCKETS - 1))).select("_source", *ORDER, "_part")
        before, parts = plan, narrowed(wide.select(*names, "before"), _ends(inner, F.col("_part")))
        plan = written(plan.where(~too_wide).unionByName(parts))
        drop(before)
        drop(parts)
    return plan


def _repeated(ending: DataFrame, fine: int) -> DataFrame:
    """The rows of ranges that hold one row ``n`` times, with _prior: counted, and made again from one of them."""
    one = ending.dropDuplicates(["_of"])
    chunk = one.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / fine))))
    # a chunk's copies are made where it is dealt to; with a number, as chunks are so few bytes that they would be put together again
    dealt = chunk.repartition(int(ending.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_of", "_chunk")
    first = F.col("_chunk") * fine
    copies = dealt.withColumn("_copy", F.explode(F.sequence(first, F.least(first + fine, F.col("n")) - 1)))
    return copies.withColumn("_prior", F.col("before") + F.col("_copy") * F.col("_size")).drop("_chunk", "_copy")


def mix(docs: DataFrame, plan: DataFrame, fine: int = FINE) -> DataFrame:
    """``keyed`` documents with their source's plan, ``extra`` and ``picked``.

    Every document is taken ``epochs`` times whole.  ``extra`` is how many of its words fill the rest:
    all up to the document on which the rest ends, of which the first words.  ``picked`` says the same
    for mixes of whole documents: that last one is taken if it comes nearer to the target.
    Documents without words are taken in epochs only.  Repeated rows with one id are drawn one by one.
    """
    df = docs.join(plan, docs["_source"].eqNullSafe(plan["_of"]))
    among, within, many = _among(), _before(), F.col("n") > fine
    plain = df.where(~among).withColumns({"picked": within.cast("int"), "extra": F.when(within, F.col("_size")).otherwise(0)})
    order = Window.partitionBy("_of").orderBy("_key", "_id", "_size", "_hash").rowsBetween(Window.unboundedPreceding, 0)
    prior = F.col("before") + F.sum("_size").over(order) - F.col("_size")
    ending = df.where(among & ~many).withColumn("_prior", prior)
    if not plan.where(many).isEmpty():
        ending = ending.unionByName(_repeated(df.where(among & many), fine))
    picked = (F.col("_prior") + F.col("_size") / 2.0 <= F.col("rest")).cast("int")
    extra = F.greatest(F.lit(0), F.least(F.col("_size"), F.floor("rest") - F.col("_prior")))
    ending = ending.withColumns({"picked": picked, "extra": extra}).drop("_prior")
    return plain.unionByName(ending)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, and no other columns.

    Null sources form one source, the last; null texts have no words.  An empty table gives an empty
    result.  The same rows and seed give the same mix.
    """
    plan = source_plan(written(keyed(docs, seed)), weights, cap)
    taken = mix(keyed(docs, seed, whole=True), plan)
    return taken.select(F.explode(F.array_repeat(F.col("_row"), (F.col("epochs") + F.col("picked")).cast("int"))).alias("_row")).select("_row.*")


def mix_report(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs and extra of every row of ``docs``.

    The words taken from a source are its target, rounded down.
    """
    rows = written(keyed(docs, seed))
    taken = mix(rows, source_plan(rows, weights, cap))
    words = (F.col("_size") * F.col("epochs") + F.col("extra")).cast("bigint")
    return taken.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", words.alias("taken"), F.col("epochs").cast("bigint").alias("epochs"), F.col("extra").cast("bigint").alias("extra"))


SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(text), '') AS name, coalesce(len([x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> '']), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols
  FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(name || ':17'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
            / greatest(0.1::DOUBLE, 1.0::DOUBLE - symbols::DOUBLE / greatest(size, 1)) AS key FROM base),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM k GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS most,
         (sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size))::DOUBLE / sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS place
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (
  SELECT source, source_size, least(most::DOUBLE, w * (SELECT arg_min(level, place) FROM f WHERE level <= most / w::DOUBLE)) AS target FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, target, size * epochs + extra AS taken, epochs, extra FROM (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
         greatest(0, least(k.size, floor(p.target - p.epochs * p.source_size)::BIGINT
           - (sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size)))::BIGINT AS extra
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
"""
