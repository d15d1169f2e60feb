"""Sums of doubles that are exact however the rows are dealt: integers by exponent bin, rounded once.

A double is a few integers, each times a power of 2^24.  Integers of one bin add without error, so they
are summed in partial aggregates like any count, and a group ends as at most some ninety rows whatever
its size.  Only these are put together, as one whole number that is rounded to the nearest double.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Bits of a bin, and the integers that a double may need: 53 bits, wherever they begin, touch four bins.
BITS, PARTS = 24, 4


def _scaled(value: Column, bins: Column) -> Column:
    """``value`` times 2^(BITS bins), in two steps so that no power is beyond the doubles."""
    half = F.pow(F.lit(2.0), bins * (BITS // 2))
    return value * half * half


def with_parts(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` with _bin and _part0 to _part3: value = sum of _part_i 2^(BITS (_bin - i)), exactly.

    Where the value is null or not finite, _bin is null.  A logarithm that is rounded across a bin's
    bound leaves the first part empty or one bit longer; the sum stays the same.
    """
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    out = rows.withColumn("_rest", value).withColumn("_bin", F.when(finite, F.when(F.col("_rest") == 0, 0).otherwise(F.floor(F.log2(F.abs("_rest")) / BITS).cast("int"))))
    for i in range(PARTS):
        out = out.withColumn(f"_part{i}", F.when(F.col("_bin").isNotNull(), _scaled(F.col("_rest"), i - F.col("_bin"))).cast("bigint"))
        out = out.withColumn("_rest", F.col("_rest") - _scaled(F.col(f"_part{i}").cast("double"), F.col("_bin") - i))
    return out.drop("_rest")


def rounded(parts: dict[int, int]) -> float:
    """The double nearest to the sum of ``parts[b] * 2^(BITS b)``; ties to even."""
    low = min(parts, default=0)
    whole = sum(n << BITS * (b - low) for b, n in parts.items())
    try:
        return float(whole << BITS * low) if low >= 0 else whole / (1 << -BITS * low)
    except OverflowError:
        return math.copysign(math.inf, whole)


def _rounded(bins: Column) -> Column:
    def one(group) -> float:
        parts: dict[int, int] = {}
        for row in group:
            for i in range(PARTS):
                parts[row["bin"] - i] = parts.get(row["bin"] - i, 0) + int(row[f"p{i}"])
        return rounded(parts)

    def run(groups: pd.Series) -> pd.Series:
        return groups.map(one)

    return F.pandas_udf(run, DoubleType())(bins)


def exact_sum(values: Column | str) -> Column:
    """Sum of a row's own array, rounded once; null if the array is, its null and NaN elements count as zero."""

    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda v: None if v is None else math.fsum(x for x in v if x is not None and x == x))

    return F.pandas_udf(run, DoubleType())(values)


def exact_totals(rows: DataFrame, keys: list[str], value: Column | str, total: str = "total", n: str = "n") -> DataFrame:
    """keys, ``total`` and ``n`` (values that are not null) of every group, as ``math.fsum`` has them.

    A group without values has the total null.  One NaN, or both infinities, give NaN; one infinity gives
    itself; a sum beyond the doubles is infinite.  Sums of a bin are longs: more than some 10^11 rows of
    one group and magnitude raise an overflow error.
    """
    value = F.col(value) if isinstance(value, str) else value
    parts = with_parts(rows.select(*keys, value.cast("double").alias("_value")), F.col("_value"))
    infinite = lambda x: F.count_if(F.col("_value") == F.lit(x))
    by_bin = parts.groupBy(*keys, "_bin").agg(
        F.count("_value").alias("_n"), F.count_if(F.isnan("_value")).alias("_nan"), infinite(float("inf")).alias("_up"), infinite(float("-inf")).alias("_down"), *[F.sum(f"_part{i}").alias(f"_p{i}") for i in range(PARTS)]
    )
    bins = F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct(F.col("_bin").alias("bin"), *[F.col(f"_p{i}").alias(f"p{i}") for i in range(PARTS)])))
    groups = by_bin.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_n", "_nan", "_up", "_down")], bins.alias("_bins"))
    nan, up, down = (F.col(c) > 0 for c in ("_nan", "_up", "_down"))
    found = F.when(F.col("_n") == 0, None).when(nan | up & down, float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(_rounded("_bins"))
    return groups.select(*keys, found.alias(total), F.col("_n").alias(n))
