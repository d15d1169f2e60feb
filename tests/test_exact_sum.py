"""Exact sums against math.fsum, bit for bit."""

from __future__ import annotations

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrameter.operators.exact_sum import BITS, PARTS, exact_sum, exact_totals, rounded, with_parts


def cases():
    rng = random.Random(2)
    near = [s * 2.0**e * f for e in (-1074, -1030, -24, -1, 0, 23, 24, 48, 1000) for s in (1, -1) for f in (1.0, 1 - 2**-53, 1 + 2**-52) if 2.0**e * f > 0]
    groups = {
        "cancel": [1e16, 1.0, -1e16, 1e-30], "tie": [1.0, 2**-53, 2**-106], "tie_down": [1.0, 2**-53], "subnormal": [5e-324] * 7 + [-5e-324] * 2, "zero": [0.0, -0.0], "edges": near, "overflow": [1.7e308, 1.7e308], "back": [1.7e308, 1.7e308, -1.7e308],
        "spread": [rng.choice([1, -1]) * rng.random() * 2.0 ** rng.randrange(-1000, 1000) for _ in range(3000)], "money": [round(rng.uniform(-1e5, 1e5), 2) for _ in range(5000)], "nulls": [None, None], "some": [None, 2.5], "nan": [1.0, math.nan], "up": [math.inf, 1.0], "both": [math.inf, -math.inf],
    }
    return groups


def wanted(values):
    values = [v for v in values if v is not None]
    if not values:
        return None
    if any(map(math.isnan, values)) or {math.inf, -math.inf} <= set(values):
        return math.nan
    try:
        return math.fsum(values)
    except OverflowError:  # fsum gives up where a partial sum does; the sum itself may be finite
        return rounded_fraction(values)


def rounded_fraction(values):
    from fractions import Fraction

    whole = sum(map(Fraction, values))
    return math.inf if whole >= 2**1024 - 2**970 else float(whole)


def test_totals_equal_fsum_in_any_order_and_dealing(spark):
    groups = cases()
    rows = [(k, v) for k, values in groups.items() for v in values]
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, v double").repartition(1 + 6 * seed)
        got = {r.k: (r.total, r.n) for r in exact_totals(df, ["k"], "v").collect()}
        for k, values in groups.items():
            want = wanted(values)
            assert got[k][1] == sum(v is not None for v in values)
            assert got[k][0] is None if want is None else repr(got[k][0]) == repr(want + 0.0), k
    assert exact_totals(df.limit(0), ["k"], "v").collect() == []
    assert [tuple(r) for r in exact_totals(df.where("k = 'money'"), [], "v").collect()] == [(math.fsum(groups["money"]), 5000)]


def test_parts_are_exact_and_rows_are_not_multiplied(spark):
    values = [v for vs in cases().values() for v in vs if v is not None and math.isfinite(v)]
    parts = with_parts(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v")).collect()
    assert len(parts) == len(values)
    for r in parts:
        assert rounded({r._bin - i: r[f"_part{i}"] for i in range(PARTS)}) == r.v and all(abs(r[f"_part{i}"]) <= 2 ** (BITS + 1) for i in range(PARTS))
    plan = exact_totals(spark.range(10).withColumn("v", F.rand()), ["id"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "partial_sum" in plan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-60, 40), st.integers(-(2**60), 2**60)), max_size=6))
def test_rounding_of_bins(parts):
    from fractions import Fraction

    merged = {}
    for b, n in parts:
        merged[b] = merged.get(b, 0) + n
    whole = sum((Fraction(n) * Fraction(2) ** (BITS * b) for b, n in merged.items()), Fraction(0))
    assert rounded(merged) == (math.copysign(math.inf, whole) if abs(whole) >= 2**1024 - 2**970 else float(whole))


def test_sum_of_a_rows_own_array(spark):
    rows = spark.createDataFrame([(1, [1e16, 1.0, None, -1e16]), (2, None), (3, [])], "k int, v array<double>")
    assert [r.s for r in rows.select("k", exact_sum("v").alias("s")).orderBy("k").collect()] == [1.0, None, 0.0]
