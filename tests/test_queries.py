"""Every query of the measuring engine against DuckDB on the same files."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from terrameter import queries as measuring

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(measuring.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = measuring.queries()[name](spark, sf_dir)
    want = duck.execute(measuring.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(measuring.queries()) - set(measuring.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert measuring.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and all(r["measured"] > 0 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_projected_lengths_agree_with_geodesic_lengths(spark, sf_dir):
    """The kernel's chart and the plan without Python measure the same lines."""
    kernel = {r["key"]: r["length_m"] for r in measuring._measured_lines(spark, sf_dir).where("length_m is not null").collect()}
    plan = {r["key"]: r["length_m"] for r in measuring._lines(spark, sf_dir).where("not outside and distinct_vertices > 1").collect()}
    assert kernel.keys() == plan.keys()
    assert all(abs(kernel[k] - plan[k]) <= max(0.002, 1e-6 * plan[k]) for k in plan)


def test_filters_reach_the_scan(spark, sf_dir):
    plan = measuring.offset_page(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(user_id,7)" in plan
    plan = measuring.line_length_by_priority(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("hashpartitioning(l_orderkey") == 1


def test_documents_are_made_without_a_broadcast(spark, sf_dir):
    """Both sides of the join grow with the parts; a broadcast would pass one of them whole through the driver."""
    from terrameter import file_adapters

    plan = file_adapters.kml_files(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["extent_and_provenance", "overlap_pairs"])
def test_costly_rows_are_spread_before_the_kernel(spark, sf_dir, name):
    """A table of many short rows is one split of the scan: rows are dealt over tasks before Python takes them."""
    plan = measuring.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("EvalPython") < plan.index("RoundRobinPartitioning")


@pytest.mark.parametrize("name", ["path_segments", "line_length_by_priority", "line_measurement", "densify_counts", "convergence_streak"])
def test_steps_of_the_geodesic_are_compiled(spark, sf_dir, name):
    """The JVM interprets methods of 8000 bytes and more, at a multiple of the time."""
    import re

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = measuring.queries()[name](spark, sf_dir)._jdf.queryExecution()
        code = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 7500


def test_distance_is_null_only_where_a_position_is(spark):
    from terrameter.functions.geodesic import inverse
    from terrameter.functions.vincenty_sql import with_distance

    ends = [(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (10.0, 90.0, 20.0, 90.0), (179.9, 10.0, -179.9, 10.1), (5.0, -60.0, 5.0, -61.0)]
    rows = spark.createDataFrame([(*e, i) for i, e in enumerate(ends)] + [(None, 0.0, 1.0, 1.0, 9), (0.0, 0.0, 1.0, None, 9)], "lon1 double, lat1 double, lon2 double, lat2 double, i int")
    found = [(r["i"], r["distance"]) for r in with_distance(rows).collect()]
    assert all(d is None if i == 9 else abs(d - float(inverse(*ends[i])[0])) < 1e-6 for i, d in found)


def test_line_measurement_shuffles_once_and_joins_nothing(spark, sf_dir):
    plan = measuring.queries()["line_measurement"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_items_of_no_order_are_a_line_of_one_place(spark, sf_dir, tmp_path):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(20)
    items.union(items.limit(2).withColumn("l_orderkey", F.lit(None).cast("long"))).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = measuring.queries()["line_measurement"](spark, str(tmp_path)).where("key is null").collect()
    assert [(r["measurement_status"], r["code"]) for r in found] == [("ERROR", "DEGENERATE_LINE")]
