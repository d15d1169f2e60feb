"""Deterministic geometry over relational tables, so that every operator runs on the driver's data.

Positions are rounded to nine decimals, lines follow an order's items, polygons are squares by part.
The ``*_SQL`` texts say the same for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lon(k: str) -> str:
    return f"((({k} * 7919) % 360000) - 180000) / CAST(1000 AS DOUBLE)"


def _lat(k: str) -> str:
    return f"((({k} * 104729) % 160001) - 80000) / CAST(1000 AS DOUBLE)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, key, lon and lat of every supplier and customer."""
    parts = []
    for name, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        t = table(spark, sf_dir, name)
        parts.append(t.selectExpr(f"'{name}' AS kind", f"{key} AS key", f"round({_lon(key)}, 9) AS lon", f"round({_lat(key)}, 9) AS lat"))
    return parts[0].unionByName(parts[1])


POINTS_SQL = f"""(
  SELECT 'supplier' AS kind, s_suppkey AS key, round({_lon("s_suppkey")}, 9) AS lon, round({_lat("s_suppkey")}, 9) AS lat FROM supplier
  UNION ALL SELECT 'customer', c_custkey, round({_lon("c_custkey")}, 9), round({_lat("c_custkey")}, 9) FROM customer)"""

_VERTEX_LON = f"""CASE WHEN l_orderkey % 97 = 0 THEN 179.9985D + 0.001D * l_linenumber
 WHEN l_orderkey % 89 = 0 THEN CASE WHEN 179.9985D + 0.001D * l_linenumber > 180D THEN 179.9985D + 0.001D * l_linenumber - 360D ELSE 179.9985D + 0.001D * l_linenumber END
 ELSE {_lon("l_orderkey")} + 0.001D * l_linenumber END"""
_VERTEX_LAT = f"{_lat('l_orderkey')} + 0.001D * (l_quantity % 10)"
_ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, v (place in the line), lon and lat of every order's items: one shuffle, by order."""
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key", *_ITEM_ORDER, f"round({_VERTEX_LON}, 9) AS lon", f"round({_VERTEX_LAT}, 9) AS lat")
    order = Window.partitionBy("key").orderBy(*_ITEM_ORDER)  # by the name that later windows use, or they shuffle again
    return items.select("key", F.row_number().over(order).alias("v"), "lon", "lat")


def _duck(expr: str) -> str:
    """The same expression with double literals written as casts."""
    import re

    return re.sub(r"(\d+\.?\d*)D\b", r"CAST(\1 AS DOUBLE)", expr)


VERTICES_SQL = f"""(
  SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ITEM_ORDER)}) AS v,
         round({_duck(_VERTEX_LON)}, 9) AS lon, round({_duck(_VERTEX_LAT)}, 9) AS lat FROM lineitem)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, v, lon1, lat1, lon2 and lat2 of neighbouring vertices; the window reuses the lines' shuffle."""
    order = Window.partitionBy("key").orderBy("v")
    rows = vertices(spark, sf_dir)
    return rows.select("key", "v", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lead("lon").over(order).alias("lon2"), F.lead("lat").over(order).alias("lat2"))


SEGMENTS_SQL = f"(SELECT key, v, lon AS lon1, lat AS lat1, lead(lon) OVER (PARTITION BY key ORDER BY v) AS lon2, lead(lat) OVER (PARTITION BY key ORDER BY v) AS lat2 FROM {VERTICES_SQL})"

_HALF = "p_size * 0.001D"


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, size, lon, lat, half and the rings of one square per part.

    Every third has a hole of half its size, every 17th an open ring, every 19th a bow tie.
    """
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS key", "p_size AS size", f"{_lon('p_partkey')} AS lon", f"{_lat('p_partkey')} AS lat", f"{_HALF} AS half")
    t = t.selectExpr("*", "round(lon - half, 9) AS x0", "round(lon + half, 9) AS x1", "round(lat - half, 9) AS y0", "round(lat + half, 9) AS y1")
    plain = "array(array(x0, y0), array(x1, y0), array(x1, y1), array(x0, y1), array(x0, y0))"
    shell = f"""CASE WHEN key % 17 = 0 THEN array(array(x0, y0), array(x1, y0), array(x1, y1), array(x0, y1))
      WHEN key % 19 = 0 THEN array(array(x0, y0), array(x1, y1), array(x1, y0), array(x0, y1), array(x0, y0)) ELSE {plain} END"""
    t = t.selectExpr("*", "round(lon - half / 2, 9) AS hx0", "round(lon + half / 2, 9) AS hx1", "round(lat - half / 2, 9) AS hy0", "round(lat + half / 2, 9) AS hy1")
    hole = "array(array(hx0, hy0), array(hx0, hy1), array(hx1, hy1), array(hx1, hy0), array(hx0, hy0))"
    return t.selectExpr("*", f"CASE WHEN key % 3 = 0 THEN array({shell}, {hole}) ELSE array({shell}) END AS rings")


SQUARES_SQL = f"""(
  SELECT *, round(lon - half / 2, 9) AS hx0, round(lon + half / 2, 9) AS hx1, round(lat - half / 2, 9) AS hy0, round(lat + half / 2, 9) AS hy1 FROM (
  SELECT *, round(lon - half, 9) AS x0, round(lon + half, 9) AS x1, round(lat - half, 9) AS y0, round(lat + half, 9) AS y1 FROM (
  SELECT p_partkey AS key, p_size AS size, {_lon("p_partkey")} AS lon, {_lat("p_partkey")} AS lat, {_duck(_HALF)} AS half FROM part)))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per user of the events: id, created_at and status."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("created_at")).selectExpr("user_id", "lpad(cast(user_id AS string), 12, '0') AS id", "created_at", "CASE WHEN user_id % 10 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status")


FILES_SQL = "(SELECT user_id, lpad(user_id::VARCHAR, 12, '0') AS id, min(ts) AS created_at, CASE WHEN user_id % 10 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM events GROUP BY user_id)"

_STATUS = "CASE event_type WHEN 'click' THEN 'MEASURED' WHEN 'purchase' THEN 'MEASURED' WHEN 'view' THEN 'NOT_APPLICABLE' WHEN 'signup' THEN 'UNSUPPORTED' ELSE 'ERROR' END"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature per event: clicks are lengths, purchases areas, the others have no measurement."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("feature_index", F.row_number().over(order) - 1)
    return rows.selectExpr(
        "user_id", "feature_index", "event_id", f"{_STATUS} AS measurement_status", "CASE WHEN event_type = 'purchase' THEN abs(value) END AS area_m2", "CASE WHEN event_type = 'click' THEN abs(value) END AS length_m", "value", "props"
    )


FEATURES_SQL = f"""(
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS feature_index, event_id, {_STATUS} AS measurement_status,
         CASE WHEN event_type = 'purchase' THEN abs(value) END AS area_m2, CASE WHEN event_type = 'click' THEN abs(value) END AS length_m, value, props FROM events)"""
