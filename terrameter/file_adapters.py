"""KML documents, zipped Shapefiles and their odd relatives made from relational tables.

The readers run on these bytes; ``*_SQL`` texts say in closed form what must come out, for another
engine.  Each file holds the parts of 50 neighbouring keys.
"""

from __future__ import annotations

import io
import stat
import struct
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as a
from .functions.crs import WGS84_WKT

PARTS = 50
KML_NAMESPACE = "http://www.opengis.net/kml/2.2"


def _with_content(rows: DataFrame) -> DataFrame:
    """Files spread over as many tasks as shuffles have; what makes them is small, and reading them is not."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return rows.select("path", F.length("content").cast("long").alias("length"), "content", "format")


def _coordinates(ring: str) -> str:
    return f"array_join(transform({ring}, p -> concat(p[0], ',', p[1])), ' ')"


def kml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a Placemark for each part: polygons with holes, points, lines, multiple points, models, none."""
    names = a.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    # both sides grow with the parts, and the files on disk look small: never broadcast
    rows = a.squares(spark, sf_dir).join(names.hint("merge"), F.col("key") == F.col("p_partkey"))
    boundary = lambda name, ring: f"concat('<{name}><LinearRing><coordinates>', {_coordinates(ring)}, '</coordinates></LinearRing></{name}>')"
    geometry = f"""CASE key % 6
      WHEN 0 THEN concat('<Polygon>', {boundary('outerBoundaryIs', 'rings[0]')}, {boundary('innerBoundaryIs', 'rings[1]')}, '</Polygon>')
      WHEN 1 THEN concat('<Point><altitudeMode>absolute</altitudeMode><coordinates>', lon, ',', lat, ',', size, '</coordinates></Point>')
      WHEN 2 THEN concat('<LineString><tessellate>1</tessellate><coordinates>\\n', lon, ',', lat, '\\t', lon + 0.001D, ',', lat + 0.001D, ' </coordinates></LineString>')
      WHEN 3 THEN concat('<MultiGeometry><Point><coordinates>', lon, ',', lat, '</coordinates></Point><Point><coordinates>0,0</coordinates></Point></MultiGeometry>')
      WHEN 4 THEN '<Model/>' ELSE '' END"""
    data = "concat('<Data name=\"size\"><value>', size, '</value></Data><Data name=\"size\"><value>', p_brand, '</value></Data><SchemaData><SimpleData name=\"type\">', p_type, '</SimpleData></SchemaData>', CASE WHEN key % 10 = 9 THEN '<Other/>' ELSE '' END)"
    place = f"concat('<Placemark id=\"p', key, '\"><name>', p_name, '</name><ExtendedData>', {data}, '</ExtendedData>', {geometry}, '</Placemark>')"
    rows = rows.selectExpr("key", f"CASE WHEN key % 7 = 0 THEN {place} ELSE concat('<Folder><name>F', key % 7, '</name>', {place}, '</Folder>') END AS body")
    files = rows.groupBy((F.col("key") / PARTS).cast("long").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "body"))), lambda x: x["body"]), "").alias("body"))
    text = F.concat(F.lit(f'<?xml version="1.0"?><kml xmlns="{KML_NAMESPACE}"><Document>'), "body", F.lit("</Document></kml>"))
    return _with_content(files.select(F.concat(F.lit("mem:/kml/"), F.col("file"), F.lit(".kml")).alias("path"), text.cast("binary").alias("content"), F.lit("KML").alias("format")))


_BOUNDS = "(x0 < -180 OR x1 > 180)"
KML_SQL = f"""(
  SELECT key, key // {PARTS} AS file, row_number() OVER (PARTITION BY key // {PARTS} ORDER BY key) - 1 AS feature_index, 'p' || key AS source_id,
    CASE key % 6 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'Point' WHEN 2 THEN 'LineString' WHEN 3 THEN 'MultiPoint' WHEN 4 THEN 'Model' END AS geometry_type,
    CASE WHEN key % 6 = 1 THEN 3 ELSE 2 END AS dimensions,
    CASE key % 6 WHEN 0 THEN CASE WHEN key % 17 = 0 OR key % 19 = 0 OR {_BOUNDS} THEN 'ERROR' ELSE 'MEASURED' END
      WHEN 1 THEN 'NOT_APPLICABLE' WHEN 2 THEN 'MEASURED' WHEN 3 THEN 'NOT_APPLICABLE' WHEN 4 THEN 'UNSUPPORTED' ELSE 'ERROR' END AS status,
    CASE WHEN key % 10 = 9 THEN 'UNSUPPORTED_EXTENDED_DATA,' ELSE '' END || CASE key % 6 WHEN 0 THEN CASE WHEN key % 17 = 0 THEN 'INVALID_RING' WHEN {_BOUNDS} THEN 'INVALID_WGS84_COORDINATE' WHEN key % 19 = 0 THEN 'INVALID_GEOMETRY' ELSE '' END
      WHEN 4 THEN 'UNSUPPORTED_GEOMETRY' WHEN 5 THEN 'MISSING_GEOMETRY' ELSE '' END AS codes,
    '[{{"name":"size","value":"' || size || '"}},{{"name":"size","value":"' || p_brand || '"}},{{"name":"type","value":"' || p_type || '"}}]' AS properties,
    CASE WHEN key % 7 <> 0 THEN 'F' || key % 7 END AS folder, p_name AS name, CASE key % 6 WHEN 1 THEN 'absolute' WHEN 2 THEN '1' END AS rendering
  FROM {a.SQUARES_SQL} JOIN part ON key = p_partkey)"""

# What nations' documents hold, and what becomes of them.
ODD_KML = [
    ("no document", None, "INVALID_DATASET", 422), ("broken", "<kml", "INVALID_KML", 422), ("another root", "<x/>", "INVALID_KML", 422),
    ("a document type", f'<!DOCTYPE kml [<!ENTITY a "b">]><kml xmlns="{KML_NAMESPACE}"/>', "INVALID_KML", 422), ("empty", f'<kml xmlns="{KML_NAMESPACE}"/>', None, None),
    ("a link", f'<kml xmlns="{KML_NAMESPACE}"><NetworkLink/></kml>', "NETWORK_LINK_UNSUPPORTED", 422), ("an include", f'<kml xmlns="{KML_NAMESPACE}" xmlns:x="http://www.w3.org/2001/XInclude"><x:include/></kml>', "XINCLUDE_UNSUPPORTED", 422),
    ("a foreign Placemark", f'<kml xmlns="{KML_NAMESPACE}"><Placemark xmlns="other"/></kml>', "INVALID_KML_NAMESPACE", 422), ("deep", f'<kml xmlns="{KML_NAMESPACE}">{"<Folder>" * 64}{"</Folder>" * 64}</kml>', "XML_DEPTH_LIMIT", 413),
    ("a long text", f'<kml xmlns="{KML_NAMESPACE}"><name>{"x" * 65_537}</name></kml>', "XML_TEXT_LIMIT", 413), ("large", "LARGE", "UPLOAD_TOO_LARGE", 413), ("another format", "FORMAT", "UNSUPPORTED_FORMAT", 415),
]


def odd_kml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each nation, each of one kind of ``ODD_KML``."""
    kinds = spark.createDataFrame([(i, text) for i, (_, text, _, _) in enumerate(ODD_KML)], "kind int, text string")
    rows = a.table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"cast(n_nationkey % {len(ODD_KML)} AS int) AS kind").join(F.broadcast(kinds), "kind")  # a row of each kind
    large = F.concat(F.lit(f'<kml xmlns="{KML_NAMESPACE}"/>'), F.repeat(F.lit(" "), 12_000_000))
    content = F.when(F.col("text") == "LARGE", large).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    return _with_content(rows.select(F.concat(F.lit("mem:/odd/"), F.col("n_nationkey"), F.when(F.col("text") == "FORMAT", ".txt").otherwise(".KML")).alias("path"), content.alias("content"), F.when(F.col("text").isNull() | (F.col("text") != "FORMAT"), "KML").alias("format")))


ODD_KML_SQL = f"SELECT n_nationkey, code, status, http_status FROM nation JOIN (VALUES {', '.join(f'''({i}, {'NULL' if c is None else repr(c)}, '{'COMPLETED' if c is None else 'FAILED'}', {'NULL' if h is None else h})''' for i, (_, _, c, h) in enumerate(ODD_KML))}) AS k(kind, code, status, http_status) ON n_nationkey % {len(ODD_KML)} = kind"


# ---- Shapefiles


def shape_record(code: int, points: list[tuple[float, float]], parts: Iterable[int] = (), z: list[float] | None = None, m: list[float] | None = None) -> bytes:
    """The content of one main file record."""
    if code == 0:
        return struct.pack("<i", 0)
    flat, parts = [v for p in points for v in p], list(parts)
    if code % 10 == 1 and code < 30:
        return struct.pack(f"<i{len(flat) + len(z or []) + len(m or [])}d", code, *flat, *(z or []), *(m or []))
    counts = struct.pack("<i", len(points)) if code % 10 == 8 else struct.pack(f"<2i{len(parts)}i", len(parts), len(points), *parts)
    types = struct.pack(f"<{len(parts)}i", *[0] * len(parts)) if code == 31 else b""
    ordinates = b"".join(struct.pack(f"<2d{len(v)}d", 0, 0, *v) for v in (z, m) if v is not None)
    return struct.pack("<i4d", code, 0, 0, 0, 0) + counts + types + struct.pack(f"<{len(flat)}d", *flat) + ordinates


def main_file(records: list[bytes]) -> bytes:
    body = b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def attribute_table(fields: list[tuple[str, str, int, int]], rows: list[tuple[bool, list[bytes]]], driver: int) -> bytes:
    """fields: name, type, width and decimals; rows: whether deleted, and the raw values."""
    head = struct.pack("<4BIHH", 3, 0, 0, 0, len(rows), 33 + 32 * len(fields), 1 + sum(f[2] for f in fields)) + b"\0" * 17 + bytes([driver]) + b"\0\0"
    head += b"".join(name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, decimals]) + b"\0" * 14 for name, kind, width, decimals in fields)
    body = b"".join((b"*" if gone else b" ") + b"".join(v.rjust(w) if k in "NF" else v.ljust(w) for v, (_, k, w, _) in zip(values, fields, strict=True)) for gone, values in rows)
    return head + b"\r" + body + b"\x1a"


def zipped(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return out.getvalue()


_FIELDS = [("id", "N", 10, 0), ("city", "C", 12, 0), ("big", "N", 20, 0), ("ratio", "F", 12, 3), ("day", "D", 8, 0), ("flag", "L", 1, 0)]


def _part_shape(key: int, lon: float, lat: float, half: float, size: int) -> bytes:
    box = lambda x, y, h: [(x - h, y - h), (x - h, y + h), (x + h, y + h), (x + h, y - h), (x - h, y - h)]  # clockwise
    shell = box(lon, lat, half)
    kind = key % 6
    if kind == 0:
        return shape_record(5, shell + (box(lon, lat, half / 2)[::-1] if key % 12 == 0 else box(lon + 3 * half, lat, half)), [0, 5])
    if kind == 1:
        return shape_record(3, shell[:4], [0, 2] if key % 12 == 7 else [0])
    if kind == 2:
        return shape_record(11, [(lon, lat)], z=[float(size)], m=[-1e39 if key % 24 == 2 else 2.0 * size])
    if kind == 3:
        return shape_record(0, [])
    return shape_record(31, shell, [0]) if kind == 4 else shape_record(8, shell[:2])


def shapefile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with a record for each part; every 13th record is deleted."""
    rows = a.squares(spark, sf_dir).select("key", (F.col("lon") * 0.99).alias("lon"), "lat", "half", "size").withColumn("file", (F.col("key") / PARTS).cast("long"))

    def pack(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("key")
        shapes = [_part_shape(int(r.key), r.lon, r.lat, r.half, int(r.size)) for r in table.itertuples(index=False)]
        raw = [(int(k) % 13 == 0, [str(k).encode(), f"é{k}".encode("cp1252"), str(2**53 + k if k % 8 == 1 else k).encode(), b"" if k % 4 == 0 else f"{k / 8:.3f}".encode(), b"20240229", b"?TF"[k % 3 : k % 3 + 1]]) for k in table["key"].tolist()]
        prefix = "wrap/layer" if int(table["file"].iloc[0]) % 2 else "./layer"
        content = zipped({f"{prefix}.shp": main_file(shapes), f"{prefix}.shx": b"", f"{prefix}.DBF": attribute_table(_FIELDS, raw, 3), f"{prefix}.prj": WGS84_WKT.encode(), f"{prefix}.shp.xml": b"<x/>"})
        return pd.DataFrame({"path": [f"mem:/shp/{table['file'].iloc[0]}.zip"], "content": [content], "format": ["SHAPEFILE"]})

    return _with_content(rows.groupBy("file").applyInPandas(pack, "path string, content binary, format string"))


SHAPEFILE_SQL = f"""(
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY key) - 1 AS feature_index FROM (
  SELECT key, key // {PARTS} AS file, key % 13 = 0 AS deleted, (row_number() OVER (PARTITION BY key // {PARTS} ORDER BY key) - 1)::VARCHAR AS source_id,
    CASE key % 6 WHEN 0 THEN CASE WHEN key % 12 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END WHEN 1 THEN CASE WHEN key % 12 = 7 THEN 'MultiLineString' ELSE 'LineString' END WHEN 2 THEN 'Point' WHEN 4 THEN 'MultiPatch' WHEN 5 THEN 'MultiPoint' END AS geometry_type,
    CASE key % 6 WHEN 2 THEN 4 WHEN 4 THEN 3 ELSE 2 END AS dimensions,
    CASE key % 6 WHEN 0 THEN 'MEASURED' WHEN 1 THEN 'MEASURED' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'UNSUPPORTED' ELSE 'NOT_APPLICABLE' END AS status,
    CASE WHEN key % 8 = 1 THEN 'INTEGER_PROPERTY_STRINGIFIED,' ELSE '' END || CASE WHEN key % 24 = 2 THEN 'NONFINITE_MEASURE_NULL' WHEN key % 6 = 3 THEN 'MISSING_GEOMETRY' WHEN key % 6 = 4 THEN 'UNSUPPORTED_SHAPE_TYPE' ELSE '' END AS codes,
    '[{{"name":"id","value":' || key || '}},{{"name":"city","value":"é' || key || '"}},{{"name":"big","value":' || CASE WHEN key % 8 = 1 THEN '"' || (9007199254740992 + key) || '"' ELSE key::VARCHAR END
      || '}},{{"name":"ratio","value":' || CASE WHEN key % 4 = 0 THEN 'null' ELSE (key / 8.0)::DOUBLE::VARCHAR END || '}},{{"name":"day","value":"2024-02-29"}},{{"name":"flag","value":' || CASE key % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'true' ELSE 'false' END || '}}]' AS properties,
    CASE WHEN key % 6 = 2 THEN CASE WHEN key % 24 = 2 THEN '[null]' ELSE '[' || (2.0 * size)::DOUBLE || ']' END END AS measures
  FROM {a.SQUARES_SQL}) WHERE NOT deleted)"""

# What nations' archives hold beside or instead of a dataset's parts, and what becomes of them.
ODD_ARCHIVES: list[tuple[str, dict, str | None]] = [
    ("whole", {}, None), ("a traversal", {"add": ["../x.qix"]}, "UNSAFE_ARCHIVE_PATH"), ("an absolute path", {"add": ["/x.qix"]}, "UNSAFE_ARCHIVE_PATH"), ("a drive", {"add": ["C:/x"]}, "UNSAFE_ARCHIVE_PATH"),
    ("no CRS", {"less": [".prj", ".dbf"]}, "MISSING_SHAPEFILE_CRS"), ("no table", {"less": [".dbf"]}, "MISSING_SHAPEFILE_COMPONENT"), ("no shapes", {"less": [".shp"]}, "MISSING_SHAPEFILE"), ("two datasets", {"add": ["other.shp"]}, "MULTIPLE_SHAPEFILES"),
    ("a text", {"add": ["notes.txt"]}, "UNRECOGNIZED_ARCHIVE_PAYLOAD"), ("other metadata", {"add": ["notes.xml"]}, "UNRECOGNIZED_ARCHIVE_PAYLOAD"), ("one path twice", {"add": ["LAYER.SHP"]}, "DUPLICATE_ARCHIVE_PATH"), ("a folder", {"add": ["else/"]}, "UNRECOGNIZED_ARCHIVE_DIRECTORY"),
    ("many entries", {"add": [f"._{i}" for i in range(64)]}, "ARCHIVE_ENTRY_LIMIT"), ("hidden files and index", {"add": ["__MACOSX/", "__MACOSX/._layer", ".DS_Store", "layer.qix", "layer.xml"]}, None), ("no archive", {"raw": b"text"}, "INVALID_ARCHIVE"),
    ("another CRS", {"prj": b'LOCAL_CS["x"]'}, "UNSUPPORTED_SHAPEFILE_CRS"), ("no CRS text", {"prj": b"nonsense"}, "INVALID_SHAPEFILE_CRS"), ("an odd code page", {"cpg": b"9999"}, "UNSUPPORTED_DBF_ENCODING"), ("a cut table", {"rows": 0}, "CORRUPT_SHAPEFILE"),
    ("a large CRS", {"prj": b" " * 65_537}, "COMPONENT_SIZE_LIMIT"), ("an expansion", {"add": ["layer.sbn"], "size": 51 * 1024 * 1024}, "EXPANDED_ARCHIVE_LIMIT"), ("a code page", {"cpg": b"UTF-8"}, None), ("below a folder", {"folder": "a/b/"}, None),
]


def _odd_archive(kind: int) -> bytes:
    how = ODD_ARCHIVES[kind][1]
    if "raw" in how:
        return how["raw"]
    parts = {".shp": main_file([shape_record(1, [(1.0, 2.0)])]), ".shx": b"", ".dbf": attribute_table([("id", "N", 4, 0)], [(False, [b"1"])][: how.get("rows", 1)], 3), ".prj": how.get("prj", WGS84_WKT.encode())}
    parts |= {".cpg": how["cpg"]} if "cpg" in how else {}
    entries = {f"{how.get('folder', '')}layer{s}": c for s, c in parts.items() if s not in how.get("less", ())}
    return zipped(entries | {name: b"" if name.endswith("/") else b"\0" * how.get("size", 1) for name in how.get("add", ())})


def odd_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each nation, each of one kind of ``ODD_ARCHIVES``."""
    contents = spark.createDataFrame([(i, _odd_archive(i)) for i in range(len(ODD_ARCHIVES))], "kind int, content binary")
    rows = a.table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"cast(n_nationkey % {len(ODD_ARCHIVES)} AS int) AS kind").join(F.broadcast(contents), "kind")  # a row of each kind
    return _with_content(rows.select(F.concat(F.lit("mem:/odd/"), F.col("n_nationkey"), F.lit(".zip")).alias("path"), "content", F.lit("SHAPEFILE").alias("format")))


ODD_ARCHIVES_SQL = f"SELECT n_nationkey, code, CASE WHEN code IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN code IS NOT NULL THEN CASE WHEN code LIKE '%LIMIT' THEN 413 ELSE 422 END END AS http_status FROM nation JOIN (VALUES {', '.join(f'''({i}, {'NULL' if c is None else repr(c)})''' for i, (_, _, c) in enumerate(ODD_ARCHIVES))}) AS k(kind, code) ON n_nationkey % {len(ODD_ARCHIVES)} = kind"


# How an entry beside a whole dataset is marked or damaged, and what becomes of the archive.
ODD_ENTRIES: list[tuple[str, dict, str | None]] = [
    ("plain", {}, None), ("encrypted", {"flag": 1}, "ENCRYPTED_ARCHIVE_ENTRY"), ("a link", {"mode": stat.S_IFLNK | 0o777}, "UNSAFE_ARCHIVE_ENTRY"), ("a pipe", {"mode": stat.S_IFIFO | 0o644}, "UNSAFE_ARCHIVE_ENTRY"),
    ("a file marked as a directory", {"mode": stat.S_IFDIR | 0o755}, "UNSAFE_ARCHIVE_ENTRY"), ("a directory marked as a file", {"name": "__MACOSX/", "mode": stat.S_IFREG | 0o644}, "UNSAFE_ARCHIVE_ENTRY"), ("another compression", {"method": zipfile.ZIP_BZIP2}, "UNSUPPORTED_COMPRESSION"),
    ("a directory with a payload", {"name": "__MACOSX/", "content": b"x" * 100}, None), ("a directory with a large payload", {"name": "__MACOSX/", "content": b"\0" * (51 * 1024 * 1024)}, "EXPANDED_ARCHIVE_LIMIT"), ("damaged bytes", {"damage": True, "content": bytes(range(256)) * 8}, "CORRUPT_ARCHIVE_ENTRY"),
    ("a plain file", {"mode": stat.S_IFREG | 0o644}, None),
]


def _archive_with_entry(kind: int) -> bytes:
    """A dataset of one point behind an entry that is marked as the kind says."""
    how, out = ODD_ENTRIES[kind][1], io.BytesIO()
    content = how.get("content", b"" if how.get("name", "").endswith("/") else b"x")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        info = zipfile.ZipInfo(how.get("name", "layer.qix"))
        info.compress_type, info.external_attr = how.get("method", zipfile.ZIP_DEFLATED), how.get("mode", 0) << 16
        z.writestr(info, content)
        for name, part in {".shp": main_file([shape_record(1, [(1.0, 2.0)])]), ".shx": b"", ".dbf": attribute_table([("id", "N", 4, 0)], [(False, [b"1"])], 3), ".prj": WGS84_WKT.encode()}.items():
            z.writestr(f"layer{name}", part)
    data = bytearray(out.getvalue())
    if "flag" in how:
        data[data.index(b"PK\1\2") + 8] |= how["flag"]
    if how.get("damage"):
        data[60] ^= 0xFF  # within the first entry's bytes
    return bytes(data)


def archives_with_odd_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each supplier, with an entry of one kind of ``ODD_ENTRIES``."""
    contents = spark.createDataFrame([(i, _archive_with_entry(i)) for i in range(len(ODD_ENTRIES))], "kind int, content binary")
    rows = a.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"cast(s_suppkey % {len(ODD_ENTRIES)} AS int) AS kind").join(F.broadcast(contents), "kind")  # a row of each kind
    return _with_content(rows.select(F.concat(F.lit("mem:/entries/"), F.col("s_suppkey"), F.lit(".zip")).alias("path"), "content", F.lit("SHAPEFILE").alias("format")))


ODD_ENTRIES_SQL = f"SELECT s_suppkey, code, CASE WHEN code IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN code IS NULL THEN 1 END::BIGINT AS features FROM supplier JOIN (VALUES {', '.join(f'({i}, {repr(c) if c else "NULL"})' for i, (_, _, c) in enumerate(ODD_ENTRIES))}) AS k(kind, code) ON s_suppkey % {len(ODD_ENTRIES)} = kind"
