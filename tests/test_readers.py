"""KML and zipped Shapefile readers on documents and archives made here."""

from __future__ import annotations

import io
import math
import random
import re
import struct
import tracemalloc
import zipfile

import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from terrameter.functions.crs import WGS84_WKT, crs_from_wkt
from terrameter.model import SOURCE_FEATURE, Limits
from terrameter.sources import files as reading
from terrameter.sources import kml as kml_reader
from terrameter.sources import shapefile
from terrameter.sources.common import FileFailure
from terrameter.sources.files import read_dataset
from terrameter.sources.kml import parse_coordinates, read_kml
from terrameter.sources.shapefile import read_shapefile, shape_kind, winding

NS = "http://www.opengis.net/kml/2.2"
RING = "0,0 0.01,0 0.01,0.01 0,0.01 0,0"


def kml(body: str, head: str = "") -> bytes:
    return f'<?xml version="1.0"?>{head}<kml xmlns="{NS}" xmlns:gx="http://www.google.com/kml/ext/2.2"><Document>{body}</Document></kml>'.encode()


def polygon(outer=RING, inner=()):
    part = lambda name, ring: f"<{name}><LinearRing><coordinates>{ring}</coordinates></LinearRing></{name}>"
    return f"<Polygon>{part('outerBoundaryIs', outer)}{''.join(part('innerBoundaryIs', r) for r in inner)}</Polygon>"


def place(body: str, **attributes: str) -> str:
    return f"<Placemark {' '.join(f'{k}={v!r}' for k, v in attributes.items())}>{body}</Placemark>"


def one(body: str, limits: Limits = Limits()):
    (feature,) = read_kml(kml(place(body)), limits).features
    return feature


def code_of(body: str) -> list[str]:
    return [i["code"] for i in one(body).issues]


def test_placemarks_are_read_one_at_a_time():
    """A document near the limit: memory is that of one Placemark, not of the tree; the whole is checked before the first feature."""
    body = "<Folder>" + place(polygon() + "<description>" + "x" * 1500 + "</description>") * 4900 + "<name>late</name></Folder>"
    data = kml(body)
    assert len(data) > 8_000_000
    tracemalloc.start()
    try:
        found = read_kml(data)
        count = sum(f.metadata["folder_path"] == ["late"] and f.geometry_type == "Polygon" for f in found.features)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert count == 4900 and peak < 2_000_000
    with pytest.raises(FileFailure) as why:
        read_kml(data.replace(b"</Folder>", b"</Folder><NetworkLink/>"))
    assert why.value.code == "NETWORK_LINK_UNSUPPORTED"


def test_pieces_of_any_size_give_the_same_features(monkeypatch):
    body = "<Document><name>d</name><Folder><name>a<b>b</b></name><name>no</name><Folder>" + place(polygon() + "<name>é😀</name>") + "</Folder>" + place(polygon()) + "</Folder><Folder/></Document>" + place("<Point><coordinates>1,2</coordinates></Point>")
    whole = list(read_kml(kml(body)).features)
    assert [f.metadata["folder_path"] for f in whole] == [["ab"], ["ab"], []]
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(kml_reader, "PIECE", size)
        assert list(read_kml(kml(body)).features) == whole
    monkeypatch.undo()
    nested = "<Folder><name>f</name>" + place(place("<Point><coordinates>1,2</coordinates></Point>") + "<Point><coordinates>3,4</coordinates></Point>") + "</Folder>" + place("")
    assert [(f.metadata["folder_path"], f.coordinates) for f in read_kml(kml(nested)).features] == [([], 1), ([], 1), ([], 0)]


def test_folders_ids_and_ordered_properties():
    data = "<ExtendedData><Data name='a'><value>001</value></Data><Data name='a'><value>true</value></Data><Data name='e'/><SchemaData><SimpleData name='s'>東京</SimpleData></SchemaData></ExtendedData>"
    body = f"<Folder><name>Outer</name><Folder><name>Inner</name>{place('<name>N</name><styleUrl>#x</styleUrl>' + data + polygon(), id='p1')}</Folder></Folder>{place('')}"
    first, second = read_kml(kml(body)).features
    assert first.source_id == "p1" and first.metadata["folder_path"] == ["Outer", "Inner"] and first.metadata["name"] == "N"
    assert first.metadata["rendering"] == [{"name": "styleUrl", "value": "#x"}]
    assert [(p["name"], p["value"]) for p in first.properties] == [("a", "001"), ("a", "true"), ("e", ""), ("s", "東京")]
    assert second.metadata["folder_path"] == [] and second.geometry is None


def test_geometries():
    assert one("<Point><coordinates>1,2,3</coordinates></Point>").geometry == {"type": "Point", "coordinates": [1.0, 2.0, 3.0]}
    holes = one(polygon("0,0 9,0 9,9 0,9 0,0", ["1,1 1,2 2,2 1,1"])).geometry
    assert len(holes["coordinates"]) == 2
    two = "<MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry>"
    assert one(two).geometry["type"] == "MultiPoint"
    mixed = two.replace("</MultiGeometry>", "<LineString><coordinates>0,0 1,1</coordinates></LineString></MultiGeometry>")
    assert one(mixed).geometry_type == "GeometryCollection"


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("<Model/>", "UNSUPPORTED_GEOMETRY"), ("<gx:Track/>", "UNSUPPORTED_GEOMETRY"), (polygon() + "<Point><coordinates>1,2</coordinates></Point>", "UNSUPPORTED_GEOMETRY"),
        ("<Polygon/>", "MALFORMED_POLYGON_BOUNDARIES"), (polygon("0,0 1,0 1,1 0,1"), "INVALID_RING"), (polygon("0,0 1,0 1,x 0,0"), "INVALID_COORDINATE"), (polygon("0,0 nan,0 1,1 0,0"), "INVALID_COORDINATE"),
        ("<Point><coordinates>1,2 3,4</coordinates></Point>", "KML_COORDINATE_MISMATCH"), ("<LineString><coordinates>1;2</coordinates></LineString>", "MALFORMED_GEOMETRY"),
        ("<ExtendedData><Other/></ExtendedData>" + polygon(), "UNSUPPORTED_EXTENDED_DATA"),
    ],
)
def test_feature_issues(body, code):
    assert code_of(body) == [code]


@pytest.mark.parametrize(
    ("data", "code", "limits"),
    [
        (kml("", '<!DOCTYPE kml [<!ENTITY a "b">]>'), "INVALID_KML", {}), (b"<kml", "INVALID_KML", {}), (b"<x/>", "INVALID_KML", {}), (kml("<NetworkLink/>"), "NETWORK_LINK_UNSUPPORTED", {}),
        (kml('<x:include xmlns:x="http://www.w3.org/2001/XInclude"/>'), "XINCLUDE_UNSUPPORTED", {}), (kml('<Placemark xmlns="other"/>'), "INVALID_KML_NAMESPACE", {}), (kml("<Folder>" * 70 + "</Folder>" * 70), "XML_DEPTH_LIMIT", {}),
        (kml("<name>" + "x" * 70_000 + "</name>"), "XML_TEXT_LIMIT", {}), (kml(place(polygon()) * 3), "FEATURE_LIMIT", {"features": 2}), (kml(place(polygon())), "FILE_COORDINATE_LIMIT", {"file_coordinates": 4}),
        (kml("<a/>" * 50), "XML_ELEMENT_LIMIT", {"xml_elements": 20}), (kml(""), "UPLOAD_TOO_LARGE", {"upload_bytes": 10}), (b"", "INVALID_DATASET", {}),
    ],
)
def test_file_failures(data, code, limits):
    with pytest.raises(FileFailure) as why:
        read_dataset(data, "KML", Limits(**limits))
    assert why.value.code == code and why.value.http_status == (413 if "LIMIT" in code or "LARGE" in code else 422)


def test_warnings_and_caps():
    assert [w["code"] for w in read_kml(kml("<GroundOverlay/>")).warnings] == ["EMPTY_DATASET", "UNSUPPORTED_DOCUMENT_CONTENT"]
    big = one("<ExtendedData>" + "".join(f"<Data name='n{i}'><value>{'v' * 900}</value></Data>" for i in range(90)) + "<Bad/></ExtendedData>")
    assert big.properties == [] and [i["code"] for i in big.issues] == ["PROPERTY_LIMIT_EXCEEDED"] and big.metadata["properties_omitted"]
    many = one(f"<LineString><coordinates>{'1,2 ' * 30}</coordinates></LineString>", Limits(feature_coordinates=20))
    assert many.status == "ERROR" and many.issues[0]["code"] == "FEATURE_COORDINATE_LIMIT" and many.geometry is None
    shown = one("".join(f"<styleUrl>{i}</styleUrl>" for i in range(140))).metadata["rendering"]
    assert len(shown) == 128 and shown[-1] == {"name": "additional_metadata_omitted", "value": "13"}
    assert parse_coordinates(" 1,2\n3,4,5 ") == [[1.0, 2.0], [3.0, 4.0, 5.0]] and parse_coordinates("1,,2") is None and parse_coordinates("1,2,3,4") is None


# ---- a small Shapefile writer


def shape(code: int, points, parts=(), z=None, m=None) -> bytes:
    if code == 0:
        return struct.pack("<i", 0)
    base = code % 10
    flat = [v for p in points for v in p]
    if base == 1 and code != 31:
        return struct.pack(f"<i{len(flat) + len(z or []) + len(m or [])}d", code, *flat, *(z or []), *(m or []))
    box = struct.pack("<4d", 0, 0, 0, 0)
    head = struct.pack("<i", len(points)) if base == 8 else struct.pack(f"<2i{len(parts)}i", len(parts), len(points), *parts)
    head += struct.pack(f"<{len(parts)}i", *[0] * len(parts)) if code == 31 else b""
    out = struct.pack("<i", code) + box + head + struct.pack(f"<{len(flat)}d", *flat)
    for extra in (z, m):
        if extra is not None:
            out += struct.pack(f"<2d{len(extra)}d", 0, 0, *extra)
    return out


def shp(bodies) -> bytes:
    records = b"".join(struct.pack(">2i", i + 1, len(b) // 2) + b for i, b in enumerate(bodies))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    return head + records


def dbf(rows, fields=(("id", "N", 8, 0),), ldid=0, deleted=(), codec="utf-8") -> bytes:
    width = 1 + sum(f[2] for f in fields)
    head = struct.pack("<4BIHH", 3, 0, 0, 0, len(rows), 33 + 32 * len(fields), width) + b"\0" * 17 + bytes([ldid]) + b"\0\0"
    for name, kind, size, decimals in fields:
        head += name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([size, decimals]) + b"\0" * 14
    body = b""
    for i, row in enumerate(rows):
        body += b"*" if i in deleted else b" "
        for value, (_, kind, size, _) in zip(row, fields, strict=True):
            raw = value if isinstance(value, bytes) else str(value).encode(codec)
            body += raw.rjust(size) if kind == "N" else raw.ljust(size)
    return head + b"\r" + body + b"\x1a"


def archive(bodies, rows=None, extra=None, leave_out=(), folder="", prj=WGS84_WKT, **table) -> bytes:
    files = {".shp": shp(bodies), ".shx": b"", ".dbf": dbf(rows if rows is not None else [[i] for i in range(len(bodies))], **table), ".prj": prj.encode()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for suffix, content in files.items():
            if suffix not in leave_out:
                z.writestr(f"{folder}data{suffix}", content)
        for name, content in (extra or {}).items():
            z.writestr(name, content)
    return out.getvalue()


CLOCKWISE = [(0, 0), (0, 0.02), (0.02, 0.02), (0.02, 0), (0, 0)]
COUNTER = [(0.005, 0.005), (0.015, 0.005), (0.015, 0.015), (0.005, 0.015), (0.005, 0.005)]


def test_points_with_wrapper_directory_and_deleted_records():
    points = [shape(1, [(77.5 + 0.001 * i, 12.9)]) for i in range(4)]
    data = read_shapefile(archive(points, [[f"P-{i}"] for i in range(4)], folder="wrap/", fields=(("parcel", "C", 20, 0),), deleted=(1,)))
    assert [f.source_id for f in data.features] == ["0", "2", "3"] and data.deleted == 1
    assert data.features[1].properties == [{"name": "parcel", "value": "P-2"}]
    assert [w["code"] for w in data.warnings] == ["UTF8_ENCODING_ASSUMED", "DELETED_DBF_RECORDS"]


def test_shell_and_hole():
    (feature,) = read_shapefile(archive([shape(5, CLOCKWISE + COUNTER, [0, 5])])).features
    assert feature.geometry["type"] == "Polygon" and len(feature.geometry["coordinates"]) == 2 and feature.extra_work > 0
    (orphan,) = read_shapefile(archive([shape(5, COUNTER, [0])])).features
    assert [i["code"] for i in orphan.issues] == ["AMBIGUOUS_RING_ROLE"] and orphan.source_parts
    far = [(x + 1, y) for x, y in CLOCKWISE]
    (two,) = read_shapefile(archive([shape(5, CLOCKWISE + far, [0, 5])])).features
    assert two.geometry["type"] == "MultiPolygon"
    (open_,) = read_shapefile(archive([shape(5, CLOCKWISE[:-1], [0])])).features
    assert [i["code"] for i in open_.issues] == ["INVALID_RING"]
    (polar,) = read_shapefile(archive([shape(5, [(-135, 89), (-45, 89), (45, 89), (135, 89), (-135, 89)], [0])])).features
    assert [i["code"] for i in polar.issues] == ["AMBIGUOUS_RING_ROLE"]
    (budget,) = read_shapefile(archive([shape(5, CLOCKWISE + COUNTER, [0, 5])]), Limits(generated_feature_coordinates=10)).features
    assert [i["code"] for i in budget.issues] == ["GENERATED_COORDINATE_LIMIT"]


def test_z_and_m_and_large_integers():
    (feature,) = read_shapefile(archive([shape(11, [(77.5, 12.9)], z=[123.4], m=[987.6])], [[2**53]], fields=(("id", "N", 20, 0),))).features
    assert feature.geometry["coordinates"] == [77.5, 12.9, 123.4] and feature.dimensions == 4
    assert feature.metadata["source_measure_values"] == [987.6] and feature.properties[0]["value"] == str(2**53)
    assert [i["code"] for i in feature.issues] == ["INTEGER_PROPERTY_STRINGIFIED"]
    (gap,) = read_shapefile(archive([shape(23, [(0, 0), (1, 1)], [0], m=[1.0, -1e39])])).features
    assert [i["code"] for i in gap.issues] == ["NONFINITE_MEASURE_NULL"]


@pytest.mark.parametrize(
    ("body", "code"),
    [
        (shape(31, [(0, 0)], [0]), "UNSUPPORTED_SHAPE_TYPE"), (struct.pack("<i", 99), "UNSUPPORTED_SHAPE_TYPE"), (shape(3, [(0, 0), (1, 1)], [1]), "INVALID_PART_OFFSETS"), (shape(3, [(0, 0), (1, 1), (2, 2)], [0, 2]), "INVALID_LINE_PART"),
        (shape(8, [(0, 0)] * 129), "COMPONENT_LIMIT"), (shape(3, [(0, i) for i in range(258)], list(range(0, 258, 2))), "COMPONENT_LIMIT"), (shape(13, [(0, 0), (1, 1)], [0]), "INVALID_Z_VALUES"),
        (shape(1, [(float("nan"), 0)]), "NON_FINITE_COORDINATE"), (shape(13, [(0, 0), (1, 1)], [0], z=[0, float("inf")]), "NON_FINITE_COORDINATE"),
    ],
)
def test_shape_issues(body, code):
    (feature,) = read_shapefile(archive([body])).features
    assert [i["code"] for i in feature.issues] == [code] and feature.geometry is None


def test_encodings():
    city = (("city", "C", 20, 0),)
    assert read_shapefile(archive([shape(1, [(0, 0)])], [["東京"]], {"data.cpg": "UTF-8"}, fields=city)).features[0].properties[0]["value"] == "東京"
    assert read_shapefile(archive([shape(1, [(0, 0)])], [["é"]], fields=city, ldid=3, codec="cp1252")).features[0].properties[0]["value"] == "é"
    for extra, rows, code in (({"data.cpg": "cp9999"}, [["a"]], "UNSUPPORTED_DBF_ENCODING"), ({"data.cpg": "UTF-8"}, [[b"\xff\xfe"]], "DBF_DECODE_ERROR")):
        with pytest.raises(FileFailure) as why:
            read_shapefile(archive([shape(1, [(0, 0)])], rows, extra, fields=city))
        assert why.value.code == code


@pytest.mark.parametrize(
    ("keywords", "code"),
    [
        ({"leave_out": [".prj", ".dbf"]}, "MISSING_SHAPEFILE_CRS"), ({"leave_out": [".dbf"]}, "MISSING_SHAPEFILE_COMPONENT"), ({"leave_out": [".shp"]}, "MISSING_SHAPEFILE"), ({"extra": {"other.shp": b""}}, "MULTIPLE_SHAPEFILES"),
        ({"extra": {"notes.txt": b""}}, "UNRECOGNIZED_ARCHIVE_PAYLOAD"), ({"extra": {"../x.shp": b""}}, "UNSAFE_ARCHIVE_PATH"), ({"extra": {"C:/x": b""}}, "UNSAFE_ARCHIVE_PATH"), ({"extra": {"DATA.SHP": b""}}, "DUPLICATE_ARCHIVE_PATH"),
        ({"extra": {"else/": b""}}, "UNRECOGNIZED_ARCHIVE_DIRECTORY"), ({"extra": {f"x{i}.xml": b"" for i in range(64)}}, "ARCHIVE_ENTRY_LIMIT"),
        ({"extra": {"meta.xml": b""}}, "UNRECOGNIZED_ARCHIVE_PAYLOAD"), ({"extra": {"__MACOSX/notes.txt": b""}}, "UNRECOGNIZED_ARCHIVE_PAYLOAD"), ({"extra": {"._other.shp": b""}}, "MULTIPLE_SHAPEFILES"), ({"extra": {"/data.qix": b""}}, "UNSAFE_ARCHIVE_PATH"),
        ({"extra": {"a/../data.qix": b""}}, "UNSAFE_ARCHIVE_PATH"), ({"extra": {"./": b"", "x" * 256: b""}}, "UNSAFE_ARCHIVE_PATH"), ({"extra": {".//data.qix": b"", "data.qix": b""}}, "DUPLICATE_ARCHIVE_PATH"), ({"folder": "wrap/", "extra": {"wrapper/": b""}}, "UNRECOGNIZED_ARCHIVE_DIRECTORY"), ({"prj": "nonsense"}, "INVALID_SHAPEFILE_CRS"), ({"prj": 'LOCAL_CS["x"]'}, "UNSUPPORTED_SHAPEFILE_CRS"),
        ({"rows": []}, "CORRUPT_SHAPEFILE"),
    ],
)
def test_archives(keywords, code):
    with pytest.raises(FileFailure) as why:
        read_shapefile(archive([shape(1, [(0, 0)])], **keywords))
    assert why.value.code == code


def test_archive_limits_and_ignored_files():
    with pytest.raises(FileFailure) as why:
        read_shapefile(b"no archive")
    assert why.value.code == "INVALID_ARCHIVE"
    with pytest.raises(FileFailure) as why:
        read_shapefile(archive([shape(1, [(0, 0)])], extra={"data.xml": b"x" * 5000}), Limits(expanded_bytes=2000))
    assert why.value.code == "EXPANDED_ARCHIVE_LIMIT"
    with pytest.raises(FileFailure) as why:
        read_shapefile(archive([shape(1, [(0, 0)])] * 3), Limits(file_coordinates=2))
    assert why.value.code == "FILE_COORDINATE_LIMIT"
    assert len(read_shapefile(archive([shape(1, [(0, 0)])], extra={"__MACOSX/._data": b"", ".DS_Store": b"", "data.qix": b"", "data.xml": b"", "data.shp.xml": b"", "__MACOSX/": b"", "./": b""})).features) == 1
    for folder in ("./", "d//", "D/./e/", "a\\b/"):  # paths that name one place
        assert len(read_shapefile(archive([shape(1, [(0, 0)])], folder=folder)).features) == 1
    inner = archive([shape(1, [(0, 0)])], folder="Wrap/", extra={"wrap/": b"", "WRAP/below/": b"", "wrap/data.SBN": b"", "wrap/._x": b""})
    assert len(read_shapefile(inner).features) == 1
    assert shape_kind(15) == "PolygonZ" and shape_kind(7) is None


def test_winding_by_exact_signs():
    assert winding(CLOCKWISE) == -1 and winding(COUNTER) == 1 and winding([(0, 0), (1, 1), (2, 2), (0, 0)]) == 0
    assert winding([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]) == 0  # a bow tie
    far = [(1e6 + x, 2e6 + y) for x, y in CLOCKWISE]
    assert winding(far) == -1 and winding([(x + 1e-9, y) for x, y in reversed(far)]) == 1
    tiny = [(x * 1e-7, y * 1e-7) for x, y in CLOCKWISE]
    assert winding(tiny) == 0  # smaller than the noise of positions in degrees
    assert winding([(0, 0), (1e200, 0), (1e200, 1e200), (0, 0)]) == 0


def test_rows_leave_in_bounded_batches_and_a_late_failure_comes_last(monkeypatch):
    schema = to_arrow_schema(SOURCE_FEATURE)
    data = kml(place(polygon()) * 450)
    batches = list(reading._batches(reading._rows("/a.kml", "KML", data, len(data), Limits()), schema))
    assert [b.num_rows for b in batches] == [200, 200, 51] and batches[-1].column("feature_index")[-1].as_py() == reading.HEADER_INDEX
    monkeypatch.setattr(reading, "BATCH_BYTES", 1000)
    assert max(b.num_rows for b in reading._batches(reading._rows("/a.kml", "KML", data, len(data), Limits()), schema)) < 10
    monkeypatch.setattr(kml_reader, "geometry_of", lambda node, space, seen=[]: seen.append(1) or (_ for _ in ()).throw(RuntimeError()) if len(seen) > 3 else (None, None, None, seen.append(1) or []))
    rows = list(reading._rows("/a.kml", "KML", data, len(data), Limits()))
    assert [r["file_failure"] for r in rows] == [None] * (len(rows) - 1) + ["INVALID_DATASET"] and 1 < len(rows) < 10


def _grouped_alone(shells, holes, limits=Limits()):
    grouping = shapefile.RingGrouping(crs_from_wkt(WGS84_WKT), limits, 0)
    try:
        return grouping.group(shells, holes), grouping.work
    except Exception as why:
        return (type(why), str(why)), grouping.work


def _random_rings(rnd):
    """Few shells and holes that are apart, nested, touching, crossing or repeated, as squares on a grid and as stars."""
    x, y = rnd.uniform(-179.9, 179.9), rnd.uniform(-80, 80)

    def square(h):
        cx, cy = round(x + rnd.randint(-3, 3) * 0.01, 6), round(y + rnd.randint(-3, 3) * 0.01, 6)
        return [[cx - h, cy - h], [cx - h, cy + h], [cx + h, cy + h], [cx + h, cy - h], [cx - h, cy - h]]

    def star(r, n):
        cx, cy = x + rnd.uniform(-0.03, 0.03), y + rnd.uniform(-0.03, 0.03)
        points = [[cx + r * rnd.uniform(0.6, 1) * math.cos(-2 * math.pi * i / n), cy + r * rnd.uniform(0.6, 1) * math.sin(-2 * math.pi * i / n)] for i in range(n)]
        return [*points, points[0]]

    shells = [rnd.choice([lambda: square(0.01 * rnd.randint(1, 3)), lambda: star(rnd.uniform(0.01, 0.05), rnd.randint(3, 8))])() for _ in range(rnd.randint(0, 3))]
    holes = [rnd.choice([lambda: square(0.005 * rnd.randint(1, 2))[::-1], lambda: star(rnd.uniform(0.001, 0.01), rnd.randint(3, 6))[::-1]])() for _ in range(rnd.randint(0, 2))]
    return shells, holes


def test_rings_of_many_features_are_grouped_as_those_of_each():
    rnd = random.Random(11)
    features = [_random_rings(rnd) for _ in range(250)]
    alone = [_grouped_alone(*f) for f in features]
    assert len({str(found) if isinstance(found, tuple) else max(map(len, found)) for found, _ in alone}) > 5
    for limits in (Limits(), Limits(generated_feature_coordinates=400)):
        alone = [_grouped_alone(*f, limits) for f in features]
        together = shapefile.group_rings(features, crs_from_wkt(WGS84_WKT), limits)
        assert [((type(r), str(r)) if isinstance(r, Exception) else r, work) for r, work in together] == alone


def test_many_features_are_not_grouped_one_by_one(monkeypatch):
    def alone(self, shells, holes):
        raise AssertionError("grouped alone")

    monkeypatch.setattr(shapefile.RingGrouping, "group", alone)
    rnd = random.Random(12)
    features = [f for f in (_random_rings(rnd) for _ in range(60)) if f[0]]
    found = shapefile.group_rings(features, crs_from_wkt(WGS84_WKT), Limits())
    assert len(found) == len(features) and not any(isinstance(r, AssertionError) for r, _ in found)


@pytest.mark.parametrize("name", ["jsonl_features", "jsonl_files"])
def test_line_files_of_many_users_make_no_folders(spark, sf_dir, monkeypatch, name):
    """A folder for each user would be made and listed by the driver, one by one."""
    from terrameter import reader_queries

    def refuse(spark):
        raise AssertionError("no folder is needed")

    monkeypatch.setattr(reader_queries, "scratch", refuse)
    assert getattr(reader_queries, name)(spark, sf_dir).count() > 1


def test_line_files_are_what_a_scan_of_them_would_be(spark, sf_dir, tmp_path, monkeypatch):
    """Content and length of each file; one beyond the limit is listed without content, and refused."""
    from terrameter import reader_queries
    from terrameter.sources.jsonl import file_problems

    files = reader_queries._line_files(spark, sf_dir).collect()
    for r in files:
        assert r["length"] == len(r["content"]) and r["content"].endswith(b"\n")
        (tmp_path / r["path"].split("=")[1].replace("/part", "")).write_bytes(r["content"])
    rows = lambda source: sorted((re.search(r"(\d+)(/part)?\.jsonl", r["file"])[1], r["rows"], r["file_problem"]) for r in file_problems(spark, source, limits).collect())
    some = sorted(r["length"] for r in files)[len(files) // 2]
    limits = Limits(features=500, output_bytes=some)
    monkeypatch.setattr(reader_queries, "_LINE_LIMITS", limits)
    found = reader_queries._line_files(spark, sf_dir)
    assert {r["length"] > some for r in found.where("content is null").collect()} == {True}
    assert rows(found) == rows(str(tmp_path)) and {p for _, _, p in rows(found)} == {None, "too_large"}


def _squares_archive(n, rows=None):
    from terrameter.file_adapters import attribute_table, main_file, shape_record, zipped

    box = lambda x, h: [(x - h, -h), (x - h, h), (x + h, h), (x + h, -h), (x - h, -h)]
    shapes = [shape_record(5, box(float(i), 0.05) + box(float(i), 0.02)[::-1], [0, 5]) for i in range(n)]
    table = attribute_table([("id", "N", 4, 0)], [(False, [b"1"])] * (n if rows is None else rows), 3)
    return zipped({"layer.shp": main_file(shapes), "layer.shx": b"", "layer.dbf": table, "layer.prj": WGS84_WKT.encode()})


def test_rings_of_many_records_are_grouped_together(monkeypatch):
    """One grouping for all records, with the results that each has alone in its place in the file."""
    sizes, plain = [], shapefile.group_rings
    monkeypatch.setattr(shapefile, "group_rings", lambda features, *rest: (sizes.append(len(features)), plain(features, *rest))[1])
    many = shapefile.read_shapefile(_squares_archive(60)).features
    assert sizes == [60] and {f.geometry_type for f in many} == {"Polygon"} and {len(f.geometry["coordinates"]) for f in many} == {2}
    monkeypatch.setattr(shapefile, "_GROUP_RECORDS", 1)
    one = shapefile.read_shapefile(_squares_archive(60)).features
    assert many == one and sum(sizes[1:]) == 60 and max(sizes[1:]) == 1


def test_a_budget_that_ends_comes_before_a_later_failure():
    work = sum(f.extra_work for f in shapefile.read_shapefile(_squares_archive(10)).features)
    assert len(shapefile.read_shapefile(_squares_archive(10), Limits(generated_work=work)).features) == 10
    for rows, limits, code in ((10, Limits(generated_work=work - 1), "GENERATED_WORK_LIMIT"), (9, Limits(), "CORRUPT_SHAPEFILE"), (9, Limits(generated_work=work // 2), "GENERATED_WORK_LIMIT")):
        with pytest.raises(FileFailure) as why:
            shapefile.read_shapefile(_squares_archive(10, rows), limits)
        assert why.value.code == code


@pytest.mark.parametrize("name", ["shapefile_features", "archive_entry_rules"])
def test_archives_are_read_once(spark, sf_dir, name):
    """The result comes from staged rows: headers and features would each read the archives again."""
    from terrameter import reader_queries

    plan = getattr(reader_queries, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan


def test_the_guard_keeps_records_of_few_elements(monkeypatch):
    """Only folders and elements with positions have a record of their own in the first pass, and Placemarks in Placemarks keep their own positions."""
    made, plain = [], kml_reader._Open
    monkeypatch.setattr(kml_reader, "_Open", lambda *a, **k: (made.append(1), plain(*a, **k))[1])
    body = "<Folder>" + place("<name>x</name><ExtendedData><Data name='a'><value>1</value></Data></ExtendedData>" + polygon()) * 50 + "</Folder>"
    assert kml_reader.outline_of(kml(body)).placemarks == 50 and len(made) == 51
    nested = "".join("<Placemark><Point><coordinates>" + "1,2 " * i + "</coordinates></Point>" for i in range(1, 31)) + "</Placemark>" * 30
    assert [f.coordinates for f in read_kml(kml(nested)).features] == list(range(1, 31))


def test_a_publication_makes_its_documents_and_manifests_once(spark, sf_dir, monkeypatch):
    """What is published is read from the staged documents and manifests, not made again from the tables."""
    from terrameter import reader_queries

    found = {}
    monkeypatch.setattr(reader_queries, "_stores", {})
    monkeypatch.setattr(reader_queries.Store, "publish", lambda self, manifests, features, ids: found.update(ids=ids.inputFiles(), manifests=manifests.inputFiles(), n=manifests.count()))
    monkeypatch.setattr(reader_queries.Store, "delete", lambda self, file_id: None)
    reader_queries._published(spark, sf_dir)
    assert found["n"] > 0 and all("/staging/files/" in f for f in found["ids"]) and all("/staging/manifests/" in f for f in found["manifests"])
