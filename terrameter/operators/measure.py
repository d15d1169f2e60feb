"""Measured lengths and areas of features, a batch of features at a time.

All vertices of a batch lie in flat arrays: one call densifies, projects and sums every segment of
every component.  Features whose two latest refinements were stable leave the loop.  A feature's
problem becomes a status and a code; it never fails the job.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import topology
from ..functions.crs import Crs, CrsError, crs_from_wkt
from ..functions.geodesic import direct, haversine, inverse
from ..functions.projection import equal_area, equidistant
from ..model import MEASUREMENT, POLICY, Limits

EDGE_MODEL = "wgs84_shortest_geodesic"
METHOD = "projected_geodesic_densification"
_CHUNK_VERTICES = 200_000
_CHUNK_POSITIONS = 65_536  # refined positions that are worked on at once: some 600 bytes each
_ROWS_OUT = 500


class Problem(Exception):
    """Why a feature has no measurement."""

    def __init__(self, status: str, code: str, message: str) -> None:
        super().__init__(message)
        self.status, self.code = status, code


@dataclass
class _Component:
    kind: str
    paths: list[np.ndarray]
    center: tuple[float, float] = (0.0, 0.0)


@dataclass
class _Feature:
    components: list[_Component] = field(default_factory=list)
    pending: Problem | None = None  # of the component after the last one in the list
    result: dict | None = None
    work: int = 0
    crs: Crs | None = None  # of components that are still in source coordinates


def _failed(status: str, code: str, message: str, work: int = 0) -> dict:
    provenance = {"policy": POLICY, "generated_coordinates_total": work or None}
    return {"measurement_status": status, "area_m2": None, "length_m": None, "provenance": provenance, "issues": [{"code": code, "message": message, "severity": "error", "details": None}]}


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def position(value: object) -> tuple[float, float]:
    """XY of a position whose ordinates are all finite numbers."""
    if type(value) is list and len(value) == 2 and type(value[0]) is type(value[1]) is float and math.isfinite(value[0]) and math.isfinite(value[1]):
        return value[0], value[1]  # nearly all of them
    if not isinstance(value, (list, tuple)) or len(value) < 2:
        raise Problem("ERROR", "INVALID_COORDINATE", "A position needs X and Y.")
    if not all(map(_number, value)):
        raise Problem("ERROR", "INVALID_COORDINATE", "Ordinates must be numbers.")
    if not all(math.isfinite(float(v)) for v in value):
        raise Problem("ERROR", "NON_FINITE_COORDINATE", "Ordinates must be finite.")
    return float(value[0]), float(value[1])


def path(value: object, ring: bool) -> np.ndarray:
    """Vertices of a line or closed ring; rings need three distinct vertices and lines two."""
    if not isinstance(value, (list, tuple)):
        raise Problem("ERROR", "INVALID_GEOMETRY", "A path must be a list of positions.")
    points = [position(p) for p in value]
    if ring and (len(points) < 4 or points[0] != points[-1]):
        raise Problem("ERROR", "INVALID_RING", "A ring must be closed and have four positions.")
    if ring and len(set(points[:-1])) < 3:
        raise Problem("ERROR", "INVALID_RING", "A ring needs three distinct vertices.")
    if not ring and len(set(points)) < 2:
        raise Problem("ERROR", "DEGENERATE_LINE", "A line needs two distinct vertices.")
    return np.array(points)


def _whole(value: object) -> list:
    if not isinstance(value, (list, tuple)) or not value:
        raise Problem("ERROR", "EMPTY_GEOMETRY", "The geometry has no parts.")
    return list(value)


def raw_components(kind: str, coordinates: object) -> list[_Component]:
    """Lines and polygons of a GeoJSON geometry, in source coordinates."""
    if kind == "LineString":
        return [_Component("LineString", [path(coordinates, False)])]
    if kind == "MultiLineString":
        return [_Component("LineString", [path(p, False)]) for p in _whole(coordinates)]
    if kind == "Polygon":
        return [_Component("Polygon", [path(r, True) for r in _whole(coordinates)])]
    return [_Component("Polygon", [path(r, True) for r in _whole(polygon)]) for polygon in _whole(coordinates)]


def to_wgs84(paths: list[np.ndarray], crs: Crs) -> list[np.ndarray]:
    out = []
    for p in paths:
        lon, lat = crs.to_wgs84(p[:, 0], p[:, 1])
        if not (np.isfinite(lon) & np.isfinite(lat) & (np.abs(lon) <= 180.0) & (np.abs(lat) <= 90.0)).all():
            raise Problem("ERROR", "INVALID_WGS84_COORDINATE", "A transformed position is outside WGS84 bounds.")
        out.append(np.column_stack([lon, lat]))
    return out


def center_of(points: np.ndarray) -> tuple[float, float]:
    """Longitude and latitude of the mean unit vector, by compensated sums."""
    return _center(*(v.tolist() for v in _unit_vectors(points)))


def _unit_vectors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lon, lat = np.radians(points.T)
    flat = np.cos(lat)
    return flat * np.cos(lon), flat * np.sin(lon), np.sin(lat)


def _center(*vectors: list[float]) -> tuple[float, float]:
    x, y, z = (math.fsum(v) / len(v) for v in vectors)
    flat, norm = math.hypot(x, y), math.sqrt(x * x + y * y + z * z)
    if norm < 1e-12:
        raise Problem("ERROR", "UNSTABLE_COMPONENT_CENTER", "The component's centre is undetermined.")
    return (math.degrees(math.atan2(y, x)) if flat / norm > 1e-14 else 0.0), math.degrees(math.atan2(z, flat))


def _parsed(geometry: object, wkt: str | None, limits: Limits) -> _Feature:
    """Validated components in source coordinates, or the result of a feature that is not measured."""
    done = lambda *why: _Feature(result=_failed(*why))
    if geometry is None:
        return done("ERROR", "MISSING_GEOMETRY", "The feature has no geometry.")
    if not isinstance(geometry, dict):
        return done("ERROR", "INVALID_GEOMETRY", "The geometry is not an object.")
    kind, coordinates = geometry.get("type"), geometry.get("coordinates")
    if not isinstance(kind, str):
        return done("ERROR", "INVALID_GEOMETRY", "The geometry has no type.")
    try:
        if kind in ("Point", "MultiPoint"):
            points = [position(p) for p in ([coordinates] if kind == "Point" else _whole(coordinates))]
            to_wgs84([np.array(points)], crs_from_wkt(wkt or ""))
            return _Feature(result={"measurement_status": "NOT_APPLICABLE", "area_m2": None, "length_m": None, "provenance": {"policy": POLICY, "dimension": 2}, "issues": []})
        if kind == "GeometryCollection":
            return done("UNSUPPORTED", "MIXED_GEOMETRY_COLLECTION", "Collections are not measured.")
        if kind not in ("LineString", "MultiLineString", "Polygon", "MultiPolygon"):
            return done("UNSUPPORTED", "UNSUPPORTED_GEOMETRY", "This geometry type is not measured.")
        crs = crs_from_wkt(wkt or "")
        raw = raw_components(kind, coordinates)
        if sum(len(p) for c in raw for p in c.paths) > limits.feature_coordinates:
            raise Problem("ERROR", "INPUT_COORDINATE_LIMIT", "The feature has too many positions.")
    except (Problem, CrsError) as why:
        return done(getattr(why, "status", "ERROR"), why.code, str(why))
    return _Feature(raw, crs=crs)


def _place(features: list[_Feature]) -> None:
    """Bring the components of features of one CRS to WGS84, with centres; the first that cannot be ends its feature's list."""
    members = [c for f in features for c in f.components]
    paths = [p for c in members for p in c.paths]
    sizes = [len(p) for p in paths]
    points = np.concatenate(paths)
    lon, lat = features[0].crs.to_wgs84(points[:, 0], points[:, 1])
    points = np.column_stack([lon, lat])
    outside = ~(np.isfinite(lon) & np.isfinite(lat) & (np.abs(lon) <= 180.0) & (np.abs(lat) <= 90.0))
    bad = set(np.flatnonzero(np.add.reduceat(outside, np.cumsum(sizes) - sizes)).tolist()) if outside.any() else ()
    vectors = [v.tolist() for v in _unit_vectors(points)]
    path, begin = 0, 0
    for f in features:
        raw, f.components, f.crs = f.components, [], None
        for c in raw:
            first, after = (path, begin), path + len(c.paths)
            placed = []
            while path < after:
                placed.append(points[begin : begin + sizes[path]])
                begin += sizes[path]
                path += 1
            if f.pending is not None:
                continue
            try:
                if bad and not bad.isdisjoint(range(first[0], after)):
                    raise Problem("ERROR", "INVALID_WGS84_COORDINATE", "A transformed position is outside WGS84 bounds.")
                end = first[1] + len(placed[0]) - (c.kind == "Polygon")
                c.paths, c.center = placed, _center(*(v[first[1] : end] for v in vectors))
            except Problem as why:
                f.pending = why
                continue
            f.components.append(c)


def _placed(features: list[_Feature]) -> None:
    """Bring the components of all features to WGS84, those of one CRS at once."""
    by_crs: dict[Crs, list[_Feature]] = {}
    for f in features:
        if f.crs is not None:
            by_crs.setdefault(f.crs, []).append(f)
    for own in by_crs.values():
        try:
            _place(own)
        except Exception:  # a feature never fails the job, nor another feature
            for f in own:
                try:
                    _place([f])
                except Exception:
                    f.result = _failed("ERROR", "MEASUREMENT_FAILED", "The geometry could not be measured.")


def prove_extent(components: list[_Component], limits: Limits) -> tuple[Problem | None, int]:
    """(problem, halvings): whether no point of any segment is farther from its centre than the limit.

    Segments are halved, the first half first, until the triangle inequality settles them; the halvings
    of all components of a feature share one budget.  All open segments are looked at together, in that
    order: what comes after a failure is cut off, and each segment carries the halvings made since the
    one before it, so the first failure and the work up to it are those of one walk after the other.
    """
    too_far = Problem("UNSUPPORTED", "COMPONENT_EXTENT_EXCEEDED", "The component reaches beyond the radius limit.")
    unproven = Problem("ERROR", "EXTENT_UNVERIFIED", "The radius limit could not be verified.")
    budget = limits.extent_subdivisions
    pieces = [(c.center, p) for c in components for p in c.paths]
    start, end = np.vstack([p[:-1] for _, p in pieces]), np.vstack([p[1:] for _, p in pieces])
    center = np.repeat(np.array([c for c, _ in pieces]), [len(p) - 1 for _, p in pieces], axis=0)
    weight, depth = np.zeros(len(start), np.int64), 0
    away = lambda c, p: inverse(c[:, 0], c[:, 1], p[:, 0], p[:, 1])[0]
    failure, after = None, 0  # the first failure in order, and the halvings between the last open segment and it
    while len(start):
        before = np.cumsum(weight)
        if before[-1] > budget:
            keep = int(np.searchsorted(before, budget, "right"))
            failure, after = unproven, budget  # the budget ends before the segments that are cut off
            start, end, center, weight, before = start[:keep], end[:keep], center[:keep], weight[:keep], before[:keep]
            if not keep:
                break
        distance, azimuth = inverse(start[:, 0], start[:, 1], end[:, 0], end[:, 1])
        farther = np.maximum(away(center, start), away(center, end))
        far = (distance > 2 * limits.radius_m) | (farther > limits.radius_m)
        proven = ~far & (farther + distance / 2 <= limits.radius_m - 1e-6)
        stuck = ~far & ~proven & ((distance <= 0.001) | (depth >= 18) | (before >= budget))
        halve = np.flatnonzero(~far & ~proven & ~stuck)
        lon, lat = direct(start[halve, 0], start[halve, 1], azimuth[halve], distance[halve] / 2)
        middle = np.column_stack([lon, lat])
        past = np.zeros(len(start), bool)
        past[halve[away(center[halve], middle) > limits.radius_m]] = True
        failed = np.flatnonzero(far | stuck | past)
        total = int(before[-1])
        if len(failed):
            k = int(failed[0])
            failure, total, after = (unproven if stuck[k] else too_far), int(before[k]) + int(past[k]), 0
            middle, halve = middle[halve < k], halve[halve < k]
        upto = before[halve]
        weight = np.zeros(2 * len(halve), np.int64)
        weight[::2] = np.diff(upto, prepend=0) + 1
        after += total - (int(upto[-1]) if len(halve) else 0)
        both = np.empty((2 * len(halve), 2))
        begin = both.copy()
        begin[::2], begin[1::2] = start[halve], middle
        both[::2], both[1::2] = middle, end[halve]
        start, end, center, depth = begin, both, np.repeat(center[halve], 2, axis=0), depth + 1
    if failure is None and after > budget:
        failure = unproven
    return failure, min(after, budget)


class _Flat:
    """Segments of many components in flat arrays, with what each belongs to."""

    def __init__(self, components: list[tuple[int, _Component]]) -> None:
        self.owner = np.array([f for f, _ in components])  # feature of each component
        self.polygon = np.array([c.kind == "Polygon" for _, c in components])
        self.center = np.array([c.center for _, c in components])
        paths = [(i, k, p) for i, (_, c) in enumerate(components) for k, p in enumerate(c.paths)]
        self.path_component = np.array([i for i, _, _ in paths])
        self.path_is_shell = np.array([k == 0 for _, k, _ in paths])
        sizes = np.array([len(p) for _, _, p in paths])
        points = np.vstack([p for _, _, p in paths])
        ends = np.cumsum(sizes)
        self.first = points[ends - sizes]
        last = np.zeros(len(points), bool)
        last[ends - 1] = True
        self.start, self.end = points[~last], points[np.flatnonzero(~last) + 1]
        self.segment_path = np.repeat(np.arange(len(paths)), sizes - 1)
        self.distance, self.azimuth = inverse(self.start[:, 0], self.start[:, 1], self.end[:, 0], self.end[:, 1])

    def segment_component(self) -> np.ndarray:
        return self.path_component[self.segment_path]

    def project(self, component: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.empty(len(lon)), np.empty(len(lon))
        for polygon, how in ((True, equal_area), (False, equidistant)):
            own = self.polygon[component] == polygon
            if own.any():
                c = self.center[component[own]]
                x[own], y[own] = how(lon[own], lat[own], c[:, 0], c[:, 1])
        return x, y

    @cached_property
    def first_projected(self) -> tuple[np.ndarray, np.ndarray]:
        return self.project(self.path_component, self.first[:, 0], self.first[:, 1])

    def pieces(self, spacing: float) -> np.ndarray:
        return np.maximum(1, np.ceil(self.distance / spacing)).astype(np.int64)

    def measure(self, spacing: float) -> tuple[np.ndarray, np.ndarray]:
        """(length or area, validity) of each component with segments of at most ``spacing`` metres.

        Polygons are judged as they are measured: by their densified rings in their own chart.
        """
        n = self.pieces(spacing)
        seg = np.repeat(np.arange(len(n)), n)
        begin = np.cumsum(n) - n
        step = np.arange(len(seg)) - begin[seg] + 1
        lon, lat = self.end[seg, 0].copy(), self.end[seg, 1].copy()
        inner = step < n[seg]
        s = seg[inner]
        if len(s):
            lon[inner], lat[inner] = direct(self.start[s, 0], self.start[s, 1], self.azimuth[s], self.distance[s] * step[inner] / n[s])
        component = self.segment_component()[seg]
        x, y = self.project(component, lon, lat)
        fx, fy = self.first_projected
        path_of = self.segment_path[seg]
        head = np.concatenate(([True], path_of[1:] != path_of[:-1]))
        px = np.where(head, fx[path_of], np.concatenate(([0.0], x[:-1])))
        py = np.where(head, fy[path_of], np.concatenate(([0.0], y[:-1])))
        polygon = self.polygon[component]
        ox, oy = fx[path_of], fy[path_of]
        part = np.where(polygon, (px - ox) * (y - oy) - (x - ox) * (py - oy), np.hypot(x - px, y - py))
        per_path = np.add.reduceat(part, np.flatnonzero(head))
        path_polygon = self.polygon[self.path_component]
        per_path = np.where(path_polygon, np.where(self.path_is_shell, 1.0, -1.0) * np.abs(per_path) / 2, per_path)
        valid = np.ones(len(self.polygon), bool)
        if polygon.any():
            own = np.flatnonzero(self.polygon)
            rank = np.cumsum(self.polygon) - 1
            dense = np.column_stack([px, py, x, y])[polygon]
            valid[own] = topology.valid_batch(dense, seg[polygon], path_of[polygon], rank[component[polygon]], len(own))
        return np.bincount(self.path_component, weights=per_path, minlength=len(self.polygon)), valid

    def generated(self, spacing: float) -> np.ndarray:
        """Vertices of each component after densifying, path starts included."""
        n = np.bincount(self.segment_component(), weights=self.pieces(spacing), minlength=len(self.polygon))
        return (n + np.bincount(self.path_component, minlength=len(self.polygon))).astype(np.int64)


def dense_segments(start: np.ndarray, end: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """(segment, point) of the points along geodesic segments, at most ``spacing`` metres apart, their ends included.

    A segment is walked from its western end, so two paths that share one share all its points.
    """
    swap = (start[:, 0] > end[:, 0]) | (start[:, 0] == end[:, 0]) & (start[:, 1] > end[:, 1])
    west, east = np.where(swap[:, None], end, start), np.where(swap[:, None], start, end)
    distance, azimuth = inverse(west[:, 0], west[:, 1], east[:, 0], east[:, 1])
    n = np.maximum(1, np.ceil(distance / spacing)).astype(np.int64)
    seg = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(seg)) - (np.cumsum(n) - n)[seg] + 1
    lon, lat = direct(west[seg, 0], west[seg, 1], azimuth[seg], distance[seg] * np.where(swap[seg], n[seg] - k, k) / n[seg])
    last = k == n[seg]
    return seg, np.column_stack([np.where(last, end[seg, 0], lon), np.where(last, end[seg, 1], lat)])


_CHUNK_PAIRS = 4096


def overlap_problems(features: list[list[_Component]], spacing: float, limits: Limits) -> list[Problem | None]:
    """Why each multipolygon is refused: no two of its parts may share interior points.

    Pairs are judged by their densified rings in a chart about both; parts that lie apart by their
    circles about their centres share no point.  The pairs of many features are looked at together.
    """
    out: list[Problem | None] = [None] * len(features)
    members = [(f, c) for f, cs in enumerate(features) for c in cs]
    if not members:
        return out
    flat = _Flat(members)
    of = flat.segment_component()
    reach = np.zeros(len(members))
    np.maximum.at(reach, of, inverse(flat.center[of, 0], flat.center[of, 1], flat.start[:, 0], flat.start[:, 1])[0])
    longest = np.zeros(len(members))
    np.maximum.at(longest, of, flat.distance)
    reach += longest / 2
    sizes = np.array([len(cs) for cs in features])
    begins = np.cumsum(sizes) - sizes
    tables = [np.triu_indices(n, 1) for n in sizes.tolist()]
    owner = np.repeat(np.arange(len(sizes)), [len(i) for i, _ in tables])
    i, j = (np.concatenate([t[k] for t in tables]) + begins[owner] for k in (0, 1))
    apart = inverse(flat.center[i, 0], flat.center[i, 1], flat.center[j, 0], flat.center[j, 1])[0] if len(i) else np.zeros(0)
    close = apart <= np.minimum(2 * limits.radius_m, reach[i] + reach[j] + 1.0)
    pairs = np.column_stack([owner[close], i[close], j[close]])
    seg_begin = np.searchsorted(of, np.arange(len(members)), "left")
    seg_count = np.searchsorted(of, np.arange(len(members)), "right") - seg_begin
    weight = np.cumsum(np.bincount(of, weights=flat.pieces(spacing), minlength=len(members))[pairs[:, 1:]].sum(1)) if len(pairs) else np.zeros(0)
    at = 0
    while at < len(pairs):
        end = max(at + 1, min(at + _CHUNK_PAIRS, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + 4 * _CHUNK_VERTICES, "right"))))
        _judge_pairs(flat, pairs[at:end], seg_begin, seg_count, spacing, out)
        at = end
    return out


def _judge_pairs(flat: _Flat, pairs: np.ndarray, seg_begin: np.ndarray, seg_count: np.ndarray, spacing: float, out: list[Problem | None]) -> None:
    """Set the problem of each feature's first bad pair (feature, part, part)."""
    parts = pairs[:, 1:].ravel()  # two in a row for each pair
    n = seg_count[parts]
    whose = np.repeat(np.arange(len(parts)), n)
    segs = np.repeat(seg_begin[parts] - np.cumsum(n) + n, n) + np.arange(n.sum())
    step, points = dense_segments(flat.start[segs], flat.end[segs], spacing)
    whose, ring, edge = whose[step], flat.segment_path[segs[step]], segs[step]
    # rings of one part that occurs twice are different rings
    ring = whose * (int(flat.segment_path.max()) + 1) + ring
    shell = flat.path_is_shell[flat.segment_path[edge]]
    lon, lat = np.radians(points[shell]).T
    sums = [np.bincount(whose[shell] // 2, weights=v, minlength=len(pairs)) for v in (np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat))]
    lon0, lat0 = np.degrees(np.arctan2(sums[1], sums[0])), np.degrees(np.arctan2(sums[2], np.hypot(sums[0], sums[1])))
    chart = whose // 2
    head = np.concatenate(([True], ring[1:] != ring[:-1]))
    first = flat.start[edge[head]]  # where each ring begins
    x, y = equal_area(points[:, 0], points[:, 1], lon0[chart], lat0[chart])
    fx, fy = equal_area(first[:, 0], first[:, 1], lon0[chart[head]], lat0[chart[head]])
    px, py = np.concatenate(([0.0], x[:-1])), np.concatenate(([0.0], y[:-1]))
    px[head], py[head] = fx, fy
    flat_segments = np.column_stack([px, py, x, y])
    valid = topology.valid_batch(flat_segments, np.cumsum(np.concatenate(([True], (edge[1:] != edge[:-1]) | head[1:]))), ring, whose, len(parts))
    begin = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
    low, high = np.minimum.reduceat(flat_segments[:, 2:], begin), np.maximum.reduceat(flat_segments[:, 2:], begin)
    meet = (low[::2] < high[1::2]).all(1) & (low[1::2] < high[::2]).all(1)
    ends = np.append(begin, len(whose))

    def rings(k: int) -> list[np.ndarray]:
        own = slice(ends[k], ends[k + 1])
        cuts = np.flatnonzero(head[own])[1:]
        return [np.vstack([r[:1, :2], r[:, 2:]]) for r in np.split(flat_segments[own], cuts)]

    for k, (f, _, _) in enumerate(pairs.tolist()):
        if out[f] is not None:
            continue
        if not valid[2 * k : 2 * k + 2].all():
            out[f] = Problem("ERROR", "INVALID_SHARED_TOPOLOGY", "The parts are invalid in a shared chart.")
        elif meet[k] and topology.interiors_overlap(rings(2 * k), rings(2 * k + 1)):
            out[f] = Problem("ERROR", "OVERLAPPING_MULTIPOLYGON_COMPONENTS", "Two parts overlap.")


def _check_extents(features: list[_Feature], limits: Limits) -> None:
    members = [(i, c) for i, f in enumerate(features) if f.result is None for c in f.components]
    unsure: set[int] = set()
    if members:
        flat = _Flat(members)
        of = flat.segment_component()
        c = flat.center[of]
        farther = lambda how, at: np.maximum(how(c[at, 0], c[at, 1], flat.start[at, 0], flat.start[at, 1]), how(c[at, 0], c[at, 1], flat.end[at, 0], flat.end[at, 1]))
        # distances on the mean sphere are less than a hundredth too small: most segments are settled by them
        at = np.flatnonzero(1.01 * farther(haversine, slice(None)) + flat.distance / 2 > limits.radius_m - 1.0)
        at = at[farther(lambda *ends: inverse(*ends)[0], at) + flat.distance[at] / 2 > limits.radius_m - 1e-6] if len(at) else at
        unsure = set(flat.owner[of[at]].tolist())
    for i, f in enumerate(features):
        if f.result is not None:
            continue
        why, halvings = prove_extent(f.components, limits) if i in unsure else (None, 0)
        why = why or f.pending
        if why is not None:
            f.result = _failed(why.status, why.code, str(why), halvings)


class _Active:
    """The features still in the refinement loop, with their state in arrays by component and by feature."""

    def __init__(self, features: list[_Feature]) -> None:
        self.features = features
        self.index = np.array([i for i, f in enumerate(features) if f.result is None], np.int64)
        n = sum(len(features[i].components) for i in self.index)
        self.work = np.zeros(len(self.index), np.int64)
        self.previous, self.streak = np.zeros(n), np.zeros(n, np.int64)
        self.total, self.total_streak = np.zeros(len(self.index)), np.zeros(len(self.index), np.int64)
        self._lay()

    def _lay(self) -> None:
        self.flat = _Flat([(i, c) for i in self.index.tolist() for c in self.features[i].components]) if len(self.index) else None
        sizes = np.array([len(self.features[i].components) for i in self.index.tolist()], np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def settle(self, results: dict[int, dict]) -> None:
        """Take the features at these places out of the loop with their results."""
        if not results:
            return
        stay = np.ones(len(self.index), bool)
        for place, result in results.items():
            self.features[self.index[place]].result = result
            stay[place] = False
        parts = np.repeat(stay, self.sizes)
        self.previous, self.streak = self.previous[parts], self.streak[parts]
        self.index, self.work, self.total, self.total_streak = self.index[stay], self.work[stay], self.total[stay], self.total_streak[stay]
        self._lay()

    def parts(self, place: int) -> slice:
        return slice(self.starts[place], self.starts[place] + self.sizes[place])


def _too_many(active: _Active, counts: np.ndarray, spacing: float, limits: Limits) -> dict[int, dict]:
    """Features with too many positions; a part before the one that breaks the limit may be invalid first."""
    out = {}
    for place in np.flatnonzero(np.add.reduceat(counts, active.starts) > limits.generated_feature_coordinates).tolist():
        running = np.cumsum(counts[active.parts(place)])
        k = int(np.flatnonzero(running > limits.generated_feature_coordinates)[0])
        before = active.features[active.index[place]].components[:k]
        values, valid = _Flat([(0, c) for c in before]).measure(spacing) if before else (np.zeros(0), np.zeros(0, bool))
        bad = np.flatnonzero(~valid | ~(np.isfinite(values) & (values > 0)))
        work = int(active.work[place])
        if len(bad):
            out[place] = _failed("ERROR", "INVALID_GEOMETRY", "The projected geometry is invalid.", work + int(running[bad[0]]))
        else:
            out[place] = _failed("ERROR", "GENERATED_COORDINATE_LIMIT", "A refinement has too many positions.", work + int(running[k]))
    return out


def _refine(features: list[_Feature], wkts: list[str | None], kinds: list[str], limits: Limits) -> None:
    """Halve the spacing until each part and the total have been stable twice in a row."""
    active = _Active(features)
    for level in range(limits.refinements + 1):
        if not len(active.index):
            return
        spacing = limits.start_segment_m / 2**level
        active.settle(_too_many(active, active.flat.generated(spacing), spacing, limits))
        if not len(active.index):
            return
        flat, starts = active.flat, active.starts
        counts, (values, valid) = flat.generated(spacing), flat.measure(spacing)
        worked = active.work.copy()
        active.work += np.add.reduceat(counts, starts)
        total = np.add.reduceat(values, starts)
        area = flat.polygon
        if level:
            within = lambda now, before, is_area: np.abs(now - before) <= np.where(is_area, np.maximum(0.01, 1e-5 * now), np.maximum(0.001, 1e-6 * now))
            active.streak = np.where(within(values, active.previous, area), active.streak + 1, 0)
            active.total_streak = np.where(within(total, active.total, area[starts]), active.total_streak + 1, 0)
        active.previous, active.total = values, total
        bad = ~valid | ~(np.isfinite(values) & (values > 0))
        degenerate = np.logical_or.reduceat(bad, starts)
        exhausted = active.work > limits.generated_work
        stable = (np.minimum.reduceat(active.streak, starts) >= 2) & (active.total_streak >= 2) & (level >= 2)
        results = {}
        multi = [place for place in np.flatnonzero(stable & ~degenerate & ~exhausted).tolist() if kinds[active.index[place]] == "MultiPolygon"]
        refused = dict(zip(multi, overlap_problems([features[active.index[p]].components for p in multi], spacing, limits), strict=True))
        for place in np.flatnonzero(degenerate | exhausted | stable).tolist():
            f = features[active.index[place]]
            f.work = int(active.work[place])
            if degenerate[place]:
                upto = int(np.flatnonzero(bad[active.parts(place)])[0]) + 1  # the first bad part ends the level
                results[place] = _failed("ERROR", "INVALID_GEOMETRY", "The projected geometry is invalid or degenerate.", int(worked[place] + counts[active.parts(place)][:upto].sum()))
            elif exhausted[place]:
                results[place] = _failed("ERROR", "CUMULATIVE_COORDINATE_LIMIT", "The refinements have too many positions.", f.work)
            elif refused.get(place) is not None:
                why = refused[place]
                results[place] = _failed(why.status, why.code, str(why), f.work)
            else:
                own, i = active.parts(place), active.index[place]
                results[place] = _measured(f, kinds[i], wkts[i], values[own], counts[own], level, spacing)
        active.settle(results)
    active.settle({place: _failed("ERROR", "NUMERICAL_CONVERGENCE_FAILED", "The measurement did not settle.", int(w)) for place, w in enumerate(active.work)})


def _measured(f: _Feature, kind: str, wkt: str | None, values: np.ndarray, counts: np.ndarray, level: int, spacing: float) -> dict:
    area = kind.endswith("Polygon")
    details = [
        {
            "kind": "area" if area else "length", "value": float(v), "component_count": 1, "center": {"longitude": c.center[0], "latitude": c.center[1]},
            "projection": f"+proj={'laea' if area else 'aeqd'} +lat_0={c.center[1]:.15g} +lon_0={c.center[0]:.15g} +datum=WGS84 +units=m", "edge_model": EDGE_MODEL,
            "maximum_segment_m": spacing, "refinements": level, "generated_coordinates": int(n), "stable_transitions": 2,
        }
        for v, n, c in zip(values, counts, f.components, strict=True)
    ]
    total = math.fsum(values)
    provenance = {
        "policy": POLICY, "dimension": 2, "edge_model": EDGE_MODEL, "source_crs_wkt": wkt, "source_to_wgs84": crs_from_wkt(wkt or "").method, "components": details,
        "generated_coordinates_total": f.work, "generated_coordinates_final": int(counts.sum()), "method": METHOD, "measurement_policy": POLICY,
    }
    return {"measurement_status": "MEASURED", "area_m2": total if area else None, "length_m": None if area else total, "provenance": provenance, "issues": []}


def _positions(f: _Feature, limits: Limits) -> int:
    return int(_positions_of([f], limits)[0])


def _positions_of(features: list[_Feature], limits: Limits) -> np.ndarray:
    """About how many positions each feature has when it can first settle, after two refinements."""
    found = np.zeros(len(features), np.int64)
    paths = [(i, p) for i, f in enumerate(features) if f.result is None for c in f.components for p in c.paths]
    if paths:
        sizes = np.array([len(p) for _, p in paths])
        points, ends = np.concatenate([p for _, p in paths]), np.cumsum(sizes)
        step = haversine(points[:-1, 0], points[:-1, 1], points[1:, 0], points[1:, 1]) * 4 / limits.start_segment_m
        step[ends[:-1] - 1] = 0.0  # from one path to the next
        owner = np.array([i for i, _ in paths])
        n = np.bincount(owner, sizes, len(features)) + np.bincount(np.repeat(owner, sizes)[1:], step, len(features))
        found = np.minimum(n, limits.generated_feature_coordinates).astype(np.int64)
    return found


def measure_batch(geometries: list[object], wkts: list[str | None], limits: Limits = Limits()) -> list[dict]:
    """The measurement of each GeoJSON-style geometry in its CRS."""
    out: list[dict] = []
    at = 0
    while at < len(geometries):
        features, vertices, begin = [], 0, at
        while at < len(geometries) and vertices < _CHUNK_VERTICES // 8:
            try:
                f = _parsed(geometries[at], wkts[at], limits)
            except Exception:  # a feature never fails the job
                f = _Feature(result=_failed("ERROR", "MEASUREMENT_FAILED", "The geometry could not be measured."))
            features.append(f)
            vertices += sum(len(p) for c in f.components for p in c.paths)
            at += 1
        _placed(features)
        kinds = [str(g.get("type")) if isinstance(g, dict) else "" for g in geometries[begin:at]]
        _check_extents(features, limits)
        # a part ends with the feature that fills it
        positions = np.cumsum(_positions_of(features, limits))
        i = 0
        while i < len(features):
            j = min(len(features), int(np.searchsorted(positions, (positions[i - 1] if i else 0) + _CHUNK_POSITIONS, "left")) + 1)
            _refine(features[i:j], wkts[begin + i : begin + j], kinds[i:j], limits)
            i = j
        out += [f.result or _failed("ERROR", "MEASUREMENT_FAILED", "The geometry could not be measured.") for f in features]
    return out


def measure_geometry(geometry: object, wkt: str | None, limits: Limits = Limits()) -> dict:
    """One geometry's measurement."""
    return measure_batch([geometry], [wkt], limits)[0]


def _loads(text: str | None) -> object:
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def measurement(geometry_json: Column, crs_wkt: Column, limits: Limits = Limits()) -> Column:
    """Column of measurements of GeoJSON geometries, computed in Arrow batches."""

    @F.arrow_udf(MEASUREMENT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = to_arrow_type(MEASUREMENT)
        for geometry, wkt in batches:
            for at in range(0, len(geometry), _ROWS_OUT):  # measured rows are many times their input
                texts = geometry.slice(at, _ROWS_OUT).to_pylist()
                yield pa.array(measure_batch([_loads(g) for g in texts], wkt.slice(at, _ROWS_OUT).to_pylist(), limits), kind)

    return run(geometry_json, crs_wkt)


def measure_features(features: DataFrame, limits: Limits = Limits(), geometry_col: str = "geometry", crs_col: str = "crs_wkt") -> DataFrame:
    """``features`` with measurement_status, area_m2, length_m, provenance and measurement_issues."""
    m = features.withColumn("_m", measurement(F.col(geometry_col), F.col(crs_col), limits))
    cols = {n: F.col(f"_m.{n}") for n in ("measurement_status", "area_m2", "length_m", "provenance")}
    return m.withColumns({**cols, "measurement_issues": F.col("_m.issues")}).drop("_m")
