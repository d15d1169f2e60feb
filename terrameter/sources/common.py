"""What the file readers share: outcomes, issues and bounded JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from ..model import Limits

# File failures that mean "too large".
TOO_LARGE = [
    "UPLOAD_TOO_LARGE", "CHILD_OUTPUT_LIMIT", "GENERATED_COORDINATE_LIMIT", "GENERATED_WORK_LIMIT", "FEATURE_OUTPUT_LIMIT", "FILE_COORDINATE_LIMIT",
    "XML_ELEMENT_LIMIT", "XML_DEPTH_LIMIT", "XML_TEXT_LIMIT", "FEATURE_LIMIT", "ARCHIVE_ENTRY_LIMIT", "EXPANDED_ARCHIVE_LIMIT", "COMPONENT_SIZE_LIMIT",
    "FILE_OUTPUT_LIMIT", "FILE_GENERATED_COORDINATE_LIMIT", "FILE_GENERATED_WORK_LIMIT",
]


class FileFailure(Exception):
    """A problem that rejects the whole file."""

    def __init__(self, code: str, message: str, http_status: int | None = None) -> None:
        super().__init__(message)
        self.code = code
        self.http_status = http_status or (413 if code in TOO_LARGE else 422)


def issue(code: str, message: str, severity: str = "warning", details: object = None) -> dict:
    return {"code": code, "message": message, "severity": severity, "details": None if details is None else compact(details)}


_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), allow_nan=False)  # made once: json.dumps makes one a call


def compact(value: object) -> str:
    return _ENCODER.encode(value)


def json_bytes(value: object) -> int:
    return len(compact(value).encode("utf-8", "surrogatepass"))


def bounded(issues: list[dict], limits: Limits) -> list[dict]:
    """At most ``limits.issues`` issues; the last one then tells how many were left out."""
    if len(issues) <= limits.issues:
        return issues
    kept = issues[: limits.issues - 1]
    return [*kept, issue("ISSUES_TRUNCATED", "Further issues were left out.", "warning", {"omitted_count": len(issues) - len(kept)})]


@dataclass
class Feature:
    """One source feature before normalising and measuring."""

    source_id: str | None = None
    geometry_type: str | None = None
    dimensions: int | None = None
    geometry: dict | None = None
    source_parts: object = None
    properties: list[dict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    issues: list[dict] = field(default_factory=list)
    status: str | None = None  # set where the feature is not to be measured
    coordinates: int = 0
    extra_work: int = 0


@dataclass
class Dataset:
    """What a reader found in one file; the features may be read as they are asked for, and once only."""

    features: Iterable[Feature] = field(default_factory=list)
    crs_wkt: str = ""
    warnings: list[dict] = field(default_factory=list)
    deleted: int = 0


def positions_in(geometry: dict | None) -> int:
    """Positions of a GeoJSON-style geometry, collections included."""
    if not geometry:
        return 0
    if geometry.get("type") == "GeometryCollection":
        return sum(positions_in(g) for g in geometry.get("geometries", []))

    def count(value: object) -> int:
        if isinstance(value, list) and value and not isinstance(value[0], list):
            return 1
        return sum(map(count, value)) if isinstance(value, list) else 0

    return count(geometry.get("coordinates"))


def dimensions_of(geometry: dict | None) -> int:
    """Length of the first position; collections take their largest, empty geometries 2."""
    if not geometry:
        return 2
    if geometry.get("type") == "GeometryCollection":
        return max((dimensions_of(g) for g in geometry.get("geometries", [])), default=2)
    value = geometry.get("coordinates")
    while isinstance(value, list) and value and isinstance(value[0], list):
        value = value[0]
    return len(value) if isinstance(value, list) and value else 2


def components_in(geometry: dict | None) -> int:
    kind = (geometry or {}).get("type", "")
    parts = (geometry or {}).get("coordinates") or []
    return len(parts) if kind.startswith("Multi") else 1 if kind in ("Point", "LineString", "Polygon") else 0
