"""Column expressions on geometry, spheres, issues and JSON sizes; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Limits


def json_size(value: Column) -> Column:
    """Bytes of a struct's or array's compact JSON, nulls included."""
    return F.octet_length(F.to_json(value, {"ignoreNullFields": "false"}))


def valid_position(p: Column) -> Column:
    """Whether a position has two or more ordinates, all of them finite."""
    return (F.size(p) >= 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def in_wgs84(p: Column) -> Column:
    return F.get(p, F.lit(0)).between(-180.0, 180.0) & F.get(p, F.lit(1)).between(-90.0, 90.0)


def flat(p: Column) -> Column:
    return F.slice(p, 1, 2)


def valid_ring(ring: Column) -> Column:
    """Closed in XY, four positions or more, three distinct vertices."""
    xy = F.transform(ring, flat)
    distinct = F.size(F.array_distinct(F.slice(xy, F.lit(1), F.greatest(F.size(xy) - 1, F.lit(0)))))
    return (F.size(ring) >= 4) & (F.get(xy, F.lit(0)) == F.element_at(xy, -1)) & (distinct >= 3)


def valid_line(line: Column) -> Column:
    return F.size(F.array_distinct(F.transform(line, flat))) >= 2


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371000.0) -> Column:
    h = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def compensated_sum(values: Column) -> Column:
    """Neumaier's sum of an ordered array: the same total however the array was gathered."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(a: Column, v: Column) -> Column:
        t = a["s"] + v
        lost = F.when(F.abs(a["s"]) >= F.abs(v), (a["s"] - t) + v).otherwise((v - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(values, zero, step, lambda a: a["s"] + a["c"])


def issue(code: str | Column, message: str, severity: str = "warning", details: Column | None = None) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(code.alias("code"), F.lit(message).alias("message"), F.lit(severity).alias("severity"), (F.lit(None).cast("string") if details is None else details).alias("details"))


def truncated_issues(issues: Column, limits: Limits = Limits()) -> Column:
    """At most ``limits.issues`` issues; the last one then counts those left out."""
    keep = limits.issues - 1
    left_out = F.concat(F.lit('{"omitted_count":'), (F.size(issues) - keep).cast("string"), F.lit("}"))
    return F.when(F.size(issues) > limits.issues, F.concat(F.slice(issues, 1, keep), F.array(issue("ISSUES_TRUNCATED", "Further issues were left out.", "warning", left_out)))).otherwise(issues)


def with_severity(issues: Column, status: Column) -> Column:
    """Issues of an ERROR feature are errors, of any other feature warnings."""
    level = F.when(status == "ERROR", "error").otherwise("warning")
    return F.transform(issues, lambda i: F.struct(i["code"].alias("code"), i["message"].alias("message"), level.alias("severity"), i["details"].alias("details")))


def kml_positions(text: Column) -> Column:
    """Positions of a coordinates text, or null unless every token has two or three finite numbers."""
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    parts = F.transform(tokens, lambda t: F.split(t, ",", -1))
    fine = F.forall(parts, lambda p: F.size(p).isin(2, 3) & F.forall(p, lambda v: v.rlike(number)))
    return F.when(fine, F.transform(parts, lambda p: F.transform(p, lambda v: v.try_cast("double"))))
