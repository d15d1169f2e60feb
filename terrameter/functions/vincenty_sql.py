"""The inverse geodesic as plain expressions, for plans that never leave the JVM.

Short arcs settle in four rounds.  Where the last round still moves the result (far pairs, near the
antipodes) the distance is that on the mean sphere, far beyond every limit that is asked of it; the
array form, ``geodesic.inverse``, solves such pairs as well.

The JVM compiles no method of more than 8000 bytes, and all steps become one method: so no step may be null,
for which the generated code would test at each operation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .geodesic import A, B, F

ROUNDS = 5
MEAN_RADIUS = (2.0 * A + B) / 3.0


def steps() -> list[dict[str, str]]:
    """Columns to add level by level to rows with lon1, lat1, lon2 and lat2; the last adds ``distance``."""
    f = f"CAST({F!r} AS DOUBLE)"
    out = [
        {"v1": "radians(lat1)", "v2": "radians(lat2)", "l0": "radians((lon2 - lon1 + 540) % 360 - 180)"},
        {"t1": "tan(v1)", "t2": "tan(v2)"},
        {"u1": f"atan((1 - {f}) * t1)", "u2": f"atan((1 - {f}) * t2)"},
        {"su1": "sin(u1)", "cu1": "cos(u1)", "su2": "sin(u2)", "cu2": "cos(u2)", "lam0": "l0"},
        {"ssu": "su1 * su2", "ccu": "cu1 * cu2", "csu": "cu1 * su2", "scu": "su1 * cu2"},
    ]
    for i in range(ROUNDS):
        out += [
            {f"sl{i}": f"sin(lam{i})", f"cl{i}": f"cos(lam{i})"},
            {f"x{i}": f"cu2 * sl{i}", f"y{i}": f"csu - scu * cl{i}", f"cs{i}": f"ssu + ccu * cl{i}"},
            {f"ss{i}": f"sqrt(x{i} * x{i} + y{i} * y{i})"},
            {f"sg{i}": f"atan2(ss{i}, cs{i})", f"sa{i}": f"coalesce(try_divide(ccu * sl{i}, ss{i}), 0D)"},
            {f"ca{i}": f"1 - sa{i} * sa{i}"},
            {f"cm{i}": f"coalesce(cs{i} - try_divide(2 * ssu, ca{i}), 0D)", f"cc{i}": f"{F / 16!r}D * ca{i} * (4 + {f} * (4 - 3 * ca{i}))"},
            {f"w{i}": f"2 * cm{i} * cm{i} - 1"},
            {f"lam{i + 1}": f"l0 + (1 - cc{i}) * {f} * sa{i} * (sg{i} + cc{i} * ss{i} * (cm{i} + cc{i} * cs{i} * w{i}))"},
        ]
    i = ROUNDS - 1
    ratio = f"CAST({(A * A - B * B) / (B * B)!r} AS DOUBLE)"
    out += [
        {"uu": f"ca{i} * {ratio}"},
        {"aa": f"1 + uu * {1 / 16384!r}D * (4096 + uu * (-768 + uu * (320 - 175 * uu)))", "bb": f"uu * {1 / 1024!r}D * (256 + uu * (-128 + uu * (74 - 47 * uu)))"},
        {"b6": "bb / 6"},
        {"ds": f"bb * ss{i} * (cm{i} + bb * 0.25D * (cs{i} * w{i} - b6 * cm{i} * (4 * ss{i} * ss{i} - 3) * (4 * cm{i} * cm{i} - 3)))"},
        {"distance": f"CASE WHEN abs(lam{ROUNDS} - lam{i}) < 1e-11D THEN {B!r}D * aa * (sg{i} - ds) ELSE {MEAN_RADIUS!r}D * sg0 END"},
    ]
    return out


def _never_null(step: str) -> str:
    """Functions and quotients may be null by their types, sums and products of what is not may not."""
    return f"coalesce({step}, CAST('NaN' AS DOUBLE))" if re.search(r"^(?!coalesce).*(/|%|[a-z]{3}\(|atan2)", step) else step


def with_distance(rows: DataFrame) -> DataFrame:
    """``rows`` with ``distance`` in metres between (lon1, lat1) and (lon2, lat2); null where one is null."""
    keep, levels = rows.columns, steps()
    for k, level in enumerate(levels):
        later = set(re.findall(r"[a-z]+[0-9]*", " ".join(e for after in levels[k + 1 :] for e in after.values())))
        alive = [c for c in rows.columns if c in keep or c in later]  # a plan that carries every step takes seconds to make
        rows = rows.selectExpr(*alive, *[f"{_never_null(e)} AS {n}" for n, e in level.items()])
    known = " AND ".join(f"{c} IS NOT NULL" for c in ("lon1", "lat1", "lon2", "lat2"))
    return rows.selectExpr(*keep, f"CASE WHEN {known} THEN distance END AS distance")
