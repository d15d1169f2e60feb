"""Distances by Gauss's mid-latitude formulas, as SQL for another engine.

An independent check of the inverse geodesic: published series about the middle of a segment, good to
well below a micrometre on segments of a few kilometres.
"""

from __future__ import annotations

from .geodesic import A, E2


def distance_sql(source: str) -> str:
    """A subquery that adds ``distance`` to the rows of ``source`` (lon1, lat1, lon2, lat2); null where one is null."""
    e2 = f"CAST({E2!r} AS DOUBLE)"
    levels = [
        {"dp": "radians(lat2 - lat1)", "dl": "radians((lon2 - lon1 + 540) % 360 - 180)", "pm": "radians((lat1 + lat2) / 2)"},
        {"sp": "sin(pm)", "cp": "cos(pm)"},
        {"n": f"CAST({A!r} AS DOUBLE) / sqrt(1 - {e2} * sp * sp)", "h2": f"{e2} / (1 - {e2}) * cp * cp", "t2": "(sp / cp) * (sp / cp)"},
        {"v2": "1 + h2"},
        {
            "east": "n * cp * dl * (1 - dl * dl * sp * sp / 24 + dp * dp * (1 + h2 - 9 * h2 * t2) / (24 * v2 * v2))",
            "north": "n * dp / v2 * cos(dl / 2) * (1 + dl * dl * cp * cp * (1 - 2 * h2) / 24 + dp * dp * h2 * (1 - t2) / (8 * v2 * v2))",
        },
        {"distance": "sqrt(east * east + north * north)"},
    ]
    for level in levels:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in level.items())} FROM {source})"
    return source
