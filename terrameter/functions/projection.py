"""Local projections for whole arrays (Snyder, USGS Professional Paper 1395).

Every point may have its own centre, so one call projects all components of a batch.
"""

from __future__ import annotations

import numpy as np

from .geodesic import A, E2, inverse

E = np.sqrt(E2)


def _q(sin_lat: np.ndarray) -> np.ndarray:
    es = E * sin_lat
    return (1.0 - E2) * (sin_lat / (1.0 - es * es) + np.arctanh(es) / E)


Q_POLE = float(_q(np.array(1.0)))
R_Q = A * np.sqrt(Q_POLE / 2.0)


def equal_area(lon, lat, lon0, lat0) -> tuple[np.ndarray, np.ndarray]:
    """Ellipsoidal Lambert azimuthal equal-area about (lon0, lat0); degrees in, metres out."""
    lon, lat, lon0, lat0 = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (lon, lat, lon0, lat0)))
    dl = np.radians((lon - lon0 + 540.0) % 360.0 - 180.0)
    phi, phi0 = np.radians(lat), np.radians(lat0)
    q, q0 = _q(np.sin(phi)), _q(np.sin(phi0))
    sin_b, sin_b0 = np.clip(q / Q_POLE, -1, 1), np.clip(q0 / Q_POLE, -1, 1)
    cos_b, cos_b0 = np.sqrt((1 - sin_b) * (1 + sin_b)), np.sqrt((1 - sin_b0) * (1 + sin_b0))
    polar = np.abs(np.abs(phi0) - np.pi / 2) < 1e-10
    with np.errstate(divide="ignore", invalid="ignore"):
        m0 = np.cos(phi0) / np.sqrt(1 - E2 * np.sin(phi0) ** 2)
        d = A * m0 / (R_Q * cos_b0)
        b = R_Q * np.sqrt(2.0 / (1.0 + sin_b0 * sin_b + cos_b0 * cos_b * np.cos(dl)))
        x, y = b * d * cos_b * np.sin(dl), b / d * (cos_b0 * sin_b - sin_b0 * cos_b * np.cos(dl))
    if polar.any():
        north = phi0 > 0
        rho = A * np.sqrt(np.maximum(0.0, np.where(north, Q_POLE - q, Q_POLE + q)))
        x = np.where(polar, rho * np.sin(dl), x)
        y = np.where(polar, np.where(north, -rho * np.cos(dl), rho * np.cos(dl)), y)
    return x, y


def equidistant(lon, lat, lon0, lat0) -> tuple[np.ndarray, np.ndarray]:
    """Ellipsoidal azimuthal equidistant about (lon0, lat0): distance and azimuth from the centre."""
    s, azimuth = inverse(lon0, lat0, lon, lat)
    return s * np.sin(azimuth), s * np.cos(azimuth)


def web_mercator_inverse(x, y, lon0: float, k0: float, x0: float, y0: float) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes of the web map's Mercator coordinates, which take latitudes for those of a sphere."""
    lon = lon0 + np.degrees((np.asarray(x, float) - x0) / (A * k0))
    lat = np.arctan(np.sinh((np.asarray(y, float) - y0) / (A * k0)))
    return (lon + 540.0) % 360.0 - 180.0, np.degrees(lat)
