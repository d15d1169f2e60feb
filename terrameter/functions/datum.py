"""Seven-parameter shifts between geodetic datums, for whole arrays.

Positions go to geocentric coordinates on their own ellipsoid (at height zero, as in two-dimensional
systems), through a Helmert transformation with small angles, and back to latitudes on WGS84.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .geodesic import A, E2

ARC_SECOND = np.pi / 648_000


@dataclass(frozen=True)
class Shift:
    """Metres, arc-seconds of the position-vector rotation, and parts per million."""

    dx: float = 0.0
    dy: float = 0.0
    dz: float = 0.0
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0

    def reversed_rotation(self) -> Shift:
        """The same numbers read in the other sign convention (coordinate frame rotation)."""
        return Shift(self.dx, self.dy, self.dz, -self.rx, -self.ry, -self.rz, self.ppm)

    def apply(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rx, ry, rz = (r * ARC_SECOND for r in (self.rx, self.ry, self.rz))
        m = 1.0 + self.ppm * 1e-6
        return (
            self.dx + m * (x - rz * y + ry * z),
            self.dy + m * (rz * x + y - rx * z),
            self.dz + m * (-ry * x + rx * y + z),
        )


def geocentric(lon: np.ndarray, lat: np.ndarray, height: np.ndarray | float, a: float, e2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Geocentric metres of positions in degrees."""
    lam, phi = np.radians(lon), np.radians(lat)
    nu = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    return (nu + height) * np.cos(phi) * np.cos(lam), (nu + height) * np.cos(phi) * np.sin(lam), (nu * (1 - e2) + height) * np.sin(phi)


def geodetic(x: np.ndarray, y: np.ndarray, z: np.ndarray, a: float, e2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitude, latitude (degrees) and height of geocentric metres, by Bowring's iteration on the reduced latitude."""
    p, b = np.hypot(x, y), a * np.sqrt(1 - e2)
    beta = np.arctan2(z * a, p * b)
    for _ in range(6):
        phi = np.arctan2(z + e2 / (1 - e2) * b * np.sin(beta) ** 3, p - e2 * a * np.cos(beta) ** 3)
        beta = np.arctan2(b / a * np.sin(phi), np.cos(phi))
    s, c = np.sin(phi), np.cos(phi)
    return np.degrees(np.arctan2(y, x)), np.degrees(phi), p * c + z * s - a * np.sqrt(1 - e2 * s * s)


def to_wgs84(lon: np.ndarray, lat: np.ndarray, a: float, e2: float, shift: Shift) -> tuple[np.ndarray, np.ndarray]:
    """WGS84 degrees of positions on the ellipsoid (a, e2); positions beyond the poles become NaN."""
    lat = np.where(np.abs(lat) <= 90.0, lat, np.nan)
    lon, lat, _ = geodetic(*shift.apply(*geocentric(lon, lat, 0.0, a, e2)), A, E2)
    return lon, lat
