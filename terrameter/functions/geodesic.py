"""Geodesics on WGS84 for whole arrays, and areas under them.

The inverse uses Vincenty's series, which on arcs of at most 200 km, all that is measured, are far
better than a millimetre.  It is total: pairs near antipodes, for which that iteration does not settle,
are solved by Newton's method on the start azimuth within a bracket that always closes (Karney,
Algorithms for geodesics, 2013).  Integrals along a geodesic are taken by quadrature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# The WGS84 ellipsoid.
A = 6378137.0
F = 1.0 / 298.257223563
B = A * (1.0 - F)
E2 = F * (2.0 - F)
E2_SECOND = E2 / (1.0 - E2)


def _reduced(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine of the reduced latitude."""
    s, c = (1.0 - F) * np.sin(lat), np.cos(lat)
    norm = np.hypot(s, c)
    return s / norm, c / norm


def _series(cos2_alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u2 = cos2_alpha * (A * A - B * B) / (B * B)
    big_a = 1.0 + u2 / 16384.0 * (4096.0 + u2 * (-768.0 + u2 * (320.0 - 175.0 * u2)))
    return big_a, u2 / 1024.0 * (256.0 + u2 * (-128.0 + u2 * (74.0 - 47.0 * u2)))


def _arc_change(big_b: np.ndarray, sin_s: np.ndarray, cos_s: np.ndarray, cos_2m: np.ndarray) -> np.ndarray:
    return big_b * sin_s * (cos_2m + big_b / 4.0 * (cos_s * (2.0 * cos_2m**2 - 1.0) - big_b / 6.0 * cos_2m * (4.0 * sin_s**2 - 3.0) * (4.0 * cos_2m**2 - 3.0)))


def _gain(cos2_alpha: np.ndarray) -> np.ndarray:
    return F / 16.0 * cos2_alpha * (4.0 + F * (4.0 - 3.0 * cos2_alpha))


def _on_sphere(lam: np.ndarray, s1: np.ndarray, c1: np.ndarray, s2: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sine, cosine and size of the arc, sine and squared cosine of its azimuth at the equator, cosine at its middle."""
    sin_l, cos_l = np.sin(lam), np.cos(lam)
    sin_s = np.hypot(c2 * sin_l, c1 * s2 - s1 * c2 * cos_l)
    cos_s = s1 * s2 + c1 * c2 * cos_l
    sin_a = np.divide(c1 * c2 * sin_l, sin_s, out=np.zeros(lam.shape), where=sin_s > 0)
    cos2_alpha = np.maximum(0.0, 1.0 - sin_a * sin_a)
    middle = np.divide(2.0 * s1 * s2, cos2_alpha, out=np.zeros(lam.shape), where=cos2_alpha > 1e-15)
    return sin_s, cos_s, np.arctan2(sin_s, cos_s), sin_a, cos2_alpha, np.where(cos2_alpha > 1e-15, cos_s - middle, 0.0)


def _turn(lon1: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Degrees to the east, from -180 to 180; differences of close longitudes stay exact."""
    d = lon2 - lon1
    return d - 360.0 * np.round(d / 360.0)


@dataclass
class _Arcs:
    """Solved pairs: distance and start azimuth, and the arc's turn of longitude on the auxiliary sphere."""

    distance: np.ndarray
    azimuth: np.ndarray
    omega: np.ndarray


def _solved(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> _Arcs:
    full = np.radians(_turn(lon1, lon2))
    s1, c1 = _reduced(np.radians(lat1))
    s2, c2 = _reduced(np.radians(lat2))
    lam, change = full.copy(), np.full(full.shape, np.inf)
    for _ in range(24):
        sin_s, cos_s, sigma, sin_a, cos2_alpha, cos_2m = _on_sphere(lam, s1, c1, s2, c2)
        gain = _gain(cos2_alpha)
        new = full + (1.0 - gain) * F * sin_a * (sigma + gain * sin_s * (cos_2m + gain * cos_s * (2.0 * cos_2m**2 - 1.0)))
        moving = change >= 1e-15  # a pair that has settled stays, so its result does not depend on its batch
        change = np.where(moving, np.abs(new - lam), change)
        lam = np.where(moving, new, lam)
        if (change < 1e-15).all():
            break
    sin_s, cos_s, sigma, sin_a, cos2_alpha, cos_2m = _on_sphere(lam, s1, c1, s2, c2)
    big_a, big_b = _series(cos2_alpha)
    distance = B * big_a * (sigma - _arc_change(big_b, sin_s, cos_s, cos_2m))
    azimuth = np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
    # close to antipodes the iteration may also settle on a path that is not the shortest
    far = (np.abs(full) > np.radians(178.0)) & (np.abs(lat1 + lat2) < 2.0)
    lost = (~(change < 1e-11) | ~np.isfinite(distance) | far) & np.isfinite(full) & np.isfinite(lat1) & np.isfinite(lat2)
    if lost.any():
        distance[lost], azimuth[lost], lam[lost] = _near_antipodes(full[lost], lat1[lost], lat2[lost])
    return _Arcs(distance, azimuth, lam)


def inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    """Distances in metres and start azimuths in radians; positions in degrees.

    Coincident positions have distance 0 and azimuth 0.  Between antipodes, with more than one shortest
    path, one of them is taken.
    """
    ends = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (lon1, lat1, lon2, lat2)))
    arcs = _solved(*np.atleast_1d(*ends))
    return arcs.distance.reshape(ends[0].shape), arcs.azimuth.reshape(ends[0].shape)


# Nodes and weights of Gauss and Legendre on [0, 1].
_NODES, _WEIGHTS = (lambda n, w: ((n + 1) / 2, w / 2))(*np.polynomial.legendre.leggauss(32))


def _along(sigma1: np.ndarray, sigma2: np.ndarray, of) -> np.ndarray:
    """Integral of ``of(sin^2 sigma)`` between the arcs, for whole arrays."""
    at = sigma1[..., None] + (sigma2 - sigma1)[..., None] * _NODES
    return (sigma2 - sigma1) * (of(np.sin(at) ** 2) @ _WEIGHTS)


def _leg(azimuth: np.ndarray, s1: np.ndarray, c1: np.ndarray, s2: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, ...]:
    """The geodesic that starts at ``azimuth`` and first ends northward on the second parallel.

    Its turn of longitude, that on the sphere, the derivative of the turn by the azimuth, and its length.
    """
    sin_a, cos_a = np.sin(azimuth), np.cos(azimuth)
    sin0, cos0 = sin_a * c1, np.hypot(cos_a, sin_a * s1)
    end = np.sqrt(np.maximum(0.0, (cos_a * c1) ** 2 + (c2 - c1) * (c2 + c1)))  # cosine of the end azimuth times c2
    sigma1, sigma2 = np.arctan2(s1, cos_a * c1), np.arctan2(s2, end)
    omega = np.arctan2(sin0 * s2, end) - np.arctan2(sin0 * s1, cos_a * c1)
    k2 = (E2_SECOND * cos0 * cos0)[..., None]
    root = lambda q: np.sqrt(1.0 + k2 * q)
    turn = omega - F * sin0 * _along(sigma1, sigma2, lambda q: (2.0 - F) / (1.0 + (1.0 - F) * root(q)))
    stretch = _along(sigma1, sigma2, lambda q: k2 * q / root(q))
    w1, w2 = (np.sqrt(1.0 + k2[..., 0] * np.sin(x) ** 2) for x in (sigma1, sigma2))
    reduced = w2 * np.cos(sigma1) * np.sin(sigma2) - w1 * np.sin(sigma1) * np.cos(sigma2) - np.cos(sigma1) * np.cos(sigma2) * stretch
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (1.0 - F) * reduced / end
    return turn, omega, slope, B * _along(sigma1, sigma2, root)


def _near_antipodes(full: np.ndarray, lat1: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, azimuth, omega) of pairs that turn by ``full`` radians.

    Ends are mirrored and exchanged until the first is the southern one and furthest from the equator;
    then the turn grows with the start azimuth, from 0 due north to half a circle due south.
    """
    swap = np.abs(lat2) > np.abs(lat1)
    first, last = np.where(swap, lat2, lat1), np.where(swap, lat1, lat2)
    mirror = np.where(first > 0, -1.0, 1.0)
    (s1, c1), (s2, c2) = _reduced(np.radians(mirror * first)), _reduced(np.radians(mirror * last))
    s1 = np.where(s1 == 0, -1e-200, s1)  # the first end counts as just south of the equator
    want = np.abs(full)
    low, high = np.zeros(want.shape), np.full(want.shape, np.pi)
    azimuth = np.full(want.shape, np.pi / 2)
    for _ in range(80):
        turn, _, slope, _ = _leg(azimuth, s1, c1, s2, c2)
        off = turn - want
        low, high = np.where(off <= 0, azimuth, low), np.where(off >= 0, azimuth, high)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = azimuth - off / slope
        inside = np.isfinite(step) & (step > low) & (step < high)
        after = np.where(off == 0, azimuth, np.where(inside, step, (low + high) / 2))
        done = (np.abs(after - azimuth) <= 1e-16) | (high - low <= 4e-16)
        azimuth = after
        if done.all():
            break
    _, omega, _, distance = _leg(azimuth, s1, c1, s2, c2)
    sin0 = np.sin(azimuth) * c1
    end = np.sqrt(np.maximum(0.0, (np.cos(azimuth) * c1) ** 2 + (c2 - c1) * (c2 + c1)))
    # along the equator where that is shorter: the ends are less than half a turn of the polar radius apart
    flat = (np.abs(s1) <= 1e-200) & (s2 == 0) & (want <= (1.0 - F) * np.pi)
    distance, omega = np.where(flat, A * want, distance), np.where(flat, want / (1.0 - F), omega)
    start = np.where(flat, np.pi / 2, azimuth)
    # the azimuth at the other end, looking back, is that of the mirrored pair
    cos_start = np.where(swap, -end, np.cos(start) * c1)
    start = np.arctan2(sin0, np.where(flat, 0.0, np.where(swap, -cos_start, cos_start)))
    start = np.where(mirror * np.where(swap, -1.0, 1.0) < 0, np.pi - start, start)
    return distance, np.where(full < 0, -start, start), np.where(full < 0, -omega, omega)


#: Radius of the sphere with the ellipsoid's surface, squared.
AUTHALIC2 = A * A / 2.0 + B * B / 2.0 * np.arctanh(np.sqrt(E2)) / np.sqrt(E2)


def area_under(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Square metres between geodesics and the equator, positive for those that run east in the north.

    On a sphere the area is that of the excess; what the ellipsoid adds is an integral along the arc.
    """
    lon1, lat1, lon2, lat2 = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (lon1, lat1, lon2, lat2)))
    arcs = _solved(lon1, lat1, lon2, lat2)
    (s1, c1), (s2, c2) = _reduced(np.radians(lat1)), _reduced(np.radians(lat2))
    half = np.tan(arcs.omega / 2.0)
    t1, t2 = s1 / (1.0 + c1), s2 / (1.0 + c2)  # tangents of half the reduced latitudes
    excess = 2.0 * np.arctan2(half * (t1 + t2), 1.0 + t1 * t2)
    sin0 = np.sin(arcs.azimuth) * c1
    sigma1 = np.arctan2(s1, np.cos(arcs.azimuth) * c1)
    arc = np.arctan2(np.hypot(c2 * np.sin(arcs.omega), c1 * s2 - s1 * c2 * np.cos(arcs.omega)), s1 * s2 + c1 * c2 * np.cos(arcs.omega))
    cos0 = np.hypot(np.cos(arcs.azimuth), np.sin(arcs.azimuth) * s1)
    at = np.sin(sigma1[..., None] + arc[..., None] * _NODES) * cos0[..., None]  # sines of the reduced latitude
    square = (1.0 - at) * (1.0 + at)
    below = np.sqrt(1.0 - E2 * square)
    s = at / below  # sine of the latitude
    e = np.sqrt(E2)
    zone = A * A * (1.0 - E2) / 2.0 * (s / (1.0 - E2 * s * s) + np.arctanh(e * s) / e)
    with np.errstate(divide="ignore", invalid="ignore"):
        extra = np.where(square > 1e-14, (zone * below - AUTHALIC2 * at) / square, 0.0) @ _WEIGHTS
    return AUTHALIC2 * excess + sin0 * arc * extra


def ring_areas(lon: np.ndarray, lat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Areas of closed rings with geodesic edges, however they wind; ring i begins at ``starts[i]``.

    A ring that goes around a pole encloses the nearer one.
    """
    lon, lat = np.asarray(lon, np.float64), np.asarray(lat, np.float64)
    ends = np.append(starts[1:], len(lon))
    edge = np.ones(len(lon), bool)
    edge[ends - 1] = False  # no edge leaves a ring's last position
    at = np.flatnonzero(edge)
    ring = np.repeat(np.arange(len(starts)), ends - starts)[at]
    under = area_under(lon[at], lat[at], lon[at + 1], lat[at + 1])
    around = np.abs(np.bincount(ring, _turn(lon[at], lon[at + 1]), len(starts))) > 180.0
    first = np.searchsorted(ring, np.arange(len(starts) + 1))
    total = np.abs([math.fsum(under[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)])
    return np.where(around, 2.0 * np.pi * AUTHALIC2 - total, total)


def direct(lon, lat, azimuth, distance) -> tuple[np.ndarray, np.ndarray]:
    """Positions in degrees at ``distance`` metres from a start along ``azimuth`` (radians)."""
    lon, lat, azimuth, distance = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (lon, lat, azimuth, distance)))
    s1, c1 = _reduced(np.radians(lat))
    sin_z, cos_z = np.sin(azimuth), np.cos(azimuth)
    from_equator = np.arctan2(s1, c1 * cos_z)
    sin_a = c1 * sin_z
    cos2_alpha = 1.0 - sin_a * sin_a
    big_a, big_b = _series(cos2_alpha)
    plain = distance / (B * big_a)
    sigma, change = plain.copy(), np.full(plain.shape, np.inf)
    for _ in range(12):
        new = plain + _arc_change(big_b, np.sin(sigma), np.cos(sigma), np.cos(2.0 * from_equator + sigma))
        moving = change >= 1e-15
        change = np.where(moving, np.abs(new - sigma), change)
        sigma = np.where(moving, new, sigma)
        if (change < 1e-15).all():
            break
    sin_s, cos_s, cos_2m = np.sin(sigma), np.cos(sigma), np.cos(2.0 * from_equator + sigma)
    end_s = s1 * cos_s + c1 * sin_s * cos_z
    end_c = np.hypot(sin_a, s1 * sin_s - c1 * cos_s * cos_z)
    lam = np.arctan2(sin_s * sin_z, c1 * cos_s - s1 * sin_s * cos_z)
    gain = _gain(cos2_alpha)
    turn = lam - (1.0 - gain) * F * sin_a * (sigma + gain * sin_s * (cos_2m + gain * cos_s * (2.0 * cos_2m**2 - 1.0)))
    lon2 = (lon + np.degrees(turn) + 540.0) % 360.0 - 180.0
    return lon2, np.degrees(np.arctan2(end_s, (1.0 - F) * end_c))


def haversine(lon1, lat1, lon2, lat2, radius: float = 6371000.0) -> np.ndarray:
    """Distance in metres on a sphere."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(1.0, h)))
