"""Longitudes and latitudes of projected positions on any ellipsoid, for whole arrays.

Formulas of Snyder (USGS Professional Paper 1395) and of IOGP Guidance Note 7-2.  Angles are in degrees,
lengths in metres; ``a`` is the semi-major axis and ``e2`` the squared eccentricity.
"""

from __future__ import annotations

import numpy as np


def latitude_of_conformal(tau_c: np.ndarray, e2: float) -> np.ndarray:
    """Latitude (radians) from the tangent of the conformal latitude, by Newton's method."""
    e = np.sqrt(e2)
    tau = np.asarray(tau_c, float) / (1 - e2)
    for _ in range(6):
        s = np.sinh(e * np.arctanh(e * tau / np.hypot(1, tau)))
        got = tau * np.hypot(1, s) - s * np.hypot(1, tau)
        tau = tau + (tau_c - got) / np.hypot(1, got) * (1 + (1 - e2) * tau**2) / ((1 - e2) * np.hypot(1, tau))
    return np.arctan(tau)


def _e_atanh(s, e2: float):
    """arctanh(e s) / e, and its limit on a sphere."""
    e = np.sqrt(e2)
    return np.arctanh(e * s) / e if e else s


def _half_angle(phi: float, e2: float) -> float:
    """Tangent of half the conformal colatitude."""
    e, s = np.sqrt(e2), np.sin(phi)
    return float(np.tan(np.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2))


def _from_half_angle(t: np.ndarray, e2: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        tau = (1 / t - t) / 2
        return np.where(t <= 0, np.pi / 2, latitude_of_conformal(np.where(t <= 0, 0.0, tau), e2))


def _m(phi: float, e2: float) -> float:
    return float(np.cos(phi) / np.sqrt(1 - e2 * np.sin(phi) ** 2))


def _q(phi: float, e2: float) -> float:
    s = np.sin(phi)
    return float((1 - e2) * (s / (1 - e2 * s * s) + _e_atanh(s, e2)))


def _latitude_of_authalic(q: np.ndarray, e2: float) -> np.ndarray:
    """Latitude (radians) from the authalic function, by Newton's method; the poles where it has no slope."""
    pole = _q(np.pi / 2, e2)
    phi = np.arcsin(np.clip(q / pole, -1, 1))
    for _ in range(8):
        s, c = np.sin(phi), np.cos(phi)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = (1 - e2 * s * s) ** 2 / (2 * c) * (q / (1 - e2) - s / (1 - e2 * s * s) - _e_atanh(s, e2))
        phi = phi + np.where(c > 1e-9, step, 0.0)
    return np.where(np.abs(q) > pole * (1 + 1e-12), np.nan, phi)


def _wrapped(lon: np.ndarray) -> np.ndarray:
    return (lon + 540.0) % 360.0 - 180.0


def mercator(x, y, a, e2, lon0, k0, x0, y0):
    phi = latitude_of_conformal(np.sinh((np.asarray(y, float) - y0) / (a * k0)), e2)
    return _wrapped(lon0 + np.degrees((np.asarray(x, float) - x0) / (a * k0))), np.degrees(phi)


def scale_at(lat: float, e2: float) -> float:
    """Scale at the equator of a Mercator projection that is true at ``lat``."""
    return _m(np.radians(abs(lat)), e2)


def _cone(x, y, n: float, rho0: float):
    x, y = np.asarray(x, float), rho0 - np.asarray(y, float)
    sign = np.sign(n)
    return np.hypot(x, y), np.arctan2(sign * x, sign * y)


def conformal_conic(x, y, a, e2, lon0, lat0, lat1, lat2, k0, x0, y0):
    """Lambert's cone through two parallels, or touching one with a scale (lat1 = lat2)."""
    p0, p1, p2 = np.radians([lat0, lat1, lat2])
    m1, t1 = _m(p1, e2), _half_angle(p1, e2)
    n = float(np.sin(p1)) if p1 == p2 else float(np.log(m1 / _m(p2, e2)) / np.log(t1 / _half_angle(p2, e2)))
    f = a * k0 * m1 / (n * t1**n)
    rho, theta = _cone(np.asarray(x, float) - x0, np.asarray(y, float) - y0, n, f * _half_angle(p0, e2) ** n)
    with np.errstate(divide="ignore"):
        t = np.where(rho > 0, (rho / abs(f)) ** (1 / n), 0.0 if n > 0 else np.inf)
    phi = np.where(np.isfinite(t), _from_half_angle(np.where(np.isfinite(t), t, 1.0), e2), -np.pi / 2)
    return _wrapped(lon0 + np.degrees(theta / n)), np.degrees(phi)


def equal_area_conic(x, y, a, e2, lon0, lat0, lat1, lat2, x0, y0):
    """Albers' cone through two parallels."""
    p0, p1, p2 = np.radians([lat0, lat1, lat2])
    m1, m2, q1, q2 = _m(p1, e2), _m(p2, e2), _q(p1, e2), _q(p2, e2)
    n = float(np.sin(p1)) if p1 == p2 else (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho, theta = _cone(np.asarray(x, float) - x0, np.asarray(y, float) - y0, n, a * np.sqrt(c - n * _q(p0, e2)) / n)
    return _wrapped(lon0 + np.degrees(theta / n)), np.degrees(_latitude_of_authalic((c - (rho * n / a) ** 2) / n, e2))


def azimuthal_equal_area(x, y, a, e2, lon0, lat0, x0, y0):
    x, y = np.asarray(x, float) - x0, np.asarray(y, float) - y0
    p0, pole = np.radians(lat0), _q(np.pi / 2, e2)
    if abs(abs(lat0) - 90.0) < 1e-10:
        north = np.sign(lat0)
        return _wrapped(lon0 + np.degrees(np.arctan2(x, -north * y))), np.degrees(_latitude_of_authalic(north * (pole - (np.hypot(x, y) / a) ** 2), e2))
    b0, r = np.arcsin(_q(p0, e2) / pole), a * np.sqrt(pole / 2)
    d = a * _m(p0, e2) / (r * np.cos(b0))
    rho = np.hypot(x / d, y * d)
    ce = 2 * np.arcsin(np.where(rho <= 2 * r, rho / (2 * r), np.nan))
    with np.errstate(divide="ignore", invalid="ignore"):
        sin_b = np.cos(ce) * np.sin(b0) + np.where(rho > 0, d * y * np.sin(ce) * np.cos(b0) / rho, 0.0)
    lon = np.arctan2(x * np.sin(ce), d * rho * np.cos(b0) * np.cos(ce) - d * d * y * np.sin(b0) * np.sin(ce))
    return _wrapped(lon0 + np.degrees(np.where(rho > 0, lon, 0.0))), np.degrees(_latitude_of_authalic(pole * sin_b, e2))


def polar_stereographic(x, y, a, e2, lon0, pole, lat_true, k0, x0, y0):
    """About the pole +1 or -1; true at the parallel ``lat_true``, or with the scale ``k0`` where that is None."""
    x, y = np.asarray(x, float) - x0, np.asarray(y, float) - y0
    e, rho = np.sqrt(e2), np.hypot(x, y)
    if lat_true is None:
        t = rho * np.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e)) / (2 * a * k0)
    else:
        p = np.radians(abs(lat_true))
        t = rho * _half_angle(p, e2) / (a * k0 * _m(p, e2))
    return _wrapped(lon0 + np.degrees(np.arctan2(x, -pole * y))), np.degrees(pole * _from_half_angle(t, e2))


def oblique_mercator(x, y, a, e2, lon_c, lat_c, azimuth, rectified, k0, x0, y0, at_center: bool):
    """Hotine's projection along a line through (lon_c, lat_c); ``at_center``: offsets belong to that point."""
    pc, alpha, gamma = np.radians([lat_c, azimuth, rectified])
    e, s = np.sqrt(e2), np.sin(pc)
    b = np.sqrt(1 + e2 * np.cos(pc) ** 4 / (1 - e2))
    big_a = a * b * k0 * np.sqrt(1 - e2) / (1 - e2 * s * s)
    d = max(1.0, float(b * np.sqrt(1 - e2) / (np.cos(pc) * np.sqrt(1 - e2 * s * s))))
    side = 1.0 if pc >= 0 else -1.0
    f = d + np.sqrt(d * d - 1) * side
    h = f * _half_angle(pc, e2) ** b
    gamma0 = np.arcsin(np.sin(alpha) / d)
    lon0 = np.radians(lon_c) - np.arcsin(np.clip((f - 1 / f) / 2 * np.tan(gamma0), -1, 1)) / b
    x, y = np.asarray(x, float) - x0, np.asarray(y, float) - y0
    v, u = x * np.cos(gamma) - y * np.sin(gamma), y * np.cos(gamma) + x * np.sin(gamma)
    if at_center:
        across = big_a * (np.radians(lon_c) - lon0) if abs(abs(azimuth) - 90) < 1e-9 else big_a / b * np.arctan2(np.sqrt(d * d - 1), np.cos(alpha))
        u = u + abs(across) * side
    q = np.exp(-b * v / big_a)
    s_, t_, v_ = (q - 1 / q) / 2, (q + 1 / q) / 2, np.sin(b * u / big_a)
    u_ = np.clip((v_ * np.cos(gamma0) + s_ * np.sin(gamma0)) / t_, -1, 1)
    with np.errstate(divide="ignore"):
        t = (h / np.sqrt((1 + u_) / (1 - u_))) ** (1 / b)
    lon = lon0 - np.arctan2(s_ * np.cos(gamma0) - v_ * np.sin(gamma0), np.cos(b * u / big_a)) / b
    return _wrapped(np.degrees(lon)), np.degrees(_from_half_angle(t, e2))


def _krueger(e2: float) -> tuple[list[float], float]:
    """Coefficients of the inverse series to the fourth order in the third flattening, and the meridian radius by the axis."""
    n = (1 - np.sqrt(1 - e2)) / (1 + np.sqrt(1 - e2))
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return beta, (1 + n**2 / 4 + n**4 / 64) / (1 + n)


def transverse_mercator(x, y, a, e2, lon0, lat0, k0, x0, y0):
    """Krueger's series."""
    beta, radius = _krueger(e2)
    chi = np.arctan(np.sinh(isometric(np.radians(lat0), e2))) if abs(lat0) < 90 else np.radians(lat0)
    start = chi
    for _ in range(20):  # the rectifying latitude, by inverting the series
        start = chi + sum(b * np.sin(2 * k * start) for k, b in enumerate(beta, 1))
    xi = (np.asarray(y, float) - y0) / (k0 * a * radius) + start
    eta = (np.asarray(x, float) - x0) / (k0 * a * radius)
    xi_c = xi - sum(b * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, b in enumerate(beta, 1))
    eta_c = eta - sum(b * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, b in enumerate(beta, 1))
    tau_c = np.sin(xi_c) / np.hypot(np.sinh(eta_c), np.cos(xi_c))
    return _wrapped(lon0 + np.degrees(np.arctan2(np.sinh(eta_c), np.cos(xi_c)))), np.degrees(latitude_of_conformal(tau_c, e2))


def isometric(phi, e2: float):
    """Isometric latitude: the logarithm of the conformal half angle's cotangent."""
    return np.arcsinh(np.tan(phi)) - e2 * _e_atanh(np.sin(phi), e2)


# Nodes and weights of Gauss and Legendre on [0, 1]: meridian arcs to full precision.
_NODES, _WEIGHTS = (np.polynomial.legendre.leggauss(24)[0] + 1) / 2, np.polynomial.legendre.leggauss(24)[1] / 2


def meridian_arc(phi, a: float, e2: float):
    """Metres along a meridian from the equator to ``phi`` (radians), by quadrature of the radius of curvature."""
    phi = np.asarray(phi, float)
    at = np.sin(phi[..., None] * _NODES)
    return a * (1 - e2) * phi * ((1 - e2 * at * at) ** -1.5 @ _WEIGHTS)


def _latitude_of_arc(m, a: float, e2: float):
    """Latitude (radians) at ``m`` metres along a meridian, by Newton's method."""
    phi = np.asarray(m, float) / meridian_arc(np.pi / 2, a, e2) * (np.pi / 2)
    for _ in range(6):
        phi = phi - (meridian_arc(phi, a, e2) - m) * (1 - e2 * np.sin(phi) ** 2) ** 1.5 / (a * (1 - e2))
    return phi


def oblique_stereographic(x, y, a, e2, lon0, lat0, k0, x0, y0):
    """Double stereographic: the ellipsoid on a conformal sphere about (lon0, lat0), and that on the plane."""
    p0 = np.radians(lat0)
    s, c = np.sin(p0), np.cos(p0)
    radius = a * np.sqrt(1 - e2) / (1 - e2 * s * s)
    n = np.sqrt(1 + e2 * c**4 / (1 - e2))
    chi0 = np.arcsin(s / n)
    offset = n * isometric(p0, e2) - isometric(chi0, 0.0)
    x, y = np.asarray(x, float) - x0, np.asarray(y, float) - y0
    rho = np.hypot(x, y)
    arc = 2 * np.arctan(rho / (2 * radius * k0))
    with np.errstate(divide="ignore", invalid="ignore"):
        sin_chi = np.cos(arc) * np.sin(chi0) + np.where(rho > 0, y * np.sin(arc) * np.cos(chi0) / rho, 0.0)
    turn = np.arctan2(x * np.sin(arc), rho * np.cos(chi0) * np.cos(arc) - y * np.sin(chi0) * np.sin(arc))
    psi = (np.arctanh(np.clip(sin_chi, -1, 1)) + offset) / n
    return _wrapped(lon0 + np.degrees(np.where(rho > 0, turn, 0.0) / n)), np.degrees(latitude_of_conformal(np.sinh(psi), e2))


def krovak(x, y, a, e2, lon0, lat0, tilt, lat1, k0, x0, y0, grid_north: bool):
    """Oblique conformal cone whose axis is tilted by ``tilt`` against the pole, touching the pseudo parallel ``lat1``.

    Positions are southing and westing, or eastings and northings (their negatives) with ``grid_north``.
    """
    p0, alpha, p1 = np.radians([lat0, tilt, lat1])
    x, y = np.asarray(x, float), np.asarray(y, float)
    south, west = (-(y - y0), -(x - x0)) if grid_north else (x - y0, y - x0)
    s = np.sin(p0)
    radius = a * np.sqrt(1 - e2) / (1 - e2 * s * s)
    b = np.sqrt(1 + e2 * np.cos(p0) ** 4 / (1 - e2))
    offset = b * isometric(p0, e2) - np.arctanh(s / b)
    n = np.sin(p1)
    rho0 = k0 * radius / np.tan(p1)
    rho, turn = np.hypot(south, west), np.arctan2(west, south) / n
    with np.errstate(divide="ignore"):
        t = 2 * np.arctan((rho0 / rho) ** (1 / n) * np.tan(p1 / 2 + np.pi / 4)) - np.pi / 2
    u = np.arcsin(np.cos(alpha) * np.sin(t) - np.sin(alpha) * np.cos(t) * np.cos(turn))
    v = np.arcsin(np.clip(np.cos(t) * np.sin(turn) / np.cos(u), -1, 1))
    return _wrapped(lon0 - np.degrees(v / b)), np.degrees(latitude_of_conformal(np.sinh((np.arctanh(np.sin(u)) + offset) / b), e2))


def cassini(x, y, a, e2, lon0, lat0, x0, y0):
    """Cassini and Soldner's projection by its series, corrected until the forward series gives the position."""
    x, y = np.asarray(x, float) - x0, np.asarray(y, float) - y0
    m0 = meridian_arc(np.radians(lat0), a, e2)
    at_x, at_y = x, y
    for _ in range(4):
        foot = _latitude_of_arc(m0 + at_y, a, e2)
        w = 1 - e2 * np.sin(foot) ** 2
        nu, rho, t = a / np.sqrt(w), a * (1 - e2) / w**1.5, np.tan(foot) ** 2
        d = at_x / nu
        phi = foot - nu * np.tan(foot) / rho * (d**2 / 2 - (1 + 3 * t) * d**4 / 24)
        lam = (d - t * d**3 / 3 + (1 + 3 * t) * t * d**5 / 15) / np.cos(foot)
        back_x, back_y = cassini_forward(lam, phi, a, e2, m0)
        at_x, at_y = at_x + x - back_x, at_y + y - back_y
    return _wrapped(lon0 + np.degrees(lam)), np.degrees(phi)


def cassini_forward(lam, phi, a, e2, m0):
    """Metres from the origin, by the series; angles in radians from the central meridian."""
    nu, t, c = a / np.sqrt(1 - e2 * np.sin(phi) ** 2), np.tan(phi) ** 2, e2 * np.cos(phi) ** 2 / (1 - e2)
    d = lam * np.cos(phi)
    x = nu * (d - t * d**3 / 6 - (8 - t + 8 * c) * t * d**5 / 120)
    return x, meridian_arc(phi, a, e2) - m0 + nu * np.tan(phi) * (d**2 / 2 + (5 - t + 6 * c) * d**4 / 24)


def polyconic(x, y, a, e2, lon0, lat0, x0, y0):
    """American polyconic projection: the latitude whose parallel's circle passes through the position, by Newton's method.

    With the height h of the position over that parallel's foot and the circle's radius r, the circle asks
    for x^2 + h^2 = 2 r h.
    """
    x = np.asarray(x, float) - x0
    height = np.asarray(y, float) - y0 + meridian_arc(np.radians(lat0), a, e2)
    phi = _latitude_of_arc(height, a, e2)
    flat = np.abs(height) < 1e-9 * a
    phi = np.where(np.abs(phi) < 1e-12, 1e-12, phi)
    for _ in range(12):
        s, c, w = np.sin(phi), np.cos(phi), 1 - e2 * np.sin(phi) ** 2
        h, r = height - meridian_arc(phi, a, e2), a / np.sqrt(w) * c / s
        slope_h, slope_r = -a * (1 - e2) / w**1.5, a * e2 * c * c / w**1.5 - a / np.sqrt(w) / s**2
        with np.errstate(divide="ignore", invalid="ignore"):
            step = (x**2 + h**2 - 2 * r * h) / (2 * h * slope_h - 2 * r * slope_h - 2 * h * slope_r)
        phi = phi - np.where(np.isfinite(step), step, 0.0)
    s = np.sin(phi)
    r, h = a / np.sqrt(1 - e2 * s * s) * np.cos(phi) / s, height - meridian_arc(phi, a, e2)
    lam = np.arctan2(np.sign(r) * x, np.sign(r) * (r - h)) / s
    return _wrapped(lon0 + np.degrees(np.where(flat, x / a, lam))), np.degrees(np.where(flat, 0.0, phi))


def cylindrical_equal_area(x, y, a, e2, lon0, lat1, x0, y0):
    k = scale_at(lat1, e2)
    q = 2 * (np.asarray(y, float) - y0) * k / a
    return _wrapped(lon0 + np.degrees((np.asarray(x, float) - x0) / (a * k))), np.degrees(_latitude_of_authalic(q, e2))
