"""Golden values, statuses and invariants of the measurement kernel."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrameter.functions import map_projections as maps
from terrameter.functions import topology
from terrameter.functions.crs import WGS84_WKT, CrsError, crs_from_wkt
from terrameter.functions.datum import Shift, geocentric, geodetic
from terrameter.functions.geodesic import AUTHALIC2, E2, A, area_under, direct, inverse, ring_areas
from terrameter.functions.projection import equal_area
from terrameter.model import Limits
from terrameter.operators import measure
from terrameter.operators.measure import measure_batch, measure_geometry


def square(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def closed(*points):
    return [list(p) for p in (*points, points[0])]


def polygon(*rings):
    return {"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]}


def line(*points):
    return {"type": "LineString", "coordinates": [list(p) for p in points]}


def multi(*shells):
    return {"type": "MultiPolygon", "coordinates": [[s] for s in shells]}


def measured(geometry, wkt=WGS84_WKT, **limits):
    r = measure_geometry(geometry, wkt, Limits(**limits))
    return r["measurement_status"], r["area_m2"] if r["area_m2"] is not None else r["length_m"], [i["code"] for i in r["issues"]]


# Published reference values: geodesic polygon areas and lengths on WGS84.
AREAS = [
    (polygon(square(77.58, 12.96, 77.59, 12.97)), 1200336.865179062),
    (polygon(closed((179.9, -0.05), (-179.9, -0.05), (-179.9, 0.05), (179.9, 0.05)), closed((179.95, -0.02), (-179.95, -0.02), (-179.95, 0.02), (179.95, 0.02))), 196945362.9047038),
    (polygon(closed((-135, 89.5), (-45, 89.5), (45, 89.5), (135, 89.5))), 6237848505.78125),
    (polygon(square(140, -75, 140.1, -74.9)), 32364794.9581604),
    (polygon(square(-0.8, -0.001, 0.8, 0.001), square(-0.0000005, -0.0005, 0.0000005, 0.0005)), 39391595.494236626),
]
LENGTHS = [
    (line((0, 0), (1.78, 0)), 198148.69361202695),
    (line((77.58, 12.96), (77.62, 12.99)), 5463.444432701309),
    (line((179.9, 0), (-179.9, 0)), 22263.898158653446),
]


@pytest.mark.parametrize(("geometry", "expected"), AREAS)
def test_areas(geometry, expected):
    status, value, _ = measured(geometry)
    assert status == "MEASURED" and abs(value - expected) <= max(0.01, 1e-3 * expected)
    assert abs(value - expected) <= max(0.5, 1e-9 * expected)  # the equal-area chart is much better than required


@pytest.mark.parametrize(("geometry", "expected"), LENGTHS)
def test_lengths(geometry, expected):
    status, value, _ = measured(geometry)
    assert status == "MEASURED" and abs(value - expected) <= max(0.001, 1e-3 * expected)


# Published near-antipodal pairs: positions, metres and start azimuth.
FAR = [((0, -30, 179.8, 29.9), 19989832.827610, 161.890524736), ((0, 0, 179.5, 0.5), 19936288.578965, 25.671872868), ((0, 0, 180, 0), 20003931.458625, None), ((0, 90, 180, -90), 20003931.458625, None), ((7, 30, -173, -30), 20003931.458625, None)]


@pytest.mark.parametrize(("ends", "metres", "azimuth"), FAR)
def test_inverse_near_antipodes(ends, metres, azimuth):
    lon1, lat1, lon2, lat2 = ends
    distance, start = inverse(*ends)
    assert abs(distance - metres) < 1e-3 and (azimuth is None or abs(np.degrees(start) - azimuth) < 1e-8)
    for other in ((lon2, lat2, lon1, lat1), (lon1, -lat1, lon2, -lat2), (-lon1, lat1, -lon2, lat2), (lon1 + 50, lat1, lon2 + 50, lat2)):
        distance, start = inverse(*other)
        assert abs(distance - metres) < 1e-3
        if azimuth is not None:  # from the start along the azimuth lies the other end
            lon, lat = direct(other[0], other[1], start, distance)
            assert float(inverse(lon, lat, other[2], other[3])[0]) < 1e-3


def test_inverse_is_total_and_settles_everywhere():
    """Random pairs, pairs around antipodes and along the equator: never NaN, symmetric, and reached again by the direct solution."""
    rng = np.random.default_rng(4)
    lon1, lat1 = rng.uniform(-180, 180, 4000), np.round(rng.uniform(-90, 90, 4000), 3)
    lat1[:400] = 0
    lon2 = np.where(np.arange(4000) % 2, lon1 + 180 + rng.normal(0, 0.7, 4000), rng.uniform(-180, 180, 4000))
    lat2 = np.where(np.arange(4000) % 2, -lat1 + rng.normal(0, 0.5, 4000), rng.uniform(-90, 90, 4000)).clip(-90, 90)
    lat2[:200] = 0
    distance, azimuth = inverse(lon1, lat1, lon2, lat2)
    assert np.isfinite(distance).all() and np.isfinite(azimuth).all() and distance.max() < 20003931.459
    assert np.abs(distance - inverse(lon2, lat2, lon1, lat1)[0]).max() < 1e-3
    lon, lat = direct(lon1, lat1, azimuth, distance)
    assert inverse(lon, lat, lon2, lat2)[0].max() < 1e-3
    assert np.abs(inverse(0, 0, [179.0, 179.39], 0)[0] - A * np.radians([179.0, 179.39])).max() < 1e-6


def geodesic_area_of(geometry):
    rings = [np.array(r) for r in geometry["coordinates"]]
    points = np.concatenate(rings)
    areas = ring_areas(points[:, 0], points[:, 1], np.cumsum([0, *(len(r) for r in rings)])[:-1])
    return areas[0] - areas[1:].sum()


@pytest.mark.parametrize(("geometry", "expected"), AREAS)
def test_geodesic_areas(geometry, expected):
    assert abs(geodesic_area_of(geometry) - expected) < 1e-3 + 1e-10 * expected


def zone(lat):
    """Area between the equator and a parallel, for a radian of longitude."""
    s, e = math.sin(math.radians(lat)), math.sqrt(E2)
    return A * A * (1 - E2) / 2 * (s / (1 - E2 * s * s) + math.atanh(e * s) / e)


def test_geodesic_areas_of_zones_and_caps():
    lon = np.linspace(-180, 180, 7201)
    for lat in (-89.9, -40.0, 0.5, 60.0, 89.0):
        cap = ring_areas(lon, np.full(len(lon), lat), np.array([0]))[0]
        assert cap == pytest.approx(2 * math.pi * (zone(90) - abs(zone(lat))), rel=2e-6)
        assert cap == pytest.approx(ring_areas(lon[::-1], np.full(len(lon), lat), np.array([0]))[0], rel=1e-9)
    assert ring_areas(np.array([0, 90, 0, 0.0]), np.array([0, 0, 90, 0.0]), np.array([0]))[0] == pytest.approx(math.pi * AUTHALIC2 / 2, rel=1e-14)
    assert zone(90) == pytest.approx(AUTHALIC2, rel=1e-15) and 4 * math.pi * AUTHALIC2 == pytest.approx(510065621724088.44, rel=1e-13)
    # both halves of an edge together, and pairs across the date line
    middle = direct(10, 40, *(lambda d, z: (z, d / 2))(*inverse(10, 40, 75, -20)))
    assert float(area_under(10, 40, 75, -20)) == pytest.approx(float(area_under(10, 40, *middle) + area_under(*middle, 75, -20)), rel=1e-9)
    assert float(area_under(179, 10, -179, 11)) == pytest.approx(float(area_under(-1, 10, 1, 11)), rel=1e-12)


def test_geodesic_areas_of_small_rings():
    """A few centimetres to a few kilometres, far from the equator: the error is that of the coordinates."""
    for size in (1e-7, 1e-5, 1e-2):
        for lat in (-75.0, 48.0):
            ring = np.array(square(100, lat, 100 + size, lat + size))
            want = math.radians(size) * (zone(lat + size) - zone(lat))
            got = ring_areas(ring[:, 0], ring[:, 1], np.array([0]))[0]
            assert got == pytest.approx(abs(want), rel=1e-4, abs=1e-5)


UTM = 'PROJCS["WGS 84 / UTM zone 31N",' + WGS84_WKT + ',PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",3],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1]]'


def test_projected_line_is_the_geodesic_of_its_ends():
    lon, lat = maps.transverse_mercator([500000.0, 500003.0], [0.0, 4.0], A, E2, 3, 0, 0.9996, 500000, 0)
    expected = float(inverse(lon[0], lat[0], lon[1], lat[1])[0])
    status, value, _ = measured(line((500000, 0), (500003, 4)), UTM)
    assert status == "MEASURED" and abs(value - expected) < 1e-6 and abs(value - 5 / 0.9996) < 1e-3


def dms(d, m, s=0.0):
    return d + m / 60 + s / 3600


def e2_of(inverse_flattening):
    return (2 - 1 / inverse_flattening) / inverse_flattening


CLARKE, EVEREST = e2_of(294.97870), e2_of(300.8017)
AIRY, BESSEL = (6377563.396, e2_of(299.3249646)), (6377397.155, e2_of(299.15281))
# Published worked examples of the projections: function, projected position, constants, geographic position.
EXAMPLES = [
    (maps.conformal_conic, (2963503.91, 254759.80), (20925832.16, CLARKE, -99, dms(27, 50), dms(28, 23), dms(30, 17), 1.0, 2_000_000, 0), (-96.0, 28.5)),
    (maps.conformal_conic, (255966.58, 142493.51), (6378206.4, CLARKE, -77, 18, 18, 18, 1.0, 250_000, 150_000), (-dms(76, 56, 37.26), dms(17, 55, 55.80))),
    (maps.equal_area_conic, (1885472.7, 1535925.0), (6378206.4, 0.00676866, -96, 23, 29.5, 45.5, 0, 0), (-75.0, 35.0)),
    (maps.azimuthal_equal_area, (3962799.45, 2999718.85), (6378137, e2_of(298.257222101), 10, 52, 4_321_000, 3_210_000), (5.0, 50.0)),
    (maps.polar_stereographic, (3320416.75, 632668.43), (6378137, e2_of(298.257223563), 0, 1.0, None, 0.994, 2_000_000, 2_000_000), (44.0, 73.0)),
    (maps.polar_stereographic, (7255380.79, 7053389.56), (6378137, e2_of(298.257223563), 70, -1.0, -71, 1.0, 6_000_000, 6_000_000), (120.0, -75.0)),
    (maps.oblique_mercator, (679245.73, 596562.78), (6377298.556, EVEREST, 115, 4, dms(53, 18, 56.9537), dms(53, 7, 48.3685), 0.99984, 590476.87, 442857.65, True), (dms(115, 48, 19.8196), dms(5, 23, 14.1129))),
    (maps.oblique_mercator, (679245.73, 596562.78), (6377298.556, EVEREST, 115, 4, dms(53, 18, 56.9537), dms(53, 7, 48.3685), 0.99984, 0, 0, False), (dms(115, 48, 19.8196), dms(5, 23, 14.1129))),
    (maps.transverse_mercator, (651409.903, 313177.270), (*AIRY, -2, 49, 0.9996012717, 400_000, -100_000), (dms(1, 43, 4.5177), dms(52, 39, 27.2531))),
    (maps.transverse_mercator, (577274.99, 69740.50), (*AIRY, -2, 49, 0.9996012717, 400_000, -100_000), (0.5, 50.5)),
    (maps.oblique_stereographic, (196105.283, 557057.739), (*BESSEL, dms(5, 23, 15.5), dms(52, 9, 22.178), 0.9999079, 155_000, 463_000), (6.0, 53.0)),
    (maps.krovak, (1050538.643, 568990.997), (*BESSEL, 42.5 - dms(17, 40), 49.5, dms(30, 17, 17.30311), 78.5, 0.9999, 0, 0, False), (dms(16, 50, 59.179), dms(50, 12, 32.442))),
    (maps.krovak, (-568990.997, -1050538.643), (*BESSEL, 42.5 - dms(17, 40), 49.5, dms(30, 17, 17.30311), 78.5, 0.9999, 0, 0, True), (dms(16, 50, 59.179), dms(50, 12, 32.442))),
    (maps.cassini, (66644.94, 82536.22), (31706587.88, e2_of(294.2606763), -dms(61, 20), dms(10, 26, 30), 430_000, 325_000), (-62.0, 10.0)),
    (maps.polyconic, (1776774.5, 1319657.8), (6378206.4, 0.00676866, -96, 30, 0, 0), (-75.0, 40.0)),
    (maps.polyconic, (1776774.5, -1319657.8), (6378206.4, 0.00676866, -96, -30, 0, 0), (-75.0, -40.0)),
    (maps.cylindrical_equal_area, (-332699.8, -554248.5), (6378206.4, 0.00676866, -75, 5, 0, 0), (-78.0, -5.0)),
    (maps.mercator, (165704.29, 5171848.07), (6378245, e2_of(298.3), 51, maps.scale_at(42, e2_of(298.3)), 0, 0), (53.0, 53.0)),
]


@pytest.mark.parametrize(("inverse_of", "position", "constants", "expected"), EXAMPLES)
def test_published_projections(inverse_of, position, constants, expected):
    lon, lat = inverse_of(*(np.array([v]) for v in position), *constants)
    assert abs(lon[0] - expected[0]) < 2e-6 and abs(lat[0] - expected[1]) < 2e-6


def projected(name, base=WGS84_WKT, **parameters):
    return f'PROJCS["x",{base},PROJECTION["{name}"],' + ",".join(f'PARAMETER["{k}",{v}]' for k, v in parameters.items()) + ',UNIT["metre",1]]'


ETRS = 'GEOGCS["ETRS89",DATUM["European_Terrestrial_Reference_System_1989",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


@pytest.mark.parametrize(
    "wkt",
    [
        projected("Lambert_Conformal_Conic_2SP", latitude_of_origin=46.5, central_meridian=3, standard_parallel_1=49, standard_parallel_2=44), projected("Lambert_Conformal_Conic", latitude_of_origin=46.5, central_meridian=3, standard_parallel_1=46.5),
        projected("Lambert_Conformal_Conic_1SP", latitude_of_origin=46.5, central_meridian=3, scale_factor=0.9999), projected("Albers_Conic_Equal_Area", latitude_of_center=46, longitude_of_center=3, standard_parallel_1=43, standard_parallel_2=48),
        projected("Lambert_Azimuthal_Equal_Area", ETRS, latitude_of_center=46, longitude_of_center=3), projected("Hotine_Oblique_Mercator_Azimuth_Center", latitude_of_center=46, longitude_of_center=3, azimuth=30, rectified_grid_angle=30, scale_factor=1),
        projected("Oblique_Stereographic", latitude_of_origin=46, central_meridian=3, scale_factor=1), projected("Cassini_Soldner", latitude_of_origin=46, central_meridian=3), projected("Polyconic", latitude_of_origin=46, central_meridian=3),
        projected("Mercator_2SP", standard_parallel_1=46, central_meridian=3), projected("Transverse_Mercator", ETRS, latitude_of_origin=46, central_meridian=3, scale_factor=1),
    ],
)
def test_every_projection_has_a_local_scale_of_one(wkt):
    """Near a projection's own origin a short line is about as long as its grid length; the equal-area ones keep areas."""
    crs = crs_from_wkt(wkt)
    x, y = (5_000.0, 8_000.0) if "Mercator_2SP" not in wkt else (5_000.0, 4_000_000.0)
    lon, lat = crs.to_wgs84(np.array([x, x + 300, x + 300]), np.array([y, y, y + 300]))
    assert abs(lon[0] - 3) < 1 and np.isfinite(lat).all()
    sides = [float(inverse(lon[i], lat[i], lon[i + 1], lat[i + 1])[0]) for i in (0, 1)]
    assert sides[0] * sides[1] == pytest.approx(90_000, rel=0.2 if "Mercator_2SP" in wkt else 0.004)
    if "Equal" in wkt:
        assert sides[0] * sides[1] == pytest.approx(90_000, rel=1e-4)
    status, value, _ = measured(line((x, y), (x + 300, y + 300)), wkt)
    assert status == "MEASURED" and value == pytest.approx(math.hypot(*sides), rel=2e-3)


def test_published_datum_shifts():
    """Worked examples of the position vector, coordinate frame and translation methods."""
    vector = Shift(0, 0, 4.5, 0, 0, 0.554, 0.219)
    frame = Shift(0, 0, 4.5, 0, 0, -0.554, 0.219).reversed_rotation()
    for shift in (vector, frame):
        got = shift.apply(3657660.66, 255768.55, 5201382.11)
        assert np.abs(np.subtract(got, (3657660.78, 255778.43, 5201387.75))).max() < 0.01
    wgs, international = (6378137.0, e2_of(298.257223563)), (6378388.0, e2_of(297.0))
    x, y, z = geocentric(dms(2, 7, 46.38), dms(53, 48, 33.82), 73.0, *wgs)
    assert np.abs(np.subtract((x, y, z), (3771793.97, 140253.34, 5124304.35))).max() < 0.01
    lon, lat, height = geodetic(x + 84.87, y + 96.49, z + 116.95, *international)
    assert abs(lon - dms(2, 7, 51.477)) < 3e-7 and abs(lat - dms(53, 48, 36.565)) < 3e-7 and abs(height - 28.02) < 0.01


def geographic(datum, axis, flattening, *more):
    return f'GEOGCS["x",DATUM["{datum}",SPHEROID["x",{axis},{flattening}]{"".join("," + m for m in more)}],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


def bound(source, method, **parameters):
    source = source.replace("GEOGCS", "GEOGCRS").replace("SPHEROID", "ELLIPSOID")
    target = 'GEOGCRS["WGS 84",DATUM["World Geodetic System 1984",ELLIPSOID["WGS 84",6378137,298.257223563]]]'
    return f'BOUNDCRS[SOURCECRS[{source}],TARGETCRS[{target}],ABRIDGEDTRANSFORMATION["x",METHOD["{method}"],' + ",".join(f'PARAMETER["{k.replace("_", " ").replace("axis", "-axis")}",{v}]' for k, v in parameters.items()) + "]]"


def test_stated_shifts_are_applied():
    """The same shift in three forms of text gives the same positions, far from those without it."""
    numbers = (446.448, -125.157, 542.06, 0.15, 0.247, 0.8421, -20.4894)
    names = ("Xaxis_translation", "Yaxis_translation", "Zaxis_translation", "Xaxis_rotation", "Yaxis_rotation", "Zaxis_rotation", "Scale_difference")
    plain = geographic("OSGB_1936", 6377563.396, 299.3249646)
    as_vector = dict(zip(names, (*numbers[:6], 1 + numbers[6] * 1e-6), strict=True))
    as_frame = dict(zip(names, (*numbers[:3], *(-r for r in numbers[3:6]), numbers[6]), strict=True))
    forms = [
        geographic("OSGB_1936", 6377563.396, 299.3249646, f"TOWGS84[{','.join(map(str, numbers))}]"),
        bound(plain, "Position Vector transformation (geog2D domain)", **as_vector),
        bound(plain, "Coordinate Frame rotation (geog2D domain)", **as_frame),
    ]
    lon, lat = np.array([1.7179216, -2.5]), np.array([52.6575703, 57.25])
    want = geodetic(*Shift(*numbers).apply(*geocentric(lon, lat, 0.0, 6377563.396, e2_of(299.3249646))), 6378137.0, e2_of(298.257223563))
    for wkt in forms:
        got = crs_from_wkt(wkt).to_wgs84(lon, lat)
        assert np.abs(got[0] - want[0]).max() < 1e-10 and np.abs(got[1] - want[1]).max() < 1e-10
        moved = inverse(lon, lat, *got)[0]
        assert ((moved > 80) & (moved < 200)).all()
        assert measured(line((1.7, 52.6), (1.71, 52.6)), wkt)[0] == "MEASURED"
    # the national grid on its own ellipsoid, to within the few metres of the published seven parameters
    grid = f'PROJCS["x",{forms[0]},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",49],PARAMETER["central_meridian",-2],PARAMETER["scale_factor",0.9996012717],PARAMETER["false_easting",400000],PARAMETER["false_northing",-100000],UNIT["metre",1]]'
    got = crs_from_wkt(grid).to_wgs84(np.array([651409.903]), np.array([313177.270]))
    assert float(inverse(*got, dms(1, 42, 57.8663), dms(52, 39, 28.8282))[0][0]) < 5


def test_shifts_that_cannot_be_applied_fail():
    plain = geographic("European_Datum_1950", 6378388, 297)
    shift = {"Xaxis_translation": -87, "Yaxis_translation": -98, "Zaxis_translation": -121}
    assert crs_from_wkt(bound(plain, "Geocentric translations (geog2D domain)", **shift)).shift == Shift(-87, -98, -121)
    assert crs_from_wkt(geographic("WGS_1984", 6378137, 298.257223563, "TOWGS84[0,0,0,0,0,0,0]")).shift is None
    assert crs_from_wkt(geographic("WGS_1984", 6378137, 298.257223563, "TOWGS84[500,300,100,0,0,0,0]")).shift == Shift(500, 300, 100)
    assert crs_from_wkt(geographic("Sphere", 6371000, 0, "TOWGS84[0,0,0]")).shift == Shift()
    other_target = bound(plain, "Geocentric translations (geog2D domain)", **shift).replace("World Geodetic System 1984", "World Geodetic System 1972")
    for wkt, code in [
        (plain, "CRS_TRANSFORMATION_FAILED"), (bound(plain, "NTv2", **shift), "CRS_TRANSFORMATION_FAILED"), (other_target, "CRS_TRANSFORMATION_FAILED"), (bound(plain, "Geocentric translations (geog2D domain)", **shift, Ordinate_1=4), "CRS_TRANSFORMATION_FAILED"),
        (geographic("European_Datum_1950", 6378388, 297, "TOWGS84[1,2]"), "INVALID_CRS"), (geographic("WGS_1984", 6378137, 298.257223563, 'EXTENSION["PROJ4_GRIDS","conus"]'), "CRS_TRANSFORMATION_FAILED"),
    ]:
        with pytest.raises(CrsError) as why:
            crs_from_wkt(wkt)
        assert why.value.code == code


def test_texts_that_redefine_or_turn_a_projection():
    web = projected("Mercator_1SP", central_meridian=0, scale_factor=1)[:-1] + ',EXTENSION["PROJ4","+proj=merc +a=6378137 +b=6378137 +lat_ts=0.0 +lon_0=0.0 +nadgrids=@null +wktext"]]'
    assert crs_from_wkt(web).method == "web_mercator"
    krovak = projected("Krovak", latitude_of_center=49.5, longitude_of_center=24.8333333, azimuth=30.2881397, pseudo_standard_parallel_1=78.5, scale_factor=0.9999)
    assert crs_from_wkt(krovak[:-1] + ',AXIS["X",SOUTH],AXIS["Y",WEST]]').method == "krovak"
    turned = krovak.replace('PARAMETER["azimuth"', 'PARAMETER["X_Scale",-1],PARAMETER["Y_Scale",1],PARAMETER["XY_Plane_Rotation",90],PARAMETER["azimuth"')
    assert crs_from_wkt(turned).method == "krovak_north"
    for wkt in (krovak, turned.replace('"X_Scale",-1', '"X_Scale",1'), projected("Krovak", latitude_of_center=49.5), projected("Cassini_Soldner", central_meridian=1)[:-1] + ',AXIS["W",WEST],AXIS["N",NORTH]]', projected("Polyconic", X_Scale=-1), projected("Mercator_1SP", central_meridian=0)[:-1] + ',EXTENSION["PROJ4","+proj=utm"]]'):
        with pytest.raises(CrsError) as why:
            crs_from_wkt(wkt)
        assert why.value.code == "CRS_TRANSFORMATION_UNAVAILABLE"


def test_crs_that_lack_or_hold_odd_parameters():
    for wkt in (projected("Albers", central_meridian=3), projected("Hotine_Oblique_Mercator", latitude_of_center=4), projected("Lambert_Conformal_Conic", central_meridian=3, standard_parallel_1=40, rotation=5)):
        with pytest.raises(CrsError) as why:
            crs_from_wkt(wkt)
        assert why.value.code == "CRS_TRANSFORMATION_UNAVAILABLE"
    assert crs_from_wkt(projected("Mercator_Auxiliary_Sphere", Auxiliary_Sphere_Type=0)).method == "web_mercator"
    assert measured(line((3, 50), (3, 51)), ETRS)[0] == "MEASURED"
    with pytest.raises(CrsError):
        crs_from_wkt(ETRS.replace("298.257222101", "298.3"))


def test_survey_feet_and_wkt2():
    foot = 0.304800609601219
    feet = UTM.replace('UNIT["metre",1]', f'UNIT["US survey foot",{foot}]').replace('"false_easting",500000', f'"false_easting",{500000 / foot}')
    assert measured(line((500000 / foot, 0), (500003 / foot, 4 / foot)), feet)[0] == "MEASURED"
    two = 'GEOGCRS["WGS 84",ENSEMBLE["World Geodetic System 1984 ensemble",MEMBER["World Geodetic System 1984 (G730)"],ELLIPSOID["WGS 84",6378137,298.257223563,LENGTHUNIT["metre",1]],ENSEMBLEACCURACY[2.0]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]],CS[ellipsoidal,2],AXIS["lat",north],AXIS["lon",east],ANGLEUNIT["degree",0.0174532925199433],ID["EPSG",4326]]'
    assert crs_from_wkt(two).authority == "EPSG:4326" and measured(line((0, 0), (0, 1)), two)[0] == "MEASURED"


@pytest.mark.parametrize(
    ("wkt", "code"),
    [
        ("nonsense", "INVALID_CRS"), ("", "INVALID_CRS"), (WGS84_WKT[:-1], "INVALID_CRS"), (WGS84_WKT.replace("WGS_1984", "North_American_Datum_1983"), "CRS_TRANSFORMATION_FAILED"),
        (f'COMPD_CS["x",{WGS84_WKT},VERT_CS["h"]]', "UNSUPPORTED_CRS"), (UTM.replace("Transverse_Mercator", "Krovak"), "CRS_TRANSFORMATION_UNAVAILABLE"),
        ('GEOGCRS["x",DYNAMIC[FRAMEEPOCH[2010]],DATUM["WGS_1984",ELLIPSOID["WGS 84",6378137,298.257223563]]]', "UNSUPPORTED_CRS"),
    ],
)
def test_crs_codes(wkt, code):
    with pytest.raises(CrsError) as why:
        crs_from_wkt(wkt)
    assert why.value.code == code
    assert measured(line((0, 0), (0, 1)), wkt)[2] == [code]


@pytest.mark.parametrize(
    ("geometry", "status", "code"),
    [
        (None, "ERROR", "MISSING_GEOMETRY"), ([], "ERROR", "INVALID_GEOMETRY"), ({"type": 3}, "ERROR", "INVALID_GEOMETRY"), ({"type": "Curve"}, "UNSUPPORTED", "UNSUPPORTED_GEOMETRY"),
        ({"type": "GeometryCollection"}, "UNSUPPORTED", "MIXED_GEOMETRY_COLLECTION"), ({"type": "Point", "coordinates": [181, 0]}, "ERROR", "INVALID_WGS84_COORDINATE"),
        ({"type": "Point", "coordinates": [1]}, "ERROR", "INVALID_COORDINATE"), ({"type": "Point", "coordinates": [1, True]}, "ERROR", "INVALID_COORDINATE"), ({"type": "Point", "coordinates": [1, 2, math.nan]}, "ERROR", "NON_FINITE_COORDINATE"),
        ({"type": "MultiPoint", "coordinates": []}, "ERROR", "EMPTY_GEOMETRY"), ({"type": "Polygon", "coordinates": []}, "ERROR", "EMPTY_GEOMETRY"), ({"type": "MultiPolygon", "coordinates": [[]]}, "ERROR", "EMPTY_GEOMETRY"),
        (line((0, 0), (0, 0)), "ERROR", "DEGENERATE_LINE"), (line((0, 0), (2, 0)), "UNSUPPORTED", "COMPONENT_EXTENT_EXCEEDED"), (polygon([[0, 0], [1, 0], [1, 1], [0, 1]]), "ERROR", "INVALID_RING"),
        (polygon([[0, 0], [1, 0], [0, 0], [0, 0]]), "ERROR", "INVALID_RING"), (polygon(closed((0, 0), (0.01, 0.01), (0.01, 0), (0, 0.01))), "ERROR", "INVALID_GEOMETRY"),
        (polygon(square(0, 0, 0.01, 0.01), square(0.02, 0.02, 0.03, 0.03)), "ERROR", "INVALID_GEOMETRY"), (multi(square(0, 0, 1, 1), square(0.5, 0, 1.5, 1)), "ERROR", "OVERLAPPING_MULTIPOLYGON_COMPONENTS"),
        (polygon(closed((0, 0), (120, 0), (-120, 0))), "ERROR", "UNSTABLE_COMPONENT_CENTER"),
    ],
)
def test_statuses(geometry, status, code):
    got = measured(geometry)
    assert (got[0], got[2]) == (status, [code]) and got[1] is None


def test_extent_on_the_limit_is_not_proven():
    lon, lat = direct(0, 0, np.pi / 2, 199_999.999)
    assert measured(line((0, 0), (float(lon), float(lat)))) == ("ERROR", None, ["EXTENT_UNVERIFIED"])


def test_points_have_no_measurement():
    for g in ({"type": "Point", "coordinates": [1, 2, 3]}, {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}):
        assert measured(g) == ("NOT_APPLICABLE", None, [])


def test_parts_add_up():
    one = measured(multi(square(0, 0, 0.01, 0.01)))[1]
    assert measured(multi(square(0, 0, 0.01, 0.01), square(100, 0, 100.01, 0.01)))[1] == pytest.approx(2 * one)
    assert measured(multi(square(0, 0, 0.01, 0.01), square(0.01, 0, 0.02, 0.01)))[0] == "MEASURED"  # touching is allowed
    shell, hole = square(77.5, 12.9, 77.6, 13.0), square(77.52, 12.92, 77.54, 12.94)
    assert measured(polygon(shell, hole))[1] == pytest.approx(measured(polygon(shell))[1] - measured(polygon(hole))[1], rel=1e-9)


def test_budgets():
    assert measured(line(*[(0.0001 * i, 0) for i in range(30)]), feature_coordinates=20)[2] == ["INPUT_COORDINATE_LIMIT"]
    assert measured(line((0, 0), (1, 0)), generated_feature_coordinates=100)[2] == ["GENERATED_COORDINATE_LIMIT"]
    assert measured(line((0, 0), (1, 0)), generated_work=500)[2] == ["CUMULATIVE_COORDINATE_LIMIT"]


def test_batches_equal_single_calls():
    mixed = [g for g, _ in AREAS + LENGTHS] + [None, line((0, 0), (2, 0)), polygon(closed((0, 0), (0.01, 0.01), (0.01, 0), (0, 0.01)))]
    assert measure_batch(mixed, [WGS84_WKT] * len(mixed)) == [measure_geometry(g, WGS84_WKT) for g in mixed]


coordinate = st.floats(-0.3, 0.3).map(lambda v: round(v, 6))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(coordinate, coordinate), min_size=2, max_size=8, unique=True), st.floats(-179, 179), st.floats(-80, 80))
def test_lines_reversed_and_moved_along_a_parallel(points, lon, lat):
    at = lambda dx: [(round(lon + x, 6), lat + y) for x, y in points] if not dx else [(round(lon + x, 6) + dx, lat + y) for x, y in points]
    wrap = lambda ps: [((x + 540) % 360 - 180, y) for x, y in ps]
    a, b, c = (measured(line(*p)) for p in (wrap(at(0)), wrap(at(0))[::-1], wrap(at(90))))
    assert a[0] == b[0] == c[0]
    if a[1] is not None:
        assert a[1] == pytest.approx(b[1], rel=1e-9, abs=1e-6) == pytest.approx(c[1], rel=1e-6, abs=1e-3)


@settings(max_examples=200, deadline=None)
@given(st.floats(-180, 180), st.floats(-89, 89), st.floats(0, 2 * math.pi), st.floats(1, 200_000))
def test_direct_and_inverse_agree(lon, lat, azimuth, distance):
    lon2, lat2 = direct(lon, lat, azimuth, distance)
    got, _ = inverse(lon, lat, lon2, lat2)
    assert abs(float(got) - distance) < 1e-5


def test_inverse_is_total():
    d, _ = inverse([0, 0, 0, 0], [0, 0, 90, 0], [180, 179.7, 0, 0], [0, 0.3, -90, 0])
    assert np.isfinite(d).all() and (d[:3] > 1.9e7).all() and d[3] == 0


def test_topology():
    ring = lambda *p: np.array(closed(*p), float)
    shell = ring((0, 0), (4, 0), (4, 4), (0, 4))
    assert topology.simple_ring(shell) and not topology.simple_ring(ring((0, 0), (4, 4), (4, 0), (0, 4)))
    assert not topology.simple_ring(ring((0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)))  # touches itself
    hole = ring((1, 1), (1, 2), (2, 2), (2, 1))
    assert topology.valid_polygon([shell, hole]) and topology.covers(shell, hole)
    assert topology.valid_polygon([shell, ring((0, 2), (1, 1), (1, 3))])  # one touching point
    assert not topology.valid_polygon([shell, ring((0, 0), (2, 2), (4, 4), (0, 4))])
    assert not topology.valid_polygon([shell, hole, ring((1.2, 1.2), (1.2, 1.4), (1.4, 1.4), (1.4, 1.2))])
    assert topology.interiors_overlap([shell], [hole]) and topology.interiors_overlap([shell], [shell])
    assert not topology.interiors_overlap([shell, hole], [hole])
    assert not topology.interiors_overlap([shell], [ring((4, 0), (8, 0), (8, 4), (4, 4))])
    assert topology.orient(*(np.array([v]) for v in (0.1, 0.1, 0.3, 0.3, 0.7, 0.7)))[0] == 0
    x, y = equal_area(np.array([0.0, 0.0]), np.array([90.0, 89.0]), 0.0, 90.0)
    assert abs(x[0]) + abs(y[0]) < 1e-6 and y[1] < 0


def batch_valid(polygons, spread):
    """``valid_batch`` of polygons whose edges are cut into ``spread`` pieces, and the cut rings."""
    segments, chain, ring, owner, cut = [], [], [], [], []
    for k, rings in enumerate(polygons):
        cut.append([])
        for r in rings:
            r = np.array(r, float)
            dense = [r[0]]
            for a, b in zip(r, r[1:], strict=False):
                dense += [a + (b - a) * i / spread for i in range(1, spread)] + [b]
                segments += list(zip(dense[-spread - 1 : -1], dense[-spread:], strict=True))
                chain += [chain[-1] + 1 if chain else 0] * spread
                ring += [sum(map(len, cut))] * spread
                owner += [k] * spread
            cut[-1].append(np.array(dense))
    flat = np.array([[*a, *b] for a, b in segments])
    return topology.valid_batch(flat, np.array(chain), np.array(ring), np.array(owner), len(polygons)), cut


grid = st.integers(0, 6)
rings = st.lists(st.tuples(grid, grid), min_size=3, max_size=6).map(lambda p: [*p, p[0]])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(rings, min_size=1, max_size=3), min_size=1, max_size=4), st.sampled_from([1, 2, 4]))
def test_batch_validity_is_that_of_single_polygons(polygons, spread):
    got, cut = batch_valid(polygons, spread)
    assert got.tolist() == [topology.valid_polygon(p) for p in cut]


def test_validity_is_judged_on_geodesic_edges():
    """At 60 degrees north an edge of 1.4 degrees bends by far more than these holes and parts reach."""
    lon, lat = 10.0, 60.0
    shell = closed((lon - 0.7, lat - 0.4), (lon + 0.7, lat - 0.4), (lon + 0.7, lat + 0.4), (lon - 0.7, lat + 0.4))
    d, azimuth = inverse(lon - 0.7, lat + 0.4, lon + 0.7, lat + 0.4)
    top_lon, top_lat = (float(v) for v in direct(lon - 0.7, lat + 0.4, azimuth, d / 2))
    north = lambda m: top_lat + m / 111_412.0
    assert measured(polygon(shell, closed((top_lon, north(-0.3)), (lon - 0.1, lat), (lon + 0.1, lat))))[0] == "MEASURED"
    assert measured(polygon(shell, closed((top_lon, north(0.3)), (lon - 0.1, lat), (lon + 0.1, lat))))[2] == ["INVALID_GEOMETRY"]
    wedge = lambda m: closed((top_lon, north(m)), (lon + 0.1, lat + 0.6), (lon - 0.1, lat + 0.6))
    assert measured(multi(shell, wedge(-0.4)))[2] == ["OVERLAPPING_MULTIPOLYGON_COMPONENTS"]
    assert measured(multi(shell, wedge(0.4)))[0] == "MEASURED"


def plain_extent(components, limits):
    """One segment after the other, the first half first."""
    budget = 0
    away = lambda c, p: float(inverse(*c, *p)[0])
    for c in components:
        for p in c.paths:
            for a, b in zip(p, p[1:], strict=False):
                todo = [(tuple(a), tuple(b), 0)]
                while todo:
                    start, end, depth = todo.pop()
                    d, azimuth = (float(v) for v in inverse(*start, *end))
                    reach = max(away(c.center, start), away(c.center, end))
                    if d > 2 * limits.radius_m or reach > limits.radius_m:
                        return "COMPONENT_EXTENT_EXCEEDED", budget
                    if reach + d / 2 <= limits.radius_m - 1e-6:
                        continue
                    if depth >= 18 or d <= 0.001 or budget >= limits.extent_subdivisions:
                        return "EXTENT_UNVERIFIED", budget
                    budget += 1
                    middle = tuple(float(v) for v in direct(*start, azimuth, d / 2))
                    if away(c.center, middle) > limits.radius_m:
                        return "COMPONENT_EXTENT_EXCEEDED", budget
                    todo += [(middle, end, depth + 1), (start, middle, depth + 1)]
    return None, budget


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.floats(-1.0, 1.0), st.floats(-1.0, 1.0)), min_size=2, max_size=5), min_size=1, max_size=3), st.sampled_from([100_000.0, 60_000.0, 111_000.0]), st.sampled_from([100_000, 40, 7, 0]))
def test_extents_in_batches_equal_single_steps(paths, radius, subdivisions):
    limits = Limits(radius_m=radius, extent_subdivisions=subdivisions)
    components = [measure._Component("LineString", [np.array(p)], measure.center_of(np.array(p))) for p in paths]
    why, halvings = measure.prove_extent(components, limits)
    code, plain = plain_extent(components, limits)
    assert (why.code if why else None) == code
    assert halvings == plain or code is None


def test_extents_of_many_halvings_take_seconds():
    at = [direct(20.0, 50.0, a, 99_999.9) for a in np.linspace(0, 2 * np.pi, 12_000, endpoint=False)]
    ring = np.array([[float(v) for v in p] for p in [*at, at[0]]])
    began = time.perf_counter()
    why, halvings = measure.prove_extent([measure._Component("Polygon", [ring], (20.0, 50.0))], Limits())
    assert halvings > 10_000 and (why is None or why.code == "EXTENT_UNVERIFIED")
    assert time.perf_counter() - began < 20


def _squares(n, half):
    ring = lambda x, y: [[x - half, y - half], [x + half, y - half], [x + half, y + half], [x - half, y + half], [x - half, y - half]]
    return [{"type": "Polygon", "coordinates": [ring(i % 90, i % 60)]} for i in range(n)]


def test_kernel_works_on_a_bounded_number_of_positions(monkeypatch):
    """Large squares become a thousand positions each: few of them are refined together, with the same results."""
    from terrameter.operators import measure

    seen, refine = [], measure._refine
    monkeypatch.setattr(measure, "_refine", lambda features, *rest: (seen.append(sum(measure._positions(f, rest[-1]) for f in features)), refine(features, *rest)))
    squares, wkts = _squares(200, 0.1), [WGS84_WKT] * 200
    whole = measure.measure_batch(squares, wkts)
    assert len(seen) > 1 and max(seen) < measure._CHUNK_POSITIONS + 2000
    monkeypatch.setattr(measure, "_CHUNK_POSITIONS", 1)
    assert measure.measure_batch(squares, wkts) == whole


def test_polygon_areas_take_a_bounded_number_of_positions(monkeypatch):
    import numpy as np
    import pandas as pd

    from terrameter import queries

    seen, areas = [], queries.ring_areas
    monkeypatch.setattr(queries, "ring_areas", lambda lon, lat, starts: (seen.append(len(lon)), areas(lon, lat, starts))[1])
    rings = [np.array(g["coordinates"][0]).ravel() for g in _squares(10_000, 0.1)]
    found = queries._polygon_areas(pd.Series(rings), pd.Series([np.array([5])] * len(rings)))
    assert len(seen) > 1 and max(seen) <= queries._AREA_POSITIONS + 5
    one = queries._polygon_areas(pd.Series(rings[7777:7778]), pd.Series([np.array([5])]))
    assert len(found) == 10_000 and abs(found[7777] / one[0] - 1) < 1e-12


def test_pairs_of_rings_are_judged_alike_alone_and_together():
    """Triangles and quadrangles on a small grid: equal, nested, touching, crossing and apart, with repeated vertices too."""
    import numpy as np

    rng = np.random.default_rng(5)
    box = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], float)
    squares = [[(box * rng.integers(1, 4) + rng.integers(0, 4, 2)) * 0.1 for _ in range(4000)] for _ in range(2)]
    skew = [[np.vstack([t, t[:1]]) for t in rng.integers(0, 4, (3000, 3, 2)) / 7.0] for _ in range(2)]
    for a, b in (squares, skew, (squares[0][:3000], skew[1])):
        want = [topology.interiors_overlap([x], [y]) if (np.diff(x, axis=0) != 0).any() and (np.diff(y, axis=0) != 0).any() else None for x, y in zip(a, b)]
        some = [k for k, w in enumerate(want) if w is not None]
        found = topology.rings_overlap(np.array([a[k] for k in some]), np.array([b[k] for k in some]))
        assert found.tolist() == [want[k] for k in some] and 0 < sum(found) < len(some)
    assert len(topology.rings_overlap(np.zeros((0, 5, 2)), np.zeros((0, 5, 2)))) == 0


def test_probes_stop_at_the_first_point_inside_both(monkeypatch):
    """Equal rings of 2000 edges: one block of points shows that they overlap."""
    import numpy as np

    steps = np.linspace(0, 1, 500, endpoint=False)
    sides = [np.column_stack([steps, 0 * steps]), np.column_stack([0 * steps + 1, steps]), np.column_stack([1 - steps, 0 * steps + 1]), np.column_stack([0 * steps, 1 - steps])]
    ring = np.vstack([*sides, [[0, 0]]])
    asked, inside = [], topology.inside
    monkeypatch.setattr(topology, "inside", lambda points, ring: (asked.append(len(points)), inside(points, ring))[1])
    assert topology.interiors_overlap([ring], [ring]) and sum(asked) <= 128


def test_features_of_one_crs_are_placed_at_once(monkeypatch):
    """One call brings the vertices of a batch to WGS84, and what one feature does wrong stays its own."""
    from terrameter.functions.crs import Crs
    from terrameter.operators import measure

    calls, plain = [], Crs.to_wgs84
    monkeypatch.setattr(Crs, "to_wgs84", lambda self, x, y: (calls.append(len(x)), plain(self, x, y))[1])
    lines = [{"type": "LineString", "coordinates": [[i / 10, 0.0], [i / 10 + 0.01, 0.0]]} for i in range(300)]
    lines[7] = {"type": "MultiLineString", "coordinates": [[[1.0, 1.0], [1.0, 1.01]], [[1.0, 91.0], [1.0, 1.0]]]}
    lines[8] = {"type": "LineString", "coordinates": [[1.0, 1.0], [None, 1.0]]}
    found = measure.measure_batch(lines, [WGS84_WKT] * 300)
    assert calls == [2 * 298 + 4]
    assert [(i, r["issues"][0]["code"]) for i, r in enumerate(found) if r["issues"]] == [(7, "INVALID_WGS84_COORDINATE"), (8, "INVALID_COORDINATE")]
    assert [measure.measure_batch([g], [WGS84_WKT])[0] for g in lines[:20]] == found[:20]


def test_single_holes_are_judged_together(monkeypatch):
    """Polygons with one hole are looked at in one table, with the verdicts they have alone."""
    import numpy as np

    square = lambda x, y, h: np.array([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)])
    polygons = [[square(0, 0, 1 + k), square((k % 3) * 4.0 * (1 + k), 0.1, 0.5)[::-1]] for k in range(40)] + [[square(0, 0, 1)], [square(0, 0, 4), square(-1, 0, 0.5), square(1, 0, 0.5)]]
    rings = [(k, r) for k, p in enumerate(polygons) for r in p]
    segments = np.vstack([np.hstack([r[:-1], r[1:]]) for _, r in rings])
    ring, owner = np.repeat(np.arange(len(rings)), 4), np.repeat([k for k, _ in rings], 4)
    alone, nested = [], topology._nested
    monkeypatch.setattr(topology, "_nested", lambda own: (alone.append(1), nested(own))[1])
    got = topology.valid_batch(segments, np.arange(len(segments)), ring, owner, len(polygons))
    assert got.tolist() == [topology.valid_polygon(p) for p in polygons] and sum(got) == 16 and len(alone) == 1
