"""Projection and geometry as column expressions; angles in degrees for lat and lon, else radians; projected distances in km."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 as the map projection and the ellipsoid functions use it, and the scale constants at the standard latitudes.
RADIUS_KM, ECC2 = 6378.137, 0.0066943801
SCALE_ECC2 = 0.00669437999014
MAJOR_KM, MINOR_KM = 6378.137, 6356.7523142
M_OVER_T = {70: 1.9332279, 71: 1.9390299}


def _t(lat: Column, e: float) -> Column:
    """The isometric factor of a latitude in radians."""
    s = e * F.sin(lat)
    return F.tan(F.lit(0.25) * F.pi() - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))


def ll_to_xy(lat: Column, lon: Column, rot: float, std_lat: float) -> Column:
    """F1: polar stereographic struct(x, y) in km; within 0.005 degrees of a pole both are 0."""
    e = ECC2**0.5
    sn = F.when(lat < 0, -1.0).otherwise(1.0)
    a, o, std = F.radians(sn * lat), F.radians(sn * lon + rot), F.radians(F.lit(float(std_lat)))
    cm = F.cos(std) / F.sqrt(1 - ECC2 * F.sin(std) * F.sin(std))
    rho = RADIUS_KM * cm * _t(a, e) / _t(std, e)
    pole = sn * lat >= 89.995
    return F.struct(F.when(pole, 0.0).otherwise(rho * sn * F.sin(o)).alias("x"), F.when(pole, 0.0).otherwise(-rho * sn * F.cos(o)).alias("y"))


def xy_to_ll(x: Column, y: Column, south: bool, rot: float, std_lat: float) -> Column:
    """F2: struct(lat, lon) by the series inverse; lon in 0..360, the pole within 0.1 km of the origin."""
    e, e2, sn = ECC2**0.5, ECC2, -1.0 if south else 1.0
    std = F.radians(F.lit(float(std_lat)))
    rho = F.sqrt(x * x + y * y)
    cm = F.cos(std) / F.sqrt(1 - e2 * F.sin(std) * F.sin(std))
    chi = F.pi() / 2 - 2 * F.atan(rho * _t(std, e) / (RADIUS_KM * cm))
    series = [e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12, 7 * e2**2 / 48 + 29 * e2**3 / 240, 7 * e2**3 / 120]
    lat = reduce(lambda a, k: a + series[k] * F.sin(2 * (k + 1) * chi), range(3), chi)
    lon = sn * (F.degrees(F.atan2(sn * x, -sn * y)) - sn * rot)
    lon = F.when(lon < 0, lon + 360).when(lon > 360, lon - 360).otherwise(lon)
    pole = rho <= 0.1
    return F.struct(F.when(pole, sn * 90.0).otherwise(sn * F.degrees(lat)).alias("lat"), F.when(pole, 0.0).otherwise(lon).alias("lon"))


def ps_scale(lat: Column, std_lat: int) -> Column:
    """factor that corrects projected distances at a latitude."""
    e2, a = SCALE_ECC2, F.radians(F.abs(lat))
    m = F.cos(a) / F.sqrt(1 - e2 * F.sin(a) * F.sin(a))
    return m / (M_OVER_T[std_lat] * _t(a, e2**0.5))


def ps_scale_approx(lat: Column, std_lat: float) -> Column:
    """the approximate form (1 + sin|lat|) / (1 + sin of the standard latitude)."""
    return (1 + F.sin(F.radians(F.abs(lat)))) / (1 + F.sin(F.radians(F.lit(float(std_lat)))))


def cell_xy(i: Column, j: Column, origin_x: Column | float, origin_y: Column | float, dx: Column | float, dy: Column | float) -> Column:
    """struct(x, y) of a node."""
    return F.struct((F.lit(origin_x) + j * F.lit(dx)).alias("x"), (F.lit(origin_y) + i * F.lit(dy)).alias("y"))


def xy_cell(x: Column, y: Column, origin_x: Column | float, origin_y: Column | float, dx: Column | float, dy: Column | float, nearest: bool = False) -> Column:
    """struct(i, j), cut toward zero; nearest adds a half first."""
    half = 0.5 if nearest else 0.0
    return F.struct(((y - F.lit(origin_y)) / F.lit(dy) + half).cast("int").alias("i"), ((x - F.lit(origin_x)) / F.lit(dx) + half).cast("int").alias("j"))


def curvature_radius(lat: Column) -> Column:
    """east-west radius of curvature in km at a latitude in radians."""
    return MAJOR_KM**2 / F.sqrt(F.pow(MAJOR_KM * F.cos(lat), 2) + F.pow(MINOR_KM * F.sin(lat), 2))


def earth_radius(lat: Column) -> Column:
    """distance of the ellipsoid from the centre in km at a latitude in radians."""
    n = curvature_radius(lat)
    return F.sqrt(F.pow(n * F.cos(lat), 2) + F.pow((MINOR_KM / MAJOR_KM) ** 2 * n * F.sin(lat), 2))


def to_spherical(z: Column, lat: Column, radius_m: Column | float) -> Column:
    """an ellipsoid height in m as a height over a sphere."""
    return z + (earth_radius(F.radians(lat)) * 1000 - F.lit(radius_m))


def to_ellipsoid(z: Column, lat: Column, radius_m: Column | float) -> Column:
    """the inverse of to_spherical."""
    return z - (earth_radius(F.radians(lat)) * 1000 - F.lit(radius_m))


def ll_to_ecef(lat: Column, lon: Column, h: Column) -> Column:
    """struct(x, y, z) in km of a geodetic point, h in m."""
    a, o, n, up = F.radians(lat), F.radians(lon), curvature_radius(F.radians(lat)), h / 1000
    e2 = 1 - (MINOR_KM / MAJOR_KM) ** 2
    return F.struct(((n + up) * F.cos(a) * F.cos(o)).alias("x"), ((n + up) * F.cos(a) * F.sin(o)).alias("y"), ((n * (1 - e2) + up) * F.sin(a)).alias("z"))


def look_geometry(slant: Column, ground: Column, platform: Column) -> Column:
    """struct(theta, psi): look and incidence angle of a slant range between a ground radius and a platform radius."""
    theta = F.acos((slant * slant + platform * platform - ground * ground) / (2 * slant * platform))
    psi = F.acos((platform * platform - slant * slant - ground * ground) / (2 * slant * ground))
    return F.struct(theta.alias("theta"), psi.alias("psi"))


def slant_range(near: Column, pixel: Column, index: Column) -> Column:
    """range of a range pixel."""
    return near + pixel * index


def xy_angle(x: Column, y: Column, south: bool) -> Column:
    """F8: angle of grid x from north."""
    return F.atan2(-y, -x) + (F.pi() if south else F.lit(0.0))


def ground_angle(slant: Column, ground: Column, platform: Column) -> Column:
    """the angle at the Earth's centre between the platform and the place."""
    return F.acos(F.least((platform * platform + ground * ground - slant * slant) / (2 * platform * ground), F.lit(1.0)))


def heading(da: Column, ground_1: Column, ground_2: Column, left: Column) -> Column:
    """F8: heading of a scene at a place, of two points a little south and north of it (for a left look: north and south).

    da is the way along track from the first to the second in m, ground_1 and ground_2 their ground ranges in m.
    """
    across = ground_2 - ground_1
    return F.atan2(da, F.when(left, -across).otherwise(across))


def rotate_ra_to_xy(dr: Column, da: Column, xy: Column, heading: Column) -> Column:
    """struct(x, y) of a range, azimuth vector."""
    c, s = F.cos(heading - xy), F.sin(heading - xy)
    return F.struct((dr * c + da * s).alias("x"), (da * c - dr * s).alias("y"))


def rotate_xy_to_ra(dx: Column, dy: Column, xy: Column, heading: Column) -> Column:
    """struct(r, a) of a grid vector."""
    c, s = F.cos(heading - xy), F.sin(heading - xy)
    return F.struct((dx * c - dy * s).alias("r"), (dx * s + dy * c).alias("a"))


def errors_to_xy(er: Column, ea: Column, xy: Column, heading: Column) -> Column:
    """struct(x, y): variances of a grid vector from range and azimuth errors."""
    c2, s2 = F.pow(F.cos(heading - xy), 2), F.pow(F.sin(heading - xy), 2)
    return F.struct((er * er * c2 + ea * ea * s2).alias("x"), (er * er * s2 + ea * ea * c2).alias("y"))


def limit(slope: Column, most: float) -> Column:
    """a slope held between -most and most."""
    return F.greatest(F.least(slope, F.lit(most)), F.lit(-most))


def slope_limits(dzdx: Column, dzdy: Column, z: Column, most: float = 0.12, low_ground: bool = True) -> Column:
    """struct(dzdx, dzdy): clamped, and 0 where z is null or out of range or a slope is null, and where steep ground is low.

    The crossing solution clamps at 0.1 and has no rule for low ground.
    """
    steep = F.sqrt(dzdx * dzdx + dzdy * dzdy)
    flat = z.isNull() | (z <= -1000) | (z > 10000) | dzdx.isNull() | dzdy.isNull()
    if low_ground:
        flat = flat | ((steep > 0.05) & (z < 75)) | ((steep > 0.03) & (z < 50))
    return F.struct(F.when(flat, 0.0).otherwise(limit(dzdx, most)).alias("dzdx"), F.when(flat, 0.0).otherwise(limit(dzdy, most)).alias("dzdy"))


def baseline_poly(b0: Column, b1: Column, b2: Column, x: Column) -> Column:
    """quadratic baseline along track."""
    return b0 + b1 * x + b2 * x * x


def norm_azimuth(azimuth: Column, length: Column) -> Column:
    """azimuth as a share of the image length from its middle."""
    return (azimuth - 0.5 * length) / length


def quad_form(cov: Column, v: Column) -> Column:
    """v' C v, for C as a flat row-major array."""
    n = F.size(v)
    rows = F.transform(v, lambda a, i: a * F.aggregate(F.zip_with(F.slice(cov, i * n + 1, n), v, lambda c, b: c * b), F.lit(0.0), lambda s, x: s + x))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x)
