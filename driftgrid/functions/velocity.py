"""Offsets to velocities as column expressions: calibration, errors, and the radar, crossing and optical solutions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 365.25
# The largest error in pixels, mask codes, and the empirical optical error in pixels.
MAX_SIGMA = 0.2
GROUNDED, SHELF, GROUNDING_ZONE, NO_SOLUTION = 0, 1, 2, 5
OPTICAL_SIGMA = 0.05


def calibrate_range(dr: Column, pixel: Column, slant: Column, theta_d: Column, bn: Column, bp: Column, const: Column) -> Column:
    """range offset in m without the baseline's part."""
    bent = F.sqrt(slant * slant - 2 * slant * (bn * F.sin(theta_d) + bp * F.cos(theta_d)) + bn * bn + bp * bp)
    return dr * pixel - (bent - slant + const)


def dem_error(bn: Column, slant: Column, theta: Column) -> Column:
    """error in m that 15 m of height leave."""
    return F.abs(bn) * 15.0 / (slant * F.sin(theta))


def calibrate_azimuth(da: Column, pixel: Column, left: Column, slant: Column, theta: Column, c1: Column, dbc: Column, dbh: Column, along: Column, sv_offset: Column | float = 0.0) -> Column:
    """azimuth offset in m without constants, baseline rates, the along-track part and, where state vectors are used, their offset."""
    zero = F.lit(sv_offset) + c1 + slant * F.sin(theta) * dbc - slant * F.cos(theta) * dbh
    return F.when(left, -da).otherwise(da) * pixel - zero - along


def _capped(sigma: Column) -> Column:
    return F.when((sigma > MAX_SIGMA) | (sigma < 0), MAX_SIGMA).otherwise(sigma)


def azimuth_sigma(sigma: Column, streaks: Column, pixel: Column) -> Column:
    """capped, with the noise of streaks added in quadrature, in m."""
    noise = F.greatest(streaks, F.lit(0.001))
    return F.sqrt(F.pow(_capped(sigma), 2) + noise * noise) * pixel


def range_sigma(sigma: Column, least: Column, pixel: Column) -> Column:
    """capped, and not below the pair's own, in m."""
    return F.greatest(least, _capped(sigma)) * pixel


def topo_phase(slant: Column, height: Column, radius: Column, orbit: Column, flat_orbit: Column, centre: Column, flat_centre: Column, bn: Column, bp: Column, two_k: Column) -> Column:
    """F16: phase of the topography without that of the flat earth.

    The look angle at the surface (radius + height from the orbit's radius) is taken from centre, that of the flat earth, with the fixed orbit radius, from flat_centre.
    """
    angle = lambda r, top: F.acos((slant * slant + top * top - r * r) / (2 * top * slant))
    theta_d, flat_d = angle(radius + height, orbit) - centre, angle(radius, flat_orbit) - flat_centre
    square = bn * bn + bp * bp
    bent = F.sqrt(slant * slant - 2 * slant * (bn * F.sin(theta_d) + bp * F.cos(theta_d)) + square) - slant
    flat = -bn * F.sin(flat_d) - bp * F.cos(flat_d) + square * 0.5 / slant
    return (bent - flat) * two_k


def phase_error(variance: Column, residual: Column) -> Column:
    """F16 (a): from the fit's variance and its residual, held to pi."""
    held = F.least(F.pi(), residual)
    return F.sqrt(variance + held * held)


def phase_error_dem(bn: Column, slant: Column, theta: Column, two_k: Column) -> Column:
    """F16 (b): a quarter of pi with what 30 m of height leave."""
    return F.sqrt(F.pow(F.pi() / 4, 2) + F.pow(F.abs(bn) * 30.0 / (slant * F.sin(theta)) * two_k, 2))


def tide_correction(code: Column, tide_rate: Column, psi: Column, days: Column) -> Column:
    """what to take from a range offset on floating ice."""
    return F.when(code == SHELF, -tide_rate * F.cos(psi) * days / YEAR).otherwise(0.0)


def tie_tide(code: Column, vz: Column, tide_difference: Column, days: Column) -> Column:
    """vertical velocity of a control point with the tide's on floating ice; a tide at or below -1000 is no data."""
    return vz + F.when((code == SHELF) & (tide_difference > -1000), tide_difference / days * YEAR).otherwise(0.0)


def tide_sigma(code: Column, sigma: Column, psi: Column) -> Column:
    """range error with that of the tide on floating ice."""
    return F.when(code == SHELF, F.sqrt(sigma * sigma + F.pow(0.1 * F.cos(psi), 2))).otherwise(sigma)


def radar_velocity(dr: Column, da: Column, psi: Column, days: Column, dzdr: Column, dzda: Column, code: Column) -> Column:
    """struct(vr, va) in m a year; slopes don't count on floating ice."""
    scale = YEAR / days
    ground = code != SHELF
    slope_r, slope_a = F.when(ground, dzdr).otherwise(0.0), F.when(ground, dzda).otherwise(0.0)
    va, cot = da * scale, 1 / F.tan(psi)
    return F.struct(((dr * scale / F.sin(psi) + va * cot * slope_a) / (1 - cot * slope_r)).alias("vr"), va.alias("va"))


def azimuth_error(sigma: Column, days: Column, phase_too: Column) -> Column:
    """error of the velocity along track; times the root of 2 where the phase round has used azimuth offsets of the cell already."""
    return sigma * YEAR / days * F.when(phase_too, 1.41421).otherwise(1.0)


def vertical_velocity(mode: str, vx: Column, vy: Column, dzdx: Column, dzdy: Column, dr: Column, psi: Column, days: Column) -> Column:
    """the vertical layer, by mode: default, horizontal, vertical, los or incidence."""
    scaled = dr * YEAR / days / F.sin(psi)
    return {
        "default": vx * dzdx + vy * dzdy,
        "horizontal": scaled,
        "vertical": scaled * F.sin(psi) / F.cos(psi),
        "los": scaled * F.sin(psi),
        "incidence": F.degrees(psi),
    }[mode]


def crossing_matrix(alpha: Column, beta: Column) -> Column:
    """A of two headings that differ by alpha, as struct(a00, a01, a10, a11); null where they differ too little."""
    inv = 1 / F.pow(F.sin(alpha), 2)
    both, ca = alpha + beta, F.cos(alpha)
    usable = (F.abs(alpha) >= 0.8) & (F.abs(alpha) <= 2 * F.pi() - 0.8)
    a = F.struct(
        (inv * (F.cos(beta) - ca * F.cos(both))).alias("a00"), (inv * (F.cos(both) - ca * F.cos(beta))).alias("a01"),
        (inv * (F.sin(beta) - F.sin(both) * ca)).alias("a10"), (inv * (F.sin(both) - F.sin(beta) * ca)).alias("a11"),
    )
    return F.when(usable, a)


def crossing_velocity(a: Column, dzdx: Column, dzdy: Column, psi_a: Column, psi_d: Column, pa: Column, pd: Column, ea: Column, ed: Column) -> Column:
    """struct(vx, vy, ex, ey, det), variances in ex and ey; null unless det(I - AB) is 0.25 or more."""
    b00, b01, b10, b11 = dzdx / F.tan(psi_a), dzdy / F.tan(psi_a), dzdx / F.tan(psi_d), dzdy / F.tan(psi_d)
    c00, c01 = 1 - (a["a00"] * b00 + a["a01"] * b10), -(a["a00"] * b01 + a["a01"] * b11)
    c10, c11 = -(a["a10"] * b00 + a["a11"] * b10), 1 - (a["a10"] * b01 + a["a11"] * b11)
    det = c00 * c11 - c01 * c10
    d00, d01 = (c11 * a["a00"] - c01 * a["a10"]) / det, (c11 * a["a01"] - c01 * a["a11"]) / det
    d10, d11 = (c00 * a["a10"] - c10 * a["a00"]) / det, (c00 * a["a11"] - c10 * a["a01"]) / det
    out = F.struct(
        (d00 * pa + d01 * pd).alias("vx"), (d10 * pa + d11 * pd).alias("vy"),
        (F.pow(d00 * ea, 2) + F.pow(d01 * ed, 2)).alias("ex"), (F.pow(d10 * ea, 2) + F.pow(d11 * ed, 2)).alias("ey"), det.alias("det"),
    )
    return F.when(det >= 0.25, out)


def optical_velocity(offset: Column, plane: Column, pixel: Column, days: Column, scale: Column) -> Column:
    """velocity of an offset in pixels without the fitted plane."""
    return (offset - plane) * pixel * YEAR / days * scale


def optical_variance(sigma: Column, tie_residual: Column, mean_sigma: Column, fit_variance: Column, pixel: Column, days: Column) -> Column:
    """variance of an optical velocity; tie_residual in m, sigmas in pixels, held to the largest error."""
    tie, mean = F.greatest(tie_residual, F.lit(0.0)) / pixel, F.greatest(mean_sigma, F.lit(0.0))
    general = F.greatest(tie * tie - mean * mean, F.lit(0.0)) + OPTICAL_SIGMA**2
    return F.least(general + sigma * sigma + fit_variance, F.lit(MAX_SIGMA**2)) * F.pow(pixel * YEAR / days, 2)


def motion_correction(offset: Column, kind: str, vr: Column, va: Column, vz: Column, psi: Column, days: Column, two_k: Column | float = 1.0, reversed_time: bool = False) -> Column:
    """a tie's range, azimuth or phase measure without its known motion; with time reversed the motion has the other sign."""
    years = days / YEAR * (-1 if reversed_time else 1)
    los = years * (vr * F.sin(psi) - vz * F.cos(psi))
    return offset - {"range": los, "azimuth": va * years, "phase": los * F.lit(two_k)}[kind]


def unflatten_phase(phase: Column, bn: Column, bp: Column, theta_d: Column, slant: Column, two_k: Column, ramp: Column | float = 0.0) -> Column:
    """phase with the flattening of the virtual baseline put back, and the ramp along track (azimuth_ramp) where one was taken out."""
    return phase + two_k * (-bn * F.sin(theta_d) - bp * F.cos(theta_d) + (bn * bn + bp * bp) / (2 * slant)) + F.lit(ramp)


def azimuth_ramp(x: Column, omega: Column, looks: Column, lines: Column) -> Column:
    """the ramp of omega at the normalised place x along an image of so many lines."""
    return -x * omega * looks * lines


def pixel_area(corners: list[Column]) -> Column:
    """area of the facet of four ECEF corners (structs of x, y, z), as two triangles."""
    def triangle(p: Column, q: Column, r: Column) -> Column:
        u, v = [q[c] - p[c] for c in "xyz"], [r[c] - p[c] for c in "xyz"]
        cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return 0.5 * F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])

    a, b, c, d = corners
    return triangle(a, b, c) + triangle(a, c, d)


def _dot(u: list, v: list):
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _minus(u: list, v: list) -> list:
    return [a - b for a, b in zip(u, v, strict=True)]


def _unit(u: list) -> list:
    n = np.sqrt(_dot(u, u))
    return [c / n for c in u]


def _cross(u: list, v: list) -> list:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _planes(*columns: pd.Series) -> pd.DataFrame:
    """plane_areas of a batch: x, y, z of the four corners, the satellite and its motion."""
    *points, satellite, motion = [[c.to_numpy(float) for c in columns[n : n + 3]] for n in range(0, 18, 3)]

    def projected(normal):
        flat = []
        for p in points:
            d = _dot(_minus(p, middle), normal)
            flat.append([a - d * n for a, n in zip(p, normal, strict=True)])
        halves = [_cross(_minus(flat[b], flat[0]), _minus(flat[c], flat[0])) for b, c in ((1, 2), (2, 3))]
        return sum(0.5 * np.sqrt(_dot(h, h)) for h in halves)

    def facing(b, c):
        n = _cross(_minus(points[b], points[0]), _minus(points[c], points[0]))
        return -_dot(n, look) / np.sqrt(_dot(n, n))

    with np.errstate(invalid="ignore", divide="ignore"):
        middle = [(a + b + c + d) * 0.25 for a, b, c, d in zip(*points, strict=True)]
        look = _unit(_minus(middle, satellite))
        across = _unit(_cross(_unit(motion), look))
        return pd.DataFrame({"ab": projected(across), "ag": projected(look), "shadow": np.minimum(facing(1, 2), facing(2, 3))})


def plane_areas(corners: list[Column], satellite: Column, motion: Column) -> Column:
    """struct(ab, ag, shadow) of a facet of four ECEF corners, seen from a satellite at a place with a velocity (structs of x, y, z).

    ag is the area projected onto the plane across the line of sight, ab onto that which holds line of sight and motion; shadow is the lesser of the cosines between
    the facet's two normals and the direction to the satellite. All three are made in numpy by the batch: take the struct once.
    """
    return F.pandas_udf(_planes, "ab double, ag double, shadow double")(*[p[c].cast("double") for p in (*corners, satellite, motion) for c in "xyz"])
