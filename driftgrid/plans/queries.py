"""The operators as queries over the driver tables, each with the SQL that says the same. Keys begin with the operator's number."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid.functions import dates, geo, image, velocity
from driftgrid.operators import calibrate, fit, geocode, grid, images, mosaic, sampling, terrain
from driftgrid.plans.fixtures import fixture, with_fixtures
from driftgrid.plans import velocity as plans
from driftgrid.plans.velocity import optical_mosaic, speckle_observations
from driftgrid.sources import byte_ranges, scenes, sinks, text
from driftgrid.stages import shared_folder

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"{with_fixtures(*uses)} {sql}" if uses else sql
        return f

    return add


def r6(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def scaled_round(name: str, digits: int) -> Column:
    """Round a double as the SQL does: the scaled number to the nearest whole one. Spark's own rounds the decimal digits, which differs near ties."""
    scale = 10.0**digits
    return (F.round(F.col(name) * scale) / scale).alias(name)


def rounded(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({v}, {digits}) AS {k}" for k, v in columns.items())


def per_row(name: str, source: str, keys: list[str], made: dict[str, tuple[Callable[[], Column], str]], digits: int = 6, where: str = "") -> None:
    """A query of formulas on the rows of an adapter: column (made when a session is there) and SQL side by side."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fixture(spark, sf_dir, source)
        df = (df.where(where) if where else df).select(*keys, *[c().alias(k) for k, (c, _) in made.items()])
        return df.select(*keys, *[scaled_round(k, digits) if t == "double" else F.col(k) for k, t in df.dtypes if k in made])

    query(name, f"SELECT {', '.join(keys)}, {rounded({k: s for k, (_, s) in made.items()}, digits)} FROM {source}" + (f" WHERE {where}" if where else ""), (source,))(run)


# ---- F: formulas ----
def t_sql(lat: str, e: str) -> str:
    return f"(tan(pi() / 4 - ({lat}) / 2) / pow((1 - {e} * sin({lat})) / (1 + {e} * sin({lat})), {e} / 2))"


ECC = repr(geo.ECC2**0.5)
CM70 = f"(cos(radians(70.0)) / sqrt(1 - {geo.ECC2} * sin(radians(70.0)) * sin(radians(70.0))))"
RHO = f"({geo.RADIUS_KM} * {CM70} * {t_sql('radians(lat)', ECC)} / {t_sql('radians(70.0)', ECC)})"
P = ["point_id"]
XY = lambda: geo.ll_to_xy(C("lat"), C("lon"), 45.0, 70.0)
per_row("F1_ll_to_xy", "points_fx", P, {"x": (lambda: XY()["x"], f"CASE WHEN lat >= 89.995 THEN 0 ELSE {RHO} * sin(radians(lon + 45)) END"), "y": (lambda: XY()["y"], f"CASE WHEN lat >= 89.995 THEN 0 ELSE -{RHO} * cos(radians(lon + 45)) END")}, 5)
BACK = lambda: geo.xy_to_ll(XY()["x"], XY()["y"], False, 45.0, 70.0)
per_row("F2_xy_to_ll", "points_fx", P, {"lat": (lambda: BACK()["lat"], "lat"), "lon": (lambda: F.pmod(BACK()["lon"], F.lit(360.0)), "lon")}, 4)
per_row("F3_ps_scale", "points_fx", P, {"exact": (lambda: geo.ps_scale(C("lat"), 70), f"(cos(radians(lat)) / sqrt(1 - {geo.SCALE_ECC2} * pow(sin(radians(lat)), 2))) / (1.9332279 * {t_sql('radians(lat)', repr(geo.SCALE_ECC2**0.5))})"), "approx": (lambda: geo.ps_scale_approx(C("lat"), 70.0), "(1 + sin(radians(lat))) / (1 + sin(radians(70.0)))")})
CELL = lambda: geo.xy_cell(C("lon"), C("lat"), 10.0, 60.0, 0.7, 0.3)
NEAR = lambda: geo.xy_cell(C("lon"), C("lat"), 10.0, 60.0, 0.7, 0.3, nearest=True)
per_row("F4_cells", "points_fx", P, {"i": (lambda: CELL()["i"], "CAST(trunc((lat - 60.0) / CAST(0.3 AS DOUBLE)) AS INT)"), "j": (lambda: CELL()["j"], "CAST(trunc((lon - 10.0) / CAST(0.7 AS DOUBLE)) AS INT)"), "nj": (lambda: NEAR()["j"], "CAST(trunc((lon - 10.0) / CAST(0.7 AS DOUBLE) + 0.5) AS INT)")})
N_SQL = f"({geo.MAJOR_KM} * {geo.MAJOR_KM} / sqrt(pow({geo.MAJOR_KM} * cos(radians(lat)), 2) + pow({geo.MINOR_KM} * sin(radians(lat)), 2)))"
ER_SQL = f"sqrt(pow({N_SQL} * cos(radians(lat)), 2) + pow(pow(CAST({geo.MINOR_KM} AS DOUBLE) / {geo.MAJOR_KM}, 2) * {N_SQL} * sin(radians(lat)), 2))"
per_row("F5_radii", "points_fx", P, {"curvature": (lambda: geo.curvature_radius(F.radians("lat")), N_SQL), "radius": (lambda: geo.earth_radius(F.radians("lat")), ER_SQL), "spherical": (lambda: geo.to_spherical(C("h"), C("lat"), 6.37e6), f"h + ({ER_SQL} * 1000 - 6370000)")}, 5)
ECEF = lambda: geo.ll_to_ecef(C("lat"), C("lon"), C("h"))
per_row("F6_ecef", "points_fx", P, {"x": (lambda: ECEF()["x"], f"({N_SQL} + h / 1000) * cos(radians(lat)) * cos(radians(lon))"), "y": (lambda: ECEF()["y"], f"({N_SQL} + h / 1000) * cos(radians(lat)) * sin(radians(lon))"), "z": (lambda: ECEF()["z"], f"({N_SQL} * (pow(CAST({geo.MINOR_KM} AS DOUBLE) / {geo.MAJOR_KM}, 2)) + h / 1000) * sin(radians(lat))")}, 5)
S = ["l_orderkey", "l_linenumber"]
LOOK = lambda: geo.look_geometry(C("slant"), F.lit(6371000.0) + C("z"), F.lit(7071000.0))
per_row("F7_look_geometry", "samples_fx", S, {"theta": (lambda: LOOK()["theta"], "acos((slant * slant + 7071000.0 * 7071000.0 - pow(6371000.0 + z, 2)) / (2 * slant * 7071000.0))"), "psi": (lambda: LOOK()["psi"], "acos((7071000.0 * 7071000.0 - slant * slant - pow(6371000.0 + z, 2)) / (2 * slant * (6371000.0 + z)))"), "range": (lambda: geo.slant_range(C("slant"), F.lit(2.3), C("l_linenumber")), "slant + CAST(2.3 AS DOUBLE) * l_linenumber")})
per_row("F8_xy_angle", "points_fx", P, {"north": (lambda: geo.xy_angle(C("lon") - 180, C("lat") - 70, False), "atan2(70 - lat, 180 - lon)"), "south": (lambda: geo.xy_angle(C("lon") - 180, C("lat") - 70, True), "atan2(70 - lat, 180 - lon) + pi()")})
ROT = lambda: geo.rotate_ra_to_xy(C("dr"), C("da"), C("xy"), C("heading"))
UNROT = lambda: geo.rotate_xy_to_ra(C("dr"), C("da"), C("xy"), C("heading"))
EXY = lambda: geo.errors_to_xy(C("sr"), C("sa"), C("xy"), C("heading"))
per_row("F9_rotations", "samples_fx", S, {"x": (lambda: ROT()["x"], "dr * cos(heading - xy) + da * sin(heading - xy)"), "y": (lambda: ROT()["y"], "da * cos(heading - xy) - dr * sin(heading - xy)"), "r": (lambda: UNROT()["r"], "dr * cos(heading - xy) - da * sin(heading - xy)"), "a": (lambda: UNROT()["a"], "dr * sin(heading - xy) + da * cos(heading - xy)"), "ex": (lambda: EXY()["x"], "pow(sr * cos(heading - xy), 2) + pow(sa * sin(heading - xy), 2)"), "ey": (lambda: EXY()["y"], "pow(sr * sin(heading - xy), 2) + pow(sa * cos(heading - xy), 2)")})
FLAT = "(sqrt(dzdr * dzdr + dzda * dzda) > 0.05 AND z / 100 < 75) OR (sqrt(dzdr * dzdr + dzda * dzda) > 0.03 AND z / 100 < 50)"
LIM = lambda: geo.slope_limits(C("dzdr"), C("dzda"), C("z") / 100)
per_row("F10_slope_limits", "samples_fx", S, {"dzdx": (lambda: LIM()["dzdx"], f"CASE WHEN {FLAT} THEN 0 ELSE greatest(least(dzdr, 0.12), -0.12) END"), "dzdy": (lambda: LIM()["dzdy"], f"CASE WHEN {FLAT} THEN 0 ELSE greatest(least(dzda, 0.12), -0.12) END")})
CROSS_LIM = lambda: geo.slope_limits(C("dzdr") * 2, C("dzda") * 2, F.when(C("code") == 5, -2000.0).otherwise(C("z")), 0.1, False)
per_row("F10_crossing_slopes", "samples_fx", S, {"dzdx": (lambda: CROSS_LIM()["dzdx"], "CASE WHEN code = 5 OR z > 10000 THEN 0 ELSE greatest(least(dzdr * 2, 0.1), -0.1) END"), "dzdy": (lambda: CROSS_LIM()["dzdy"], "CASE WHEN code = 5 OR z > 10000 THEN 0 ELSE greatest(least(dzda * 2, 0.1), -0.1) END")})
per_row("F8_heading", "samples_fx", S, {"right": (lambda: geo.heading(C("da"), C("dr"), C("dr") * 3 + 1, F.lit(False)), "atan2(da, dr * 2 + 1)"), "left": (lambda: geo.heading(C("da"), C("dr"), C("dr") * 3 + 1, F.lit(True)), "atan2(da, -dr * 2 - 1)"), "angle": (lambda: geo.ground_angle(C("slant"), F.lit(6371000.0) + C("z"), F.lit(7071000.0)), "acos((7071000.0 * 7071000.0 + pow(6371000.0 + z, 2) - slant * slant) / (2 * 7071000.0 * (6371000.0 + z)))")})
per_row("F11_baseline", "samples_fx", S, {"b": (lambda: geo.baseline_poly(C("bn"), C("bp"), C("sr"), C("x")), "bn + bp * x + sr * x * x"), "norm": (lambda: geo.norm_azimuth(C("slant"), F.lit(900000.0)), "(slant - 450000.0) / 900000.0")})
COV = lambda: F.array(C("sr"), F.lit(0.1), F.lit(0.1), C("theta"))
per_row("F12_quad_form", "samples_fx", S, {"q": (lambda: geo.quad_form(COV(), F.array(C("dr"), C("da"))), "dr * dr * sr + 2 * CAST(0.1 AS DOUBLE) * dr * da + da * da * theta")})
BENT = "sqrt(slant * slant - 2 * slant * (bn * sin(theta_d) + bp * cos(theta_d)) + bn * bn + bp * bp)"
per_row("F13_range_offset", "samples_fx", S, {"dr": (lambda: velocity.calibrate_range(C("dr"), F.lit(2.3), C("slant"), C("theta_d"), C("bn"), C("bp"), F.lit(0.75)), f"dr * CAST(2.3 AS DOUBLE) - ({BENT} - slant + 0.75)"), "dem": (lambda: velocity.dem_error(C("bn"), C("slant"), C("theta")), "abs(bn) * 15 / (slant * sin(theta))")}, 5)
per_row("F14_azimuth_offset", "samples_fx", S, {"da": (lambda: velocity.calibrate_azimuth(C("da"), F.lit(14.1), C("code") == 1, C("slant"), C("theta"), F.lit(0.5), F.lit(1e-6), F.lit(2e-6), C("x") * 0.1), "CASE WHEN code = 1 THEN -da ELSE da END * CAST(14.1 AS DOUBLE) - (0.5 + slant * sin(theta) * 1e-6 - slant * cos(theta) * 2e-6) - x * CAST(0.1 AS DOUBLE)")})
CAP = "CASE WHEN {0} > 0.2 OR {0} < 0 THEN 0.2 ELSE {0} END"
per_row("F14_azimuth_with_states", "samples_fx", S, {"da": (lambda: velocity.calibrate_azimuth(C("da"), F.lit(14.1), C("code") == 1, C("slant"), C("theta"), F.lit(0.5), F.lit(1e-6), F.lit(2e-6), C("x") * 0.1, C("bn") * 0.01), "CASE WHEN code = 1 THEN -da ELSE da END * CAST(14.1 AS DOUBLE) - (bn * 0.01 + 0.5 + slant * sin(theta) * 1e-6 - slant * cos(theta) * 2e-6) - x * CAST(0.1 AS DOUBLE)")})
per_row("F15_offset_sigma", "samples_fx", S, {"sa": (lambda: velocity.azimuth_sigma(C("sa"), C("theta_d"), F.lit(14.0)), f"sqrt(pow({CAP.format('sa')}, 2) + pow(greatest(theta_d, 0.001), 2)) * 14"), "sr": (lambda: velocity.range_sigma(C("sr") * 3, C("theta_d"), F.lit(2.0)), f"greatest(theta_d, {CAP.format('(sr * 3)')}) * 2")})
ANGLE_SQL = "acos((slant * slant + {o} * {o} - pow({r}, 2)) / (2 * {o} * slant))"
THETA_D = "(" + ANGLE_SQL.format(o="7071000.0", r="(6371000.0 + z)") + " - CAST(0.6 AS DOUBLE))"
FLAT_D = "(" + ANGLE_SQL.format(o="7070900.0", r="6371000.0") + " - CAST(0.61 AS DOUBLE))"
TOPO_SQL = f"220 * (sqrt(slant * slant - 2 * slant * (bn * sin({THETA_D}) + bp * cos({THETA_D})) + bn * bn + bp * bp) - slant + bn * sin({FLAT_D}) + bp * cos({FLAT_D}) - (bn * bn + bp * bp) * 0.5 / slant)"
TOPO = lambda: velocity.topo_phase(C("slant"), C("z"), F.lit(6371000.0), F.lit(7071000.0), F.lit(7070900.0), F.lit(0.6), F.lit(0.61), C("bn"), C("bp"), F.lit(220.0))
per_row("F16_phase", "samples_fx", S, {"phase": (TOPO, TOPO_SQL), "fit": (lambda: velocity.phase_error(C("sr"), C("theta") * 10), "sqrt(sr + pow(least(pi(), theta * 10), 2))"), "dem": (lambda: velocity.phase_error_dem(C("bn"), C("slant"), C("theta"), F.lit(220.0)), "sqrt(pow(pi() / 4, 2) + pow(abs(bn) * 30 / (slant * sin(theta)) * 220, 2))")}, 3)
per_row("F17_tides", "samples_fx", S, {"correction": (lambda: velocity.tide_correction(C("code"), C("da"), C("psi"), C("n_days")), "CASE WHEN code = 1 THEN -da * cos(psi) * n_days / 365.25 ELSE 0 END"), "sigma": (lambda: velocity.tide_sigma(C("code"), C("sr"), C("psi")), "CASE WHEN code = 1 THEN sqrt(sr * sr + pow(0.1 * cos(psi), 2)) ELSE sr END"), "tie_vz": (lambda: velocity.tie_tide(C("code"), C("dzdr"), F.when(C("theta") > 0.5, C("da")).otherwise(-2e9), C("n_days")), "dzdr + CASE WHEN code = 1 AND theta > 0.5 THEN da / n_days * 365.25 ELSE 0 END")})
per_row("F18_azimuth_error", "samples_fx", S, {"ea": (lambda: velocity.azimuth_error(C("sr"), C("n_days"), C("code") == 1), "sr * 365.25 / n_days * CASE WHEN code = 1 THEN 1.41421 ELSE 1 END")})
VEL = lambda: velocity.radar_velocity(C("dr"), C("da"), C("psi"), C("n_days"), C("dzdr") / 4, C("dzda") / 4, C("code"))
GROUND = "(CASE WHEN code <> 1 THEN 0.25 ELSE 0 END)"
MODES = lambda: {m: velocity.vertical_velocity(m, C("dr"), C("da"), C("dzdr"), C("dzda"), C("dr"), C("psi"), C("n_days")) for m in ("default", "horizontal", "vertical", "los", "incidence")}
per_row("F18_radar_velocity", "samples_fx", S, {"vr": (lambda: VEL()["vr"], f"(dr * 365.25 / n_days / sin(psi) + da * 365.25 / n_days / tan(psi) * dzda * {GROUND}) / (1 - dzdr * {GROUND} / tan(psi))"), "va": (lambda: VEL()["va"], "da * 365.25 / n_days"), "vz0": (lambda: MODES()["default"], "dr * dzdr + da * dzda"), "vz1": (lambda: MODES()["horizontal"], "dr * 365.25 / n_days / sin(psi)"), "vz2": (lambda: MODES()["vertical"], "dr * 365.25 / n_days / cos(psi)"), "vz3": (lambda: MODES()["los"], "dr * 365.25 / n_days"), "vz4": (lambda: MODES()["incidence"], "degrees(psi)")}, 7)


@query("F19_crossing_velocity", """, m AS (SELECT *, CASE WHEN abs(heading) >= 0.8 AND abs(heading) <= 2 * pi() - 0.8 THEN 1 END AS ok, 1 / pow(sin(heading), 2) AS k FROM samples_fx),
 a AS (SELECT *, k * (cos(xy) - cos(heading) * cos(heading + xy)) AS a00, k * (cos(heading + xy) - cos(heading) * cos(xy)) AS a01, k * (sin(xy) - sin(heading + xy) * cos(heading)) AS a10, k * (sin(heading + xy) - sin(xy) * cos(heading)) AS a11,
   dzdr / 4 / tan(psi) AS b00, dzda / 4 / tan(psi) AS b01, dzdr / 4 / tan(theta) AS b10, dzda / 4 / tan(theta) AS b11 FROM m WHERE ok = 1),
 c AS (SELECT *, 1 - (a00 * b00 + a01 * b10) AS c00, -(a00 * b01 + a01 * b11) AS c01, -(a10 * b00 + a11 * b10) AS c10, 1 - (a10 * b01 + a11 * b11) AS c11 FROM a),
 d AS (SELECT *, c00 * c11 - c01 * c10 AS det FROM c)
 SELECT l_orderkey, l_linenumber, round(((c11 * a00 - c01 * a10) * dr + (c11 * a01 - c01 * a11) * da) / det, 4) AS vx, round(((c00 * a10 - c10 * a00) * dr + (c00 * a11 - c10 * a01) * da) / det, 4) AS vy,
   round((pow((c11 * a00 - c01 * a10) * sr, 2) + pow((c11 * a01 - c01 * a11) * sa, 2)) / det / det, 4) AS ex, round(det, 4) AS det FROM d WHERE det >= 0.25""", ("samples_fx",))
def _crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, P7, P8."""
    df = fixture(spark, sf_dir, "samples_fx").withColumn("a", velocity.crossing_matrix(C("heading"), C("xy"))).where("a is not null")
    v = velocity.crossing_velocity(C("a"), C("dzdr") / 4, C("dzda") / 4, C("psi"), C("theta"), C("dr"), C("da"), C("sr"), C("sa"))
    return df.withColumn("v", v).where("v is not null").select(*S, *[r6(C(f"v.{n}"), n, 4) for n in ("vx", "vy", "ex", "det")])


per_row("F20_optical_velocity", "samples_fx", S, {"v": (lambda: velocity.optical_velocity(C("dr"), C("da"), F.lit(15.0), C("n_days"), F.lit(1.013721839)), "(dr - da) * 15 * 365.25 / n_days * CAST(1.013721839 AS DOUBLE)"), "var": (lambda: velocity.optical_variance(C("sr"), C("theta") * 2, C("sa"), C("sr") * 0.01, F.lit(15.0), C("n_days")), "least(greatest(pow(greatest(theta * 2, 0) / 15, 2) - pow(greatest(sa, 0), 2), 0) + CAST(0.05 AS DOUBLE) * 0.05 + sr * sr + sr * 0.01, CAST(0.2 AS DOUBLE) * 0.2) * pow(15 * 365.25 / n_days, 2)")})
JD = "(CAST(date_diff('day', DATE '1970-01-01', image_date) AS DOUBLE) + 2440588)"
per_row("F21_julian_days", "acquisitions_fx", ["image_id"], {"jd": (lambda: dates.julian_day(C("image_date")), JD), "image_jd": (lambda: dates.image_jd(C("image_date"), C("n_days") * 100), f"{JD} + n_days * 100 / 86400"), "start": (lambda: dates.window_jd(C("image_date")), f"{JD} - 0.5"), "back": (lambda: F.datediff(dates.jd_to_date(dates.julian_day(C("image_date")) - 0.25), C("image_date")), "CAST(0 AS INT)")})
W1, W2 = 2449900.5, 2449990.5
DW = """CASE WHEN abs(0.5 * (a + b + 1) - 0.5 * (2449900.5 + 2449990.5)) > 90 THEN 0 WHEN 90 / (b - a) < 0.49 OR 90 / (b - a) < 0.6 THEN 0
  WHEN a >= 2449900.5 AND b <= 2449990.5 THEN 1
  WHEN a >= 2449900.5 AND a <= 2449990.5 AND b >= 2449990.5 THEN (2449990.5 - a) / (b - a) * least(90 / (b - a), 1)
  WHEN a <= 2449900.5 AND b >= 2449900.5 AND b <= 2449990.5 THEN (b - 2449900.5) / (b - a) * least(90 / (b - a), 1)
  WHEN a <= 2449900.5 AND b >= 2449900.5 THEN 90 / (b - a) ELSE 0 END"""
ACQ = f", t AS (SELECT *, {JD} AS a, {JD} + n_days * 4 AS b FROM acquisitions_fx), w AS (SELECT image_id, {DW} AS weight FROM t)"


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "acquisitions_fx").withColumn("a", dates.julian_day(C("image_date")).cast("double"))
    return df.withColumn("weight", dates.date_weight(C("a"), C("a") + C("n_days") * 4, F.lit(W1), F.lit(W2)))


query("F22_date_weight", ACQ + " SELECT image_id, round(CAST(weight AS DOUBLE), 6) AS weight FROM w", ("acquisitions_fx",))(lambda s, d: _weighted(s, d).select("image_id", r6(C("weight"), "weight")))
query("P1_pairs_in_window", ACQ + " SELECT image_id FROM w WHERE weight > 0.99999 UNION ALL SELECT image_id + 1000000000 FROM w WHERE weight > 0.05 AND weight >= 0.5", ("acquisitions_fx",))(
    lambda s, d: _weighted(s, d).where("weight > 0.99999").select("image_id").unionByName(_weighted(s, d).where("weight > 0.05 and weight >= 0.5").select((C("image_id") + 1000000000).alias("image_id")))
)
POWER = lambda: [C("z") / 100000, F.when(C("code") == 1, "s1").when(C("code") == 2, "fine").when(C("code") == 5, "lband").otherwise("none"), 33 + C("dr") / 5, C("psi"), F.lit(220.0), F.lit(1.0)]
FINE = "pow(10.0, (" + " + ".join(f"({c}) * pow(CAST((33 + dr / 5 - 33.399360) / 1.880050 AS DOUBLE), {9 - k})" for k, c in enumerate(image.FINE_BEAM)) + ") / 10)"
LBAND = "pow(" + " + ".join(f"({c}) * pow(CAST(33 + dr / 5 - 34 AS DOUBLE), {4 - k})" for k, c in enumerate(image.L_BAND)) + ", 2)"
per_row("F23_sensor_calibration", "samples_fx", S, {"value": (lambda: image.sensor_calibration(*POWER()), f"CASE code WHEN 1 THEN z / 100000 * sin(psi) / 48400 WHEN 2 THEN z / 100000 / {FINE} WHEN 5 THEN z / 100000 / {LBAND} ELSE z / 100000 * pow(sin(psi), 3) END")}, 5)
DB = "(round(log10(CASE WHEN sr * 0.01 - 0.0005 < 0.001001 THEN CASE WHEN sr * 0.01 - 0.0005 > 1e-9 THEN 0.00102 ELSE 0.001 END ELSE sr * 0.01 - 0.0005 END) * 1000) / 100)"
SIG = lambda: image.to_db(C("sr") * 0.01 - 0.0005)
per_row("F24_decibels", "samples_fx", S, {"db": (lambda: SIG(), DB), "correction": (lambda: image.gamma_correction(C("theta"), C("sr"), C("psi")), "greatest(least(10 * log10(theta / sr / sin(psi)), 20), -29.9)")}, 5)
per_row("F25_byte_scale", "samples_fx", S, {"b": (lambda: image.byte_scale(C("sr"), 0.02, 0.08, 0.5), "CASE WHEN sr = 0 THEN 0 ELSE greatest(least(CAST(trunc(pow(greatest(least((sr - CAST(0.02 AS DOUBLE)) / (CAST(0.08 AS DOUBLE) - CAST(0.02 AS DOUBLE)), 1), 0), 0.5) * 255) AS INT), 255), 1) END")})
LOS = "n_days / 365.25 * (dr * sin(psi) - dzdr * cos(psi))"
per_row("F26_motion_correction", "samples_fx", S, {"range": (lambda: velocity.motion_correction(C("theta"), "range", C("dr"), C("da"), C("dzdr"), C("psi"), C("n_days")), f"theta - {LOS}"), "azimuth": (lambda: velocity.motion_correction(C("theta"), "azimuth", C("dr"), C("da"), C("dzdr"), C("psi"), C("n_days")), "theta - da * n_days / 365.25"), "phase": (lambda: velocity.motion_correction(C("theta"), "phase", C("dr"), C("da"), C("dzdr"), C("psi"), C("n_days"), 220.0), f"theta - 220 * {LOS}")})
per_row("F26_reversed_time", "samples_fx", S, {"range": (lambda: velocity.motion_correction(C("theta"), "range", C("dr"), C("da"), C("dzdr"), C("psi"), C("n_days"), reversed_time=True), f"theta + {LOS}")})
per_row("F27_unflatten", "samples_fx", S, {"phase": (lambda: velocity.unflatten_phase(C("dr"), C("bn"), C("bp"), C("theta_d"), C("slant"), F.lit(0.5), velocity.azimuth_ramp(C("x"), C("sr"), F.lit(4.0), F.lit(1000.0))), "dr + 0.5 * (-bn * sin(theta_d) - bp * cos(theta_d) + (bn * bn + bp * bp) / (2 * slant)) - x * sr * 4000")}, 4)
CORNER = lambda: [F.struct((C("theta") * a).alias("x"), (C("psi") * b).alias("y"), (C("dr") * a * b).alias("z")) for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
per_row("F28_pixel_area", "samples_fx", S, {"area": (lambda: velocity.pixel_area(CORNER()), "0.5 * sqrt(pow(dr * psi, 2) * 0 + pow(theta * dr, 2) + pow(theta * psi, 2)) + 0.5 * sqrt(pow(psi * dr, 2) + pow(theta * psi, 2))")}, 5)
# a rectangle 2p by 2q on the ground, seen from (0, -h tan(psi), h) by a satellite that moves along x: gamma sees q cos(psi), beta sees q sin(psi)
FACET = lambda: [F.struct((a * C("theta")).alias("x"), (b * C("psi")).alias("y"), F.lit(0.0).alias("z")) for a, b in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))]
PLANES = lambda: velocity.plane_areas(FACET(), F.struct(F.lit(0.0).alias("x"), (-1000.0 * F.tan("psi")).alias("y"), F.lit(1000.0).alias("z")), F.struct(F.lit(7500.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
per_row("F28_plane_areas", "samples_fx", S, {"ab": (lambda: PLANES()["ab"], "4 * theta * psi * sin(psi)"), "ag": (lambda: PLANES()["ag"], "4 * theta * psi * cos(psi)"), "shadow": (lambda: PLANES()["shadow"], "cos(psi)")}, 5)
QUERIES["F28_plane_areas"] = lambda s, d: fixture(s, d, "samples_fx").select(*S, PLANES().alias("p")).select(*S, "p.*").select(*S, *[scaled_round(c, 5) for c in ("ab", "ag", "shadow")])
TIME = lambda: dates.multilook_start(C("slant") / 10, C("dr") * 100, F.lit(500.0), F.lit(9.0))
SEC = "(slant / 10 + dr * 100 + CAST(0.5 AS DOUBLE) * 8 / 500)"
per_row("F29_times", "samples_fx", S, {"day_shift": (lambda: TIME()["day_shift"], f"CAST(floor({SEC} / 86400) AS INT)"), "second": (lambda: TIME()["second"], f"{SEC} - floor({SEC} / 86400) * 86400")}, 4)
ONE = lambda: {"a_x": C("slant") * 8, "a_y": F.lit(0.0), "a_z": F.lit(0.0), "a_vx": F.lit(0.0), "a_vy": F.lit(0.0), "a_vz": F.lit(7500.0), "b_x": C("slant") * 8 + C("bn"), "b_y": C("bp"), "b_z": C("dr")}


@query("F30_state_vector_baseline", "SELECT l_orderkey, l_linenumber, round(bp * cos(theta) - bn * sin(theta), 5) AS bn, round(-bn * cos(theta) - bp * sin(theta), 5) AS bp FROM samples_fx", ("samples_fx",))
def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "samples_fx").withColumn("th", C("theta")).withColumn("pb", C("bp"))
    df = df.withColumns({k: v for k, v in ONE().items()})
    side = geocode.state_vector_baseline("a_", "b_", C("th"))
    return df.withColumn("s", side).select(*S, r6(C("s.bn"), "bn", 5), r6(C("s.bp"), "bp", 5))


# ---- J, P, U: joins, predicates, sets ----
def fx(*names: str):
    return lambda s, d: [fixture(s, d, n) for n in names]


def on(name: str, uses: tuple[str, ...], sql: str | None):
    """A query whose function takes the named adapters."""
    def add(f):
        query(name, sql, uses)(lambda s, d: f(*fx(*uses)(s, d)))
        return f

    return add


PAIR_COLUMNS = "pair_id, i, j"
BOX_ROWS = 60

on("J1_cells_for_pairs", ("pairs_fx",), "SELECT pair_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM pairs_fx, range(-10, 2000) a(i), range(0, 20) b(j) WHERE i >= i_min AND i < i_max AND j >= j_min AND j < j_max")(
    lambda p: grid.cells_for_pairs(p).select("pair_id", "i", "j")
)
on("P2_overlaps_grid", ("pairs_fx",), f"SELECT pair_id, CAST(greatest(i_min - 2, 0) AS INT) AS i_min, CAST(least(i_max + 2, {BOX_ROWS}) AS INT) AS i_max, CAST(greatest(j_min - 2, 0) AS INT) AS j_min, CAST(least(j_max + 2, 20) AS INT) AS j_max FROM pairs_fx WHERE greatest(i_min - 2, 0) < least(i_max + 2, {BOX_ROWS}) AND greatest(j_min - 2, 0) < least(j_max + 2, 20)")(
    lambda p: grid.overlaps_grid(p, BOX_ROWS, 20, 2).select("pair_id", "i_min", "i_max", "j_min", "j_max")
)
INNER = ", ".join(f"{'greatest' if n.endswith('min') else 'least'}(a.{n}, b.{n}) AS {n}" for n in ("i_min", "i_max", "j_min", "j_max"))
CROSS = f"SELECT a.pair_id AS a_pair_id, b.pair_id AS b_pair_id, sqrt(a.weight * b.weight) AS weight, {INNER} FROM pairs_fx a JOIN pairs_fx b ON a.pair_id < b.pair_id AND abs(a.jd1 - b.jd1) <= 12 AND a.cross_flag = 1 AND b.cross_flag = 1 AND a.pass_type <> b.pass_type AND greatest(a.i_min, b.i_min) < least(a.i_max, b.i_max) AND greatest(a.j_min, b.j_min) < least(a.j_max, b.j_max)"
on("J2_crossing_pairs", ("pairs_fx",), CROSS)(grid.crossing_pairs)
on("J2_crossing_pairs_phase", ("pairs_fx",), CROSS.replace("<= 12", "<= 548"))(lambda p: grid.crossing_pairs(p, 548.0, tile=16))
on("P6_crossing_any_pass", ("pairs_fx",), CROSS.replace(" AND a.pass_type <> b.pass_type", "").replace("<= 12", "<= 548"))(lambda p: grid.crossing_pairs(p, 548.0, any_pass=True))
AT = "SELECT point_id, CAST(point_id * 13 % 1900 AS DOUBLE) / 100 AS u, CAST(point_id * 7 % 5200 AS DOUBLE) / 100 AS v FROM points_fx"
HOLED = "(SELECT * FROM cells_fx WHERE code <> 5)"


def corner_sql(z: str, shift: float = 0.0) -> str:
    return f""", p AS (SELECT point_id, u + {shift} AS u, v + {shift} AS v, CAST(floor(u + {shift}) AS INT) AS j0, CAST(floor(v + {shift}) AS INT) AS i0 FROM ({AT})),
 k AS (SELECT p.*, di, dj, (CASE WHEN dj = 1 THEN u - j0 ELSE 1 - (u - j0) END) * (CASE WHEN di = 1 THEN v - i0 ELSE 1 - (v - i0) END) AS w FROM p, range(0, 2) a(di), range(0, 2) b(dj)),
 c AS (SELECT k.*, {z} AS z FROM k LEFT JOIN {HOLED} g ON g.i = k.i0 + di AND g.j = k.j0 + dj WHERE w > 0)"""


def _at(points: DataFrame) -> DataFrame:
    return points.select("point_id", ((C("point_id") * 13 % 1900).cast("double") / 100).alias("u"), ((C("point_id") * 7 % 5200).cast("double") / 100).alias("v"))


def _bilinear(policy: str, **more):
    return lambda p, c: sampling.sample_bilinear(_at(p), c.where("code <> 5"), ["point_id"], ["z"], policy=policy, **more).select("point_id", r6(C("z"), "z"))


for policy, value, tail in (
    ("strict", "CASE WHEN count(z) = count(*) THEN sum(w * z) END", ""), ("interior", "CASE WHEN count(z) = count(*) THEN sum(w * z) END", " WHERE u <= 18 AND v <= 48"),
    ("max", "CASE WHEN count(z) = count(*) THEN sum(w * z) ELSE max(z) END", ""), ("zero", "coalesce(sum(w * z), 0)", ""),
):
    on(f"J3_bilinear_{policy}", ("points_fx", "cells_fx"), corner_sql("g.z") + f" SELECT point_id, round(CAST({value} AS DOUBLE), 6) AS z FROM c{tail} GROUP BY point_id")(_bilinear(policy, **({"rows": 50, "columns": 20} if policy == "interior" else {})))
on("J3_bilinear_shifted", ("points_fx", "cells_fx"), corner_sql("g.z", 0.5) + " SELECT point_id, round(CAST(CASE WHEN count(z) = count(*) THEN sum(w * z) END AS DOUBLE), 6) AS z FROM c GROUP BY point_id")(_bilinear("strict", shift=0.5))
on("J4_nearest", ("points_fx", "cells_fx"), f", p AS ({AT}) SELECT point_id, coalesce(code, 0) AS code FROM p LEFT JOIN cells_fx c ON c.i = CAST(floor(v + 0.5) AS INT) AND c.j = CAST(floor(u + 0.5) AS INT)")(
    lambda p, c: sampling.sample_nearest(_at(p), c, "code").select("point_id", "code")
)
on("J5_attach_layers", ("obs_fx", "cells_fx"), "SELECT pair_id, o.i, o.j, z, code FROM obs_fx o LEFT JOIN (SELECT i, j, z FROM cells_fx WHERE code <> 5) d ON d.i = o.i AND d.j = o.j LEFT JOIN (SELECT i, j, code FROM cells_fx) m ON m.i = o.i AND m.j = o.j")(
    lambda o, c: sampling.attach_layers(o.select("pair_id", "i", "j"), z=c.where("code <> 5").select("i", "j", "z"), code=c.select("i", "j", "code")).select("pair_id", "i", "j", "z", "code")
)
on("J6_attach_params", ("pairs_fx", "ties_fx", "obs_fx"), "SELECT pair_id, n_ties, n_obs FROM pairs_fx JOIN (SELECT pair_id, count(*) AS n_ties FROM ties_fx GROUP BY 1) USING (pair_id) LEFT JOIN (SELECT pair_id, count(*) AS n_obs FROM obs_fx GROUP BY 1) USING (pair_id)")(
    lambda p, t, o: sampling.attach_params(p, "pair_id", [t.groupBy("pair_id").agg(F.count("*").alias("n_ties"))], [o.groupBy("pair_id").agg(F.count("*").alias("n_obs"))]).select("pair_id", "n_ties", "n_obs")
)
TRI = """SELECT pair_id AS set_id, pair_id AS tri_id, CAST(j_min AS DOUBLE) + 0.25 AS x1, CAST(i_min AS DOUBLE) + 0.25 AS y1, CAST(pair_id % 7 AS DOUBLE) AS vx1, CAST(1 AS DOUBLE) AS vy1,
 CAST(j_max AS DOUBLE) AS x2, CAST(i_min AS DOUBLE) + 0.5 AS y2, CAST(pair_id % 5 AS DOUBLE) AS vx2, CAST(2 AS DOUBLE) AS vy2,
 CAST(j_min AS DOUBLE) + CAST(pair_id % 9 AS DOUBLE) AS x3, CAST(i_max AS DOUBLE) AS y3, CAST(pair_id % 3 AS DOUBLE) AS vx3, CAST(pair_id % 4 AS DOUBLE) AS vy3 FROM pairs_fx"""
SIDE = "(x{b} - x{a}) * (i - y{a}) - (j - x{a}) * (y{b} - y{a})"
s12, s23, s31 = (SIDE.format(a=a, b=b) for a, b in ((1, 2), (2, 3), (3, 1)))
query("J7_point_in_triangle", f""", t AS ({TRI}), c AS (SELECT *, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS twice FROM t, range(-5, 2010) a(i), range(0, 21) b(j)
 WHERE i >= least(y1, y2, y3) AND i <= greatest(y1, y2, y3) AND j >= least(x1, x2, x3) AND j <= greatest(x1, x2, x3))
 SELECT set_id, tri_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round((({s23}) * vx1 + ({s31}) * vx2 + ({s12}) * vx3) / twice, 5) AS vx, round((({s23}) * vy1 + ({s31}) * vy2 + ({s12}) * vy3) / twice, 5) AS vy
 FROM c WHERE ({s12}) / twice >= 0 AND ({s23}) / twice >= 0 AND ({s31}) / twice >= 0
 AND greatest(sqrt(pow(x1 - x2, 2) + pow(y1 - y2, 2)), sqrt(pow(x2 - x3, 2) + pow(y2 - y3, 2)), sqrt(pow(x3 - x1, 2) + pow(y3 - y1, 2))) < 14 AND abs(twice) / 2 <= 60""", ("pairs_fx",))(
    lambda s, d: grid.point_in_triangle(s.sql(TRI.replace("pairs_fx", "{p}"), p=fixture(s, d, "pairs_fx")), 14.0, 60.0).select("set_id", "tri_id", "i", "j", r6(C("vx"), "vx", 5), r6(C("vy"), "vy", 5))
)
USED = " FROM pairs_fx WHERE pair_id {} (SELECT pair_id FROM obs_fx WHERE vx > 104)"
on("J9_pairs_used", ("pairs_fx", "obs_fx"), "SELECT pair_id, n_days" + USED.format("IN"))(lambda p, o: mosaic.pairs_used(p, o.where("vx > 104")).select("pair_id", "n_days"))
on("J9_pairs_dropped", ("pairs_fx", "obs_fx"), "SELECT pair_id, n_days" + USED.format("NOT IN"))(lambda p, o: mosaic.pairs_dropped(p, o.where("vx > 104")).select("pair_id", "n_days"))
on("J10_antenna_gain", ("samples_fx", "cells_fx"), ", g AS (SELECT CAST(i AS INT) AS n, z AS gain FROM cells_fx WHERE j = 3 AND i < 50) SELECT l_orderkey, l_linenumber, gain FROM samples_fx LEFT JOIN g ON n = greatest(0, least(49, CAST(trunc((slant - 850500) / 120) AS INT)))")(
    lambda s, c: sampling.antenna_gain(s.withColumn("range", C("slant")), c.where("j = 3 and i < 50").select(C("i").alias("n"), C("z").alias("gain")), 850500.0, 120.0, 50).select(*S, "gain")
)
ORBIT = "SELECT pair_id AS scene_id, CAST(n AS INT) AS n, CAST(n * 10 AS DOUBLE) AS t, {f} FROM pairs_fx, range(0, 12) r(n)"
STATE_SQL = {"x": "7000000 + 5.0 * n * n", "y": "pair_id * 10.0 * n", "z": "75000.0 * n - n * n * n", "vx": "10.0 * n", "vy": "CAST(pair_id AS DOUBLE)", "vz": "7500 - 0.3 * n * n"}


@query("J8b_states_at", ", q AS (SELECT pair_id AS scene_id, k AS time_id, (k * 11.317 + pair_id % 7) / 10 AS n, pair_id FROM pairs_fx, range(0, 9) r(k)) SELECT scene_id, time_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), 3) AS {k}" for k, v in STATE_SQL.items()) + " FROM q", ("pairs_fx",))
def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that are cubic in time, so five vectors give them exactly."""
    pairs = fixture(spark, sf_dir, "pairs_fx")
    vectors = pairs.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(11)))).select(C("pair_id").alias("scene_id"), "n", (C("n") * 10.0).alias("t"), *[F.expr(v).cast("double").alias(k) for k, v in STATE_SQL.items()])
    times = pairs.withColumn("time_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")))).select(C("pair_id").alias("scene_id"), "time_id", (C("time_id") * 11.317 + C("pair_id") % 7).alias("t"))
    return geocode.states_at(times, vectors).select("scene_id", "time_id", *[r6(C(c), c, 3) for c in STATE_SQL])


on("J12_sample_ties", ("pairs_fx", "cells_fx"), """, h AS (SELECT pair_id, 4 AS r0, 6 AS a0, CAST(3 AS DOUBLE) AS dr, CAST(5 AS DOUBLE) AS da FROM pairs_fx), t AS (SELECT pair_id, k, (k * 6 + 4 + pair_id % 3 - 4) / 3.0 AS u, (k * 10 + 6 + pair_id % 5 - 6) / 5.0 AS v FROM pairs_fx, range(0, 5) r(k)),
 c AS (SELECT t.*, CAST(floor(u) AS INT) + dj AS j, CAST(floor(v) AS INT) + di AS i, (CASE WHEN dj = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN di = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM t, range(0, 2) a(di), range(0, 2) b(dj))
 SELECT pair_id, k AS tie_id, round(sum(w * (pair_id % 10 + i * 2 + j * j)), 6) AS off FROM c WHERE w > 1e-12 GROUP BY 1, 2""")(
    lambda p, c: sampling.sample_ties(
        p.withColumn("tie_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).select("pair_id", "tie_id", (C("tie_id") * 6 + 4 + C("pair_id") % 3).alias("r"), (C("tie_id") * 10 + 6 + C("pair_id") % 5).alias("a")),
        p.select("pair_id", F.lit(4).alias("r0"), F.lit(6).alias("a0"), F.lit(3.0).alias("delta_r"), F.lit(5.0).alias("delta_a")),
        p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(12)))).select("pair_id", "i", "j", (C("pair_id") % 10 + C("i") * 2 + C("j") * C("j")).cast("double").alias("off")), ["off"],
    ).select("pair_id", "tie_id", r6(C("off"), "off"))
)
per_row("P3_valid_sample", "samples_fx", S, {"dr": (lambda: C("dr"), "dr")}, where="abs(dr) < 13e4 and abs(da) < 10e4 and z > -1000 and z <= 10000")
QUERIES["P3_valid_sample"] = lambda s, d: mosaic.valid_sample(fixture(s, d, "samples_fx")).select(*S, r6(C("dr"), "dr"))
on("P4_mask_policy", ("cells_fx",), "SELECT i, j, 'tides' AS mode FROM cells_fx WHERE code NOT IN (5, 2) UNION ALL SELECT i, j, 'none' FROM cells_fx WHERE code = 0")(lambda c: mosaic.mask_policy(c).select("i", "j", F.lit("tides").alias("mode")).unionByName(mosaic.mask_policy(c, False).select("i", "j", F.lit("none").alias("mode"))))
REF = "SELECT i, j, avg(vx) AS rx, avg(vy) AS ry FROM obs_fx WHERE pair_id % 3 = 0 GROUP BY 1, 2"
on("P5_clip_to_reference", ("obs_fx",), f", r AS ({REF}) SELECT pair_id, o.i, o.j FROM obs_fx o LEFT JOIN r ON r.i = o.i AND r.j = o.j WHERE NOT coalesce(sqrt(pow(vx - rx, 2) + pow(vy - ry, 2)) > 20 AND (sqrt(rx * rx + ry * ry) < 100 OR sqrt(vx * vx + vy * vy) < 100), false)")(
    lambda o: mosaic.clip_to_reference(o, o.where("pair_id % 3 = 0").groupBy("i", "j").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy")), 20.0).select("pair_id", "i", "j")
)
per_row("P13_trim_pad", "cells_fx", ["i", "j"], {"value": (lambda: C("z"), "CASE WHEN j < 3 OR j >= 17 THEN 0 ELSE z END")})
QUERIES["P13_trim_pad"] = lambda s, d: images.trim_pad(fixture(s, d, "cells_fx").select("i", "j", C("j").alias("r"), C("z").alias("value")), 3, 20).select("i", "j", r6(C("value"), "value"))
on("P14_ties_in_bbox", ("points_fx",), "SELECT point_id FROM points_fx WHERE lon BETWEEN 20 AND 80 AND lat BETWEEN 65 AND 75")(lambda p: mosaic.ties_in_bbox(p.select("point_id", C("lon").alias("x"), C("lat").alias("y")), (20.0, 80.0, 65.0, 75.0)).select("point_id"))
on("U1_all_pairs", ("pairs_fx",), "SELECT pair_id, pass_type FROM pairs_fx")(lambda p: mosaic.all_pairs(p.where("pass_type = 0"), p.where("pass_type = 1")).select("pair_id", "pass_type"))
on("U2_families", ("obs_fx",), "SELECT pair_id, i, j, 'optical' AS family FROM obs_fx WHERE vx > 0 UNION ALL SELECT pair_id, i, j, 'speckle' FROM obs_fx WHERE vy > 0")(lambda o: mosaic.observations(optical=o.where("vx > 0").select("pair_id", "i", "j"), speckle=o.where("vy > 0").select("pair_id", "i", "j")))
on("U4_footprint_intersection", ("pairs_fx",), f"SELECT a.pair_id, {INNER} FROM pairs_fx a JOIN pairs_fx b ON b.pair_id = a.pair_id + 1 WHERE greatest(a.i_min, b.i_min) < least(a.i_max, b.i_max) AND greatest(a.j_min, b.j_min) < least(a.j_max, b.j_max)")(
    lambda p: p.select(*[C(n).alias(f"a_{n}") for n in p.columns]).join(p.select(*[C(n).alias(f"b_{n}") for n in p.columns]), C("b_pair_id") == C("a_pair_id") + 1).where(grid.boxes_intersect("a_", "b_")).select(C("a_pair_id").alias("pair_id"), *grid.intersection("a_", "b_"))
)

# ---- W, A: neighbourhoods and aggregates ----
EDGE = ", e AS (SELECT a.pair_id, a.i, a.j FROM obs_fx a JOIN obs_fx b ON a.pair_id = b.pair_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.pair_id, a.i, a.j, a.i_min, a.i_max, a.j_min, a.j_max HAVING count(*) < (least(a.i + 1, a.i_max - 1) - greatest(a.i - 1, a.i_min) + 1) * (least(a.j + 1, a.j_max - 1) - greatest(a.j - 1, a.j_min) + 1))"
FEATHER = EDGE + ", fe AS (SELECT o.*, coalesce((SELECT min(least(greatest(sqrt(pow(o.i - e.i, 2) + pow(o.j - e.j, 2)), 0.5) / 3, 1)) FROM e WHERE e.pair_id = o.pair_id AND abs(e.i - o.i) <= 3 AND abs(e.j - o.j) <= 3), 1) AS f FROM obs_fx o)"
on("W1_edge_cells", ("obs_fx",), EDGE + " SELECT pair_id, i, j FROM e")(lambda o: mosaic.edge_cells(o, ["pair_id"]).select("pair_id", "i", "j"))
on("W2_feather", ("obs_fx",), FEATHER + " SELECT pair_id, i, j, round(CAST(f AS DOUBLE), 6) AS f FROM fe")(lambda o: mosaic.feather(o, ["pair_id"], 3).select("pair_id", "i", "j", r6(C("f"), "f")))
MEANS = "sum(vx * f * weight / sx / sx) / sum(f * weight / sx / sx) AS vx, sum(vy * f * weight / sy / sy) / sum(f * weight / sy / sy) AS vy, sum(f * f * weight * weight / sx / sx) / pow(sum(f * weight / sx / sx), 2) AS ex, sum(f * f * weight * weight / sy / sy) / pow(sum(f * weight / sy / sy), 2) AS ey, sum(dt * f * weight / sx / sy) / sum(f * weight / sx / sy) AS dt, avg(vz) AS vz, count(*) AS n"
LAYERS = ("vx", "vy", "ex", "ey", "dt", "vz")
ROUNDED = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in LAYERS)
on("A1_A4_velocity_mosaic", ("obs_fx",), FEATHER + f", m AS (SELECT i, j, {MEANS} FROM fe GROUP BY i, j) SELECT i, j, {ROUNDED}, n FROM m")(lambda o: mosaic.finish(mosaic.mosaic_sums(mosaic.feather(o, ["pair_id"], 3))).select("i", "j", *[r6(C(c), c) for c in LAYERS], "n"))
on("A5_mosaic_stats", ("obs_fx",), "SELECT i, j, round(avg(vx), 6) AS vx, round(avg(vy), 6) AS vy, round(CASE WHEN count(*) > 1 THEN var_pop(vx) ELSE 0 END, 6) AS ex, round(CASE WHEN count(*) > 1 THEN var_pop(vy) ELSE 0 END, 6) AS ey, count(*) AS n FROM obs_fx GROUP BY i, j")(lambda o: mosaic.mosaic_stats(o).select("i", "j", *[r6(C(c), c) for c in ("vx", "vy", "ex", "ey")], "n"))
SUM_COLUMNS = "sum(vx * weight / sx / sx) AS vs, sum(weight / sx / sx) AS ss, sum(weight * weight / sx / sx) AS es"
on("A6_merge_rounds", ("obs_fx",), f""", a AS (SELECT i, j, {SUM_COLUMNS} FROM obs_fx WHERE pair_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT i, j, {SUM_COLUMNS} FROM obs_fx WHERE pair_id % 2 = 1 GROUP BY 1, 2),
 e AS (SELECT x.i, x.j FROM a x JOIN a y ON abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 GROUP BY x.i, x.j HAVING count(*) < (least(x.i + 1, 99) - greatest(x.i - 1, 0) + 1) * (least(x.j + 1, 19) - greatest(x.j - 1, 0) + 1)),
 f AS (SELECT a.*, coalesce((SELECT min(least(greatest(sqrt(pow(a.i - e.i, 2) + pow(a.j - e.j, 2)), 0.5) / 2, 1)) FROM e WHERE abs(e.i - a.i) <= 2 AND abs(e.j - a.j) <= 2), 1) AS f FROM a),
 u AS (SELECT i, j, vs * f AS vs, ss * f AS ss, es * f * f AS es FROM f UNION ALL SELECT * FROM b) SELECT i, j, round(CAST(sum(vs) / sum(ss) AS DOUBLE), 8) AS vx, round(CAST(sum(es) / pow(sum(ss), 2) AS DOUBLE), 8) AS ex FROM u GROUP BY 1, 2""")(
    lambda o: mosaic.finish(mosaic.merge_rounds([mosaic.mosaic_sums(o.where("pair_id % 2 = 0")), mosaic.mosaic_sums(o.where("pair_id % 2 = 1"))], 2, (0, 100, 0, 20))).select("i", "j", r6(C("vx"), "vx", 8), r6(C("ex"), "ex", 8))
)
def _six_rounds_sql() -> str:
    """Six families of pairs, folded one after another: before each, the sums so far are feathered at the edges of what they cover."""
    out = [f"r{k} AS MATERIALIZED (SELECT i, j, {SUM_COLUMNS} FROM obs_fx WHERE pair_id % 6 = {k} GROUP BY 1, 2)" for k in range(6)] + ["g0 AS MATERIALIZED (SELECT * FROM r0)"]
    for k in range(1, 6):
        out.append(f"""e{k} AS MATERIALIZED (SELECT x.i, x.j FROM g{k - 1} x JOIN g{k - 1} y ON abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 GROUP BY x.i, x.j HAVING count(*) < (least(x.i + 1, 99) - greatest(x.i - 1, 0) + 1) * (least(x.j + 1, 19) - greatest(x.j - 1, 0) + 1)),
 f{k} AS MATERIALIZED (SELECT a.*, coalesce((SELECT min(least(greatest(sqrt(pow(a.i - e.i, 2) + pow(a.j - e.j, 2)), 0.5) / 2, 1)) FROM e{k} e WHERE abs(e.i - a.i) <= 2 AND abs(e.j - a.j) <= 2), 1) AS f FROM g{k - 1} a),
 g{k} AS MATERIALIZED (SELECT i, j, sum(vs) AS vs, sum(ss) AS ss, sum(es) AS es FROM (SELECT i, j, vs * f AS vs, ss * f AS ss, es * f * f AS es FROM f{k} UNION ALL SELECT * FROM r{k}) GROUP BY 1, 2)""")
    return ", " + ",\n ".join(out) + " SELECT i, j, round(CAST(vs / ss AS DOUBLE), 6) AS vx, round(CAST(es / pow(ss, 2) AS DOUBLE), 6) AS ex FROM g5"


on("A6_six_rounds", ("obs_fx",), _six_rounds_sql())(
    lambda o: plans.velocity_mosaic([mosaic.mosaic_sums(o.where(f"pair_id % 6 = {k}")) for k in range(6)], 2, (0, 100, 0, 20)).select("i", "j", r6(C("vx"), "vx"), r6(C("ex"), "ex"))
)
on("A7_seed_from_reference", ("obs_fx", "cells_fx"), ", u AS (SELECT i, j, z / 100 / 4 AS v, CAST(0.25 AS DOUBLE) AS s FROM cells_fx UNION ALL SELECT i, j, vx * weight / sx / sx, weight / sx / sx FROM obs_fx) SELECT i, j, round(sum(v) / sum(s), 6) AS vx FROM u GROUP BY 1, 2")(
    lambda o, c: mosaic.finish(mosaic.add_sums(mosaic.seed_from_reference(c.select("i", "j", (C("z") / 100).alias("vx"), C("z").alias("vy"), F.lit(2.0).alias("ex"), F.lit(2.0).alias("ey"))), mosaic.mosaic_sums(o))).select("i", "j", r6(C("vx"), "vx"))
)
on("A8_auto_bounds", ("points_fx",), ", b AS (SELECT CAST(trunc(min(lon) - 3) AS INT) AS x0, CAST(trunc(max(lon) + 3) AS INT) AS x1, CAST(trunc(min(lat) - 3) AS INT) AS y0, CAST(trunc(max(lat) + 3) AS INT) AS y1 FROM points_fx) SELECT x0 AS origin_x, y0 AS origin_y, CAST(trunc((x1 - x0) / 0.5 + 0.5) AS INT) AS nx, CAST(trunc((y1 - y0) / 0.25 + 0.5) AS INT) AS ny FROM b")(
    lambda p: grid.auto_bounds(p.select(C("lon").alias("x"), C("lat").alias("y")), 0.5, 0.25)
)
on("A9_date_range", ("pairs_fx",), "SELECT min(jd1) AS jd1, max(jd1 + n_days) AS jd2 FROM pairs_fx")(mosaic.date_range)
on("A10_coarse_registration", ("ties_fx",), "SELECT pair_id, round(avg(y * 4), 8) AS range_offset, round(avg(x * 2), 8) AS azimuth_offset FROM ties_fx WHERE 100 + theta_d * 3000 + y BETWEEN 0 AND 199 AND 50 + x BETWEEN 0 AND 99 GROUP BY 1")(
    lambda t: geocode.coarse_registration(t.select("pair_id", (100 + C("theta_d") * 3000).alias("r1"), F.lit(50.0).alias("a1"), (100 + C("theta_d") * 3000 + C("y")).alias("r2"), (50 + C("x")).alias("a2"), F.lit(200).alias("n_range"), F.lit(100).alias("n_azimuth")), 4, 2).select("pair_id", r6(C("range_offset"), "range_offset", 8), r6(C("azimuth_offset"), "azimuth_offset", 8))
)
on("A11_bulk_offsets", ("ties_fx",), "SELECT pair_id, round(coalesce(avg(y) FILTER (WHERE 150 + x * 200 < 100), 0), 6) AS off FROM ties_fx GROUP BY 1")(lambda t: geocode.bulk_sv_offsets(t.select("pair_id", (150 + C("x") * 200).alias("azimuth"), C("y").alias("residual"))).select("pair_id", r6(C("offset"), "off")))
on("A12_fit_range_const", ("ties_fx",), "SELECT pair_id, count(*) AS n, round(sum(y / weight / weight) / sum(1 / weight / weight), 6) AS const, round(1 / sum(1 / weight / weight), 6) AS var FROM ties_fx GROUP BY 1")(
    lambda t: fit.fit_range_params(t, "const", passes=1).select("pair_id", "n", r6(F.get("params", F.lit(0)), "const"), r6(F.get("cov", F.lit(0)), "var"))
)
on("X1_wls_line", ("ties_fx",), "SELECT pair_id, count(*) AS n, round(regr_intercept(y, x), 6) AS a, round(regr_slope(y, x), 6) AS b FROM ties_fx GROUP BY 1 HAVING count(*) >= 3 AND var_pop(x) > 1e-9")(
    lambda t: fit.wls_fit(t, ["pair_id"], C("y"), F.lit(1.0), [F.lit(1.0), C("x")], 3).select("pair_id", "n", r6(F.get("params", F.lit(0)), "a"), r6(F.get("params", F.lit(1)), "b"))
)
on("A13_fit_azimuth_linear", ("ties_fx",), "SELECT pair_id, round(regr_intercept(y, x), 6) AS c1, round(regr_slope(y, x), 6) AS rate FROM ties_fx GROUP BY 1 HAVING count(*) >= 2 AND var_pop(x) > 1e-9")(
    lambda t: fit.fit_azimuth_params(t.withColumn("slant_sin", F.lit(1.0)).withColumn("weight", F.lit(1.0)), "linear", passes=1).select("pair_id", r6(F.get("params", F.lit(0)) * 8e5, "c1"), r6(F.get("params", F.lit(1)) * 8e5, "rate"))
)
TERMS = {"bn": "-sin(theta_d)", "bp": "-cos(theta_d)", "dbn": "-x * sin(theta_d)", "dbp": "-x * cos(theta_d)", "dbnq": "-x * x * sin(theta_d)", "dbpq": "-x * x * cos(theta_d)", "const": "1.0"}
PLANTED = {"bn": 12.5, "bp": -4.0, "dbn": -2.0, "dbp": 3.0, "dbnq": 7.5, "dbpq": 1.5, "const": 0.75, "ramp": 2.25}
# variant: terms in the order of the solution
RANGE_SOLUTIONS = {"bnbpdbp": "bn dbp const", "bpdbp": "dbp const", "const": "const", "linear": "bn dbp dbn const", "quad": "bn dbp dbn const dbpq dbnq", "sv_const": "bp", "sv_quad": "bn dbp dbn bp dbpq dbnq"}
PHASE_SOLUTIONS = {"ramp": "bn bp ramp dbn", "no_ramp": "bn bp ramp dbn", "bp": "bp", "bnbp": "bn bp", "bpdbp": "bp dbp", "bnbpdbp": "bn bp dbp", "dbp": "bn bp dbp dbn", "quad": "bn bp dbp dbn dbpq dbnq"}


def _planted(names: str, scale: float, ramp: str) -> str:
    """The measure that the planted coefficients make, in SQL."""
    terms = {n: t if n == "const" else f"{scale} * ({t})" for n, t in TERMS.items()} | {"ramp": f"{scale} * {ramp}"}
    return " + ".join(f"({PLANTED[n]}) * ({terms[n]})" for n in names.split())


for variant, names in RANGE_SOLUTIONS.items():
    def _run(spark, sf_dir, variant=variant, names=names):
        ties = fixture(spark, sf_dir, "ties_fx").withColumn("y", F.expr(_planted(names, 1.0, "x")).cast("double"))
        found = fit.fit_range_params(ties, variant, passes=1).where("n >= 20")
        return found.select("pair_id", "n", *[r6(F.get("params", F.lit(k)), f"p{k}", 4) for k in range(len(names.split()))])

    values = ", ".join(f"CAST({PLANTED[n]} AS DOUBLE) AS p{k}" for k, n in enumerate(names.split()))
    query(f"A12_fit_range_{variant}" if variant != "const" else "A12_fit_range_const_planted", f"SELECT pair_id, count(*) AS n, {values} FROM ties_fx GROUP BY pair_id HAVING count(*) >= 20", ("ties_fx",))(_run)
for variant, names in PHASE_SOLUTIONS.items():
    def _run(spark, sf_dir, variant=variant, names=names):
        ramp = "x * cos(theta_d)" if variant == "no_ramp" else "x"
        ties = fixture(spark, sf_dir, "ties_fx").withColumn("y", F.expr(_planted(names, 220.0, ramp)).cast("double")).withColumn("two_k", F.lit(220.0))
        found = fit.fit_phase_baseline(ties, variant).where("n >= 20")
        return found.select("pair_id", "n", *[r6(F.get("params", F.lit(k)), f"p{k}", 4) for k in range(len(names.split()))])

    values = ", ".join(f"CAST({PLANTED[n]} AS DOUBLE) AS p{k}" for k, n in enumerate(names.split()))
    query(f"A14_fit_phase_{variant}", f"SELECT pair_id, count(*) AS n, {values} FROM ties_fx GROUP BY pair_id HAVING count(*) >= 20", ("ties_fx",))(_run)
# the iterated fits, from ties of a baseline of 200 m at 850 km: the curvature is 2.4 cm, so a fit of the linear terms alone misses these values
CURVED = {"bn": 200.0, "bp": 45.0, "dbn": -3.0, "dbp": 2.5, "dbnq": 0.0, "dbpq": 0.0, "const": 0.75}
STEEP = {"bn": 9.0, "bp": -6.0, "dbn": 3.0, "dbp": 2.0, "dbnq": 1.0, "dbpq": -2.0, "const": 0.5, "ramp": 0.4}


def _way(bn: str, bp: str, x: str = "theta_d") -> str:
    """The way difference of a baseline, without the constant, in SQL."""
    return f"sqrt(slant * slant - 2 * slant * (({bn}) * sin({x}) + ({bp}) * cos({x})) + ({bn}) * ({bn}) + ({bp}) * ({bp})) - slant"


def _curved(spark: SparkSession, sf_dir: str, truth: dict[str, float], sv: bool, two_k: float | None = None, ramp: str | None = None) -> DataFrame:
    ties = fixture(spark, sf_dir, "ties_fx").withColumn("slant", 850000.0 + 40000.0 * C("x")).withColumns({"bn_s": 150.0 + 20.0 * C("x"), "bp_s": 60.0 - 5.0 * C("x")})
    along = lambda n: f"{truth[n]} + ({truth['d' + n]}) * x + ({truth['d' + n + 'q']}) * x * x"
    bn, bp = (f"{along(n)} + {n}_s" if sv else along(n) for n in ("bn", "bp"))
    y = f"{_way(bn, bp)} + {truth['const']}" if two_k is None else f"{two_k} * ({_way(bn, bp)})" + (f" + {two_k} * {truth['ramp']} * {ramp}" if ramp else "")
    return ties.withColumn("y", F.expr(y).cast("double")).withColumn("two_k", F.lit(two_k or 1.0))


for variant, names in RANGE_SOLUTIONS.items():
    def _run(spark, sf_dir, variant=variant, names=names):
        sv = variant.startswith("sv_")
        base = dict.fromkeys(CURVED, 0.0) if sv else dict(CURVED)
        truth = {n: v + (STEEP[n] if n in names.split() else 0.0) for n, v in base.items()}
        ties = _curved(spark, sf_dir, truth, sv)
        known = ties.select("pair_id").distinct().select("pair_id", *[F.lit(v).alias(n) for n, v in base.items()])
        found = calibrate.range_params(ties, variant, known).where("n >= 20")
        return found.select("pair_id", "n", *[(F.round(C(n), 3) + 0.0).alias(n) for n in CURVED])

    base = dict.fromkeys(CURVED, 0.0) if variant.startswith("sv_") else CURVED
    values = ", ".join(f"CAST({v + (STEEP[n] if n in names.split() else 0.0)} AS DOUBLE) AS {n}" for n, v in base.items())
    query(f"A12_curved_{variant}", f"SELECT pair_id, count(*) AS n, {values} FROM ties_fx GROUP BY pair_id HAVING count(*) >= 20", ("ties_fx",))(_run)
for variant, names in PHASE_SOLUTIONS.items():
    def _run(spark, sf_dir, variant=variant, names=names):
        base = {n: v for n, v in CURVED.items() if n != "const"} | {"ramp": 0.0}
        truth = {n: v + (STEEP[n] if n in names.split() else 0.0) for n, v in base.items()}
        ramp = {"no_ramp": "x * cos(theta_d)", "ramp": "x"}.get(variant)
        ties = _curved(spark, sf_dir, truth | {"const": 0.0}, False, 220.0, ramp)
        known = ties.select("pair_id").distinct().select("pair_id", *[F.lit(v).alias(n) for n, v in base.items()])
        found = calibrate.phase_baseline(ties, variant, known).where("n >= 20")
        return found.select("pair_id", "n", *[(F.round(C(n), 3) + 0.0).alias(n) for n in base])

    base = {n: v for n, v in CURVED.items() if n != "const"} | {"ramp": 0.0}
    values = ", ".join(f"CAST({v + (STEEP[n] if n in names.split() else 0.0)} AS DOUBLE) AS {n}" for n, v in base.items())
    query(f"A14_curved_{variant}", f"SELECT pair_id, count(*) AS n, {values} FROM ties_fx GROUP BY pair_id HAVING count(*) >= 20", ("ties_fx",))(_run)
for variant, names in {"const": "c1", "linear": "c1 doffdx", "baseline_const": "c1 dbc", "baseline_linear": "c1 dbc doffdx"}.items():
    RATES = {"c1": 0.0, "dbc": 2e-5, "dbh": -1e-5, "doffdx": 0.0}
    GONE = {"c1": 3.0, "dbc": 3e-5, "doffdx": 0.4}

    def _run(spark, sf_dir, variant=variant, names=names, truth={n: v + (GONE[n] if n in names.split() else 0.0) for n, v in RATES.items()}):
        ties = fixture(spark, sf_dir, "ties_fx").withColumns({"slant": 850000.0 + 40000.0 * C("x"), "theta": 0.6 + C("theta_d"), "sv_offset": 0.1 * C("x")})
        y = f"{truth['c1']} + slant * sin(theta) * {truth['dbc']} - slant * cos(theta) * ({truth['dbh']}) + {truth['doffdx']} * x + sv_offset"
        ties = ties.withColumn("y", F.expr(y).cast("double"))
        known = ties.select("pair_id").distinct().select("pair_id", F.lit(2e-5).alias("dbc"), F.lit(-1e-5).alias("dbh"))
        found = calibrate.azimuth_params(ties, variant, known).where("n >= 20")
        return found.select("pair_id", "n", *[(F.round(C(n) * k, 3) + 0.0).alias(n) for n, k in (("c1", 1), ("dbc", 1e6), ("dbh", 1e6), ("doffdx", 1))])

    values = ", ".join(f"CAST(round({(RATES[n] + (GONE[n] if n in names.split() else 0.0)) * k}, 3) AS DOUBLE) AS {n}" for n, k in (("c1", 1), ("dbc", 1e6), ("dbh", 1e6), ("doffdx", 1)))
    query(f"A13_known_rates_{variant}", f"SELECT pair_id, count(*) AS n, {values} FROM ties_fx GROUP BY pair_id HAVING count(*) >= 20", ("ties_fx",))(_run)
# the weighted mean and the spread of what the known terms leave, with the errors shared out by weight
on("A12_const_spread", ("ties_fx",), """, w AS (SELECT pair_id, y, greatest(weight / avg(weight) OVER (PARTITION BY pair_id), 0.1) AS s FROM ties_fx),
 m AS (SELECT pair_id, count(*) AS n, sum(y / s / s) / sum(1 / s / s) AS const, stddev_pop(y) AS spread, 1 / sum(1 / s / s) AS unit FROM w GROUP BY 1)
 SELECT pair_id, n, round(const, 6) AS const, round(spread, 6) AS sigma_res, round(unit * spread * spread, 6) AS variance FROM m WHERE n >= 2""")(
    lambda t: calibrate.range_params(t.withColumn("slant", F.lit(8.5e5)), "const").select("pair_id", "n", r6(C("const"), "const"), r6(C("sigma_res"), "sigma_res"), r6(F.get("cov", F.lit(35)), "variance"))
)
on("A12_fit_range_params", ("ties_fx",), None)(lambda t: fit.fit_range_params(t, "linear").select("pair_id", "n", "params", "cov", "sigma_res"))
on("A14_fit_phase_baseline", ("ties_fx",), None)(lambda t: fit.fit_phase_baseline(t.withColumn("two_k", F.lit(1.0)), "dbp").select("pair_id", "n", "params"))
on("A15_reweight_sigma", ("ties_fx",), ", s AS (SELECT pair_id, sqrt(greatest(avg(y * y) - avg(y) * avg(y), 0)) AS sp, sum(weight) AS sw, count(*) AS n FROM ties_fx GROUP BY 1) SELECT pair_id, round(greatest(sp * weight * n / sw, 0.1 * sp, 1e-12), 5) AS sigma FROM ties_fx JOIN s USING (pair_id)")(
    lambda t: fit.reweight(t.withColumn("e", C("y")), ["pair_id"]).select("pair_id", r6(C("sigma"), "sigma", 5))
)
query("A16_place_covariance", "SELECT s_suppkey, CASE WHEN a = 3 AND b = 3 THEN s_suppkey * 4.0 WHEN a = 5 AND b = 5 THEN 9.0 WHEN (a = 3 AND b = 5) OR (a = 5 AND b = 3) THEN 3.0 ELSE 0.0 END AS c, CAST(a * 6 + b AS INT) AS place FROM supplier, range(0, 6) x(a), range(0, 6) y(b)")(
    lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.posexplode(fit.place_covariance(F.array(C("s_suppkey").cast("double"), F.lit(0.5), F.lit(0.5), F.lit(1.0)), [3, 5], 6, [2.0, 3.0])).alias("place", "c"))
)
# two parameters, dbp and the constant, at places 2 and 5: the inverse of their 2 x 2 normal matrix
NORMAL = "SELECT pair_id, sum(pow(x * cos(theta_d), 2) / weight / weight) AS p, sum(-x * cos(theta_d) / weight / weight) AS q, sum(1 / weight / weight) AS r, count(*) AS n FROM ties_fx GROUP BY 1"
on("A16_range_covariance", ("ties_fx",), f", m AS ({NORMAL}) SELECT pair_id, CAST(place AS INT) AS place, round(CAST(CASE place WHEN 14 THEN r WHEN 35 THEN p WHEN 17 THEN -q WHEN 32 THEN -q ELSE 0 END / (p * r - q * q) AS DOUBLE), 5) AS c FROM m, range(0, 36) k(place) WHERE n >= 20")(
    lambda t: fit.placed_covariance(fit.fit_range_params(t, "bpdbp", passes=1), fit.RANGE_VARIANTS, "bpdbp").where("n >= 20").select("pair_id", F.posexplode("cov").alias("place", "v")).select("pair_id", "place", r6(C("v"), "c", 5))
)
on("A19_image_average", ("acquisitions_fx",), "SELECT i, j, round(sum(value * 2 * n_days) / sum(2), 8) AS gain, round(sum(value * n_days) / sum(n_days), 8) AS mean FROM acquisitions_fx GROUP BY 1, 2")(
    lambda a: images.image_mosaic_average(a.withColumn("f", F.lit(2.0)).withColumn("weight", C("n_days"))).select("i", "j", r6(C("value"), "gain", 8)).join(images.image_mosaic_average(a.withColumn("weight", C("n_days")), as_gain=False).select("i", "j", r6(C("value"), "mean", 8)), ["i", "j"])
)
RTC = "SELECT i, j, CAST(j AS DOUBLE) + (z - 1000) / 400 AS r, CAST(i AS DOUBLE) / 2 + j % 3 AS a, z / 100 AS ab, z / 100 + 2 + i % 10 * 4 AS ag, z / 1000 - 3.2 AS db, CASE WHEN (i * 7 + j) % 13 = 0 THEN -0.5 ELSE 0.5 END AS shadow FROM cells_fx"
# the cell that gathers is tested, every neighbour up to 3 columns and 2 rows away gives; boxes of side 1 must touch in azimuth, and share 1 - |dr| in range
on("A20_rtc_area_sum", ("cells_fx",), f""", c AS ({RTC}), g AS (SELECT a.i, a.j, sum(CASE WHEN abs(a.a - b.a) <= 1 THEN greatest(1 - abs(a.r - b.r), 0) ELSE 0 END * b.ab) AS mb, sum(CASE WHEN abs(a.a - b.a) <= 1 THEN greatest(1 - abs(a.r - b.r), 0) ELSE 0 END * b.ag) AS mg
 FROM c a JOIN c b ON abs(a.j - b.j) <= 3 AND abs(a.i - b.i) <= 2 AND (a.i <> b.i OR a.j <> b.j) WHERE NOT (a.shadow < -0.001 OR a.db < -2 OR a.ab / a.ag > 0.65) GROUP BY 1, 2)
 SELECT c.i, c.j, round(ab + coalesce(mb, 0), 6) AS ab_sum, round(ag + coalesce(mg, 0), 6) AS ag_sum, round(CASE WHEN shadow < -0.001 THEN -1 ELSE (ab + coalesce(mb, 0)) / (ag + coalesce(mg, 0)) END, 6) AS ratio FROM c LEFT JOIN g ON g.i = c.i AND g.j = c.j""")(
    lambda c: images.rtc_area_sum(c.select("i", "j", (C("j").cast("double") + (C("z") - 1000) / 400).alias("r"), (C("i").cast("double") / 2 + C("j") % 3).alias("a"), (C("z") / 100).alias("ab"), (C("z") / 100 + 2 + C("i") % 10 * 4).alias("ag"), (C("z") / 1000 - 3.2).alias("db"), F.when((C("i") * 7 + C("j")) % 13 == 0, -0.5).otherwise(0.5).alias("shadow"))).select("i", "j", r6(C("ab_sum"), "ab_sum"), r6(C("ag_sum"), "ag_sum"), r6(C("ratio"), "ratio"))
)
on("A21_run_summary", ("pairs_fx", "obs_fx"), "SELECT pass_type, count(*) AS given, count(u.pair_id) AS used, count(*) - count(u.pair_id) AS dropped FROM pairs_fx p LEFT JOIN (SELECT DISTINCT pair_id FROM obs_fx WHERE vx > 104) u ON u.pair_id = p.pair_id GROUP BY 1")(lambda p, o: mosaic.run_summary(p, o.where("vx > 104")))
on("A22_hemisphere", ("points_fx",), "SELECT CASE WHEN min_by(lat, point_id) < 0 THEN 'south' ELSE 'north' END AS hemisphere, CASE WHEN min_by(lat, point_id) < 0 THEN 0 ELSE 45 END AS rot, CASE WHEN min_by(lat, point_id) < 0 THEN 71 ELSE 70 END AS std_lat FROM points_fx")(
    lambda p: mosaic.infer_hemisphere(p, "point_id").select("hemisphere", "rot", "std_lat")
)
TIE_LINE = """SELECT point_id AS seq, lon AS x, lat AS y, h AS height, CASE WHEN point_id % 3 = 0 THEN 1 ELSE 0 END AS code, point_id % 4 AS form, lat, lon FROM points_fx"""
on("U3_all_ties", ("points_fx",), f""", t AS ({TIE_LINE}) SELECT round(lat, 6) AS lat, round(CASE WHEN form = 2 THEN height ELSE 5 END, 6) AS z, round(CASE WHEN form = 2 THEN 0 ELSE 8 + CASE WHEN code = 1 THEN 0.5 ELSE 0 END END, 6) AS vz, round(CASE WHEN form = 1 THEN 0.25 ELSE 1 END, 6) AS weight FROM t WHERE seq > 0 AND form <> 3 AND lon BETWEEN 20 AND 300
 UNION ALL SELECT round(lat, 6), round(h, 6), 0, NULL FROM points_fx WHERE lat > 80""")(
    lambda p: mosaic.all_ties(
        p.where("lat > 80").select("lat", C("h").alias("z"), F.lit(0.0).alias("vz")),
        mosaic.extra_ties(p.select(C("point_id").alias("seq"), C("lon").alias("x"), C("lat").alias("y"), C("h").alias("height"), F.when(C("point_id") % 3 == 0, 1).otherwise(0).alias("code"), F.when(C("point_id") % 4 == 2, F.array("lat", "lon")).when(C("point_id") % 4 == 3, F.array("lat", "lon", F.lit(1.0))).when(C("point_id") % 4 == 1, F.array("lat", "lon", *map(F.lit, (5.0, 6.0, 7.0, 8.0, 0.25)))).otherwise(F.array("lat", "lon", *map(F.lit, (5.0, 6.0, 7.0, 8.0)))).alias("f")), (20.0, 300.0, -90.0, 90.0), "code", 0.5),
    ).select(r6(C("lat"), "lat"), r6(C("z"), "z"), r6(C("vz"), "vz"), r6(C("weight"), "weight"))
)
query("P11_orbit_coverage", "SELECT s_suppkey AS scene_id, round(CAST(s_suppkey % 120 - 50 AS DOUBLE), 6) AS late, round(CAST(50 + 8 + s_suppkey % 90 AS DOUBLE) - 110, 6) AS early FROM supplier WHERE s_suppkey % 120 - 50 > 45 OR 58 + s_suppkey % 90 - 110 > 45")(
    lambda s, d: images.orbit_coverage(_scenes(s, d).withColumn("n_azimuth", 1000 + C("scene_id") % 90 * 125).withColumn("azimuth_looks", F.lit(4)).withColumn("states", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct(F.when(k == 0, (C("scene_id") % 120).cast("double")).otherwise(110.0).alias("t"))))).select("scene_id", r6(C("late"), "late"), r6(C("early"), "early"))
)
HEADINGS = "i AS i, j AS j, CASE WHEN (i + j) % 7 <> 3 THEN CAST(0.3 + a_pair_id % 5 * 0.3 + i * 0.001 AS DOUBLE) END AS a_heading, CASE WHEN (i * j) % 5 <> 2 THEN CAST(1.4 + j * 0.001 AS DOUBLE) END AS b_heading"
on("P7_separated_pairs", ("pairs_fx",), f""", c AS ({CROSS}), g AS (SELECT c.*, a.i, b.j FROM c, range(-10, 2000) a(i), range(0, 40) b(j) WHERE i >= i_min AND i < i_max AND j >= j_min AND j < j_max AND (i - i_min) % greatest((i_max - i_min) // 4, 1) = 0 AND (j - j_min) % greatest((j_max - j_min) // 4, 1) = 0),
 h AS (SELECT a_pair_id, b_pair_id, {HEADINGS} FROM g), l AS (SELECT *, row_number() OVER (PARTITION BY a_pair_id, b_pair_id ORDER BY i DESC, j DESC) AS k FROM h WHERE a_heading IS NOT NULL AND b_heading IS NOT NULL)
 SELECT a_pair_id, b_pair_id, round(a_heading - b_heading, 6) AS alpha FROM l WHERE k = 1 AND abs(a_heading - b_heading) BETWEEN 0.7 AND 2 * pi() - 0.7""")(
    lambda p: grid.separated_pairs(grid.separation_samples(grid.crossing_pairs(p)).select("a_pair_id", "b_pair_id", "i", "j", F.when((C("i") + C("j")) % 7 != 3, 0.3 + C("a_pair_id") % 5 * 0.3 + C("i") * 0.001).alias("a_heading"), F.when((C("i") * C("j")) % 5 != 2, 1.4 + C("j") * 0.001).alias("b_heading"))).select("a_pair_id", "b_pair_id", r6(C("alpha"), "alpha"))
)
ALONG = ", s1 AS (SELECT i, j, CASE WHEN count(*) FILTER (WHERE v > 1e-6) OVER w = 3 THEN avg(v) OVER w ELSE 0 END AS v FROM (SELECT i, j, CASE WHEN code = 5 THEN 0 ELSE z END AS v FROM cells_fx) WINDOW w AS (PARTITION BY i ORDER BY j RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))"
on("W3_smooth", ("cells_fx",), ALONG + " SELECT i, j, round(CASE WHEN count(*) FILTER (WHERE v > 1e-6) OVER w = 3 THEN avg(v) OVER w ELSE 0 END, 6) AS value FROM s1 WINDOW w AS (PARTITION BY j ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)")(
    lambda c: images.smooth_separable(c.select(C("i").alias("a"), C("j").alias("r"), F.when(C("code") == 5, 0.0).otherwise(C("z")).alias("value")), 3, []).select(C("a").alias("i"), C("r").alias("j"), r6(C("value"), "value"))
)
on("W4_dem_slope", ("cells_fx",), "SELECT c.i, c.j, round((e.z - w.z) / 200, 6) AS dzdx, round((n.z - s.z) / 200, 6) AS dzdy FROM cells_fx c LEFT JOIN cells_fx e ON e.i = c.i AND e.j = c.j + 1 LEFT JOIN cells_fx w ON w.i = c.i AND w.j = c.j - 1 LEFT JOIN cells_fx n ON n.i = c.i + 1 AND n.j = c.j LEFT JOIN cells_fx s ON s.i = c.i - 1 AND s.j = c.j")(
    lambda c: sampling.dem_slope(c, 100.0, 100.0).select("i", "j", r6(C("dzdx"), "dzdx"), r6(C("dzdy"), "dzdy"))
)
NEAREST = "SELECT i, j, image_id, value, CAST(apart AS INT) AS apart FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY apart, image_id) AS k FROM (SELECT *, abs(date_diff('day', image_date, DATE '1995-06-17')) AS apart FROM acquisitions_fx)) WHERE k = 1"
on("W5_nearest_date", ("acquisitions_fx",), NEAREST)(lambda a: images.nearest_date_mosaic(a, "1995-06-17"))
on("W6_orbit_priority", ("acquisitions_fx",), "SELECT i, j, image_id, value FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY CASE WHEN pass_type = 1 THEN 0 ELSE 1 END, image_id) AS k FROM acquisitions_fx) WHERE k = 1")(lambda a: images.orbit_priority_mosaic(a, 1))
on("W7_hybrid", ("acquisitions_fx", "cells_fx"), f", n AS ({NEAREST}), h AS (SELECT i, j, CAST(trunc(z) AS INT) > 1000 AS high FROM cells_fx), m AS (SELECT i, j, avg(value) AS value FROM acquisitions_fx GROUP BY 1, 2) SELECT i, j, round(CASE WHEN high THEN m.value ELSE n.value END, 6) AS value FROM h JOIN m USING (i, j) JOIN n USING (i, j)")(
    lambda a, c: images.hybrid_mosaic(a, c, 1000, "1995-06-17").select("i", "j", r6(C("value"), "value"))
)
on("T2_row_major", ("cells_fx",), "SELECT i, j, z FROM cells_fx ORDER BY i, j")(lambda c: mosaic.row_major(c.select("i", "j", "z")))

# ---- K, S: sinks and sources that are tables ----
on("K1_velocity_layers", ("obs_fx",), f", fe AS (SELECT *, 1 AS f FROM obs_fx), m AS (SELECT i, j, {MEANS} FROM fe GROUP BY i, j) SELECT i, j, round(vx, 5) AS vx, round(vy, 5) AS vy, round(dt, 5) AS dt, round(CASE WHEN ex > 0 THEN sqrt(ex) ELSE ex END, 5) AS ex, round(CASE WHEN ex > 0 THEN sqrt(ey) ELSE ey END, 5) AS ey FROM m")(
    lambda o: sinks.velocity_layers(mosaic.finish(mosaic.mosaic_sums(o))).select("i", "j", *[r6(C(c), c, 5) for c in ("vx", "vy", "dt", "ex", "ey")])
)
on("K2_mosaic_meta", ("pairs_fx", "obs_fx"), "SELECT pair_id, jd1 + n_days / 2 AS central_jd, DATE '1970-01-01' + CAST(floor(jd1 + 0.5) - 2440588 AS INT) AS date1, DATE '1970-01-01' + CAST(floor(jd1 + n_days + 0.5) - 2440588 AS INT) AS date2, n_days, CAST(i_min + i_max AS DOUBLE) / 2 AS i_mid, CAST(j_min + j_max AS DOUBLE) / 2 AS j_mid FROM pairs_fx WHERE pair_id IN (SELECT pair_id FROM obs_fx)")(sinks.mosaic_meta)
on("K3_tie_lines", ("points_fx",), "SELECT printf('%.6f %.6f %.2f %.3f %.3f %.3f', lat, lon, h * CAST(0.71317 AS DOUBLE), lat / 7, lon / 7, h * 0) AS value FROM points_fx WHERE h > 0")(lambda p: sinks.tie_lines(p.where("h > 0").select("lat", "lon", (C("h") * 0.71317).alias("z"), (C("lat") / 7).alias("vx"), (C("lon") / 7).alias("vy"), (C("h") * 0).alias("vz"))))
on("K4_image_layers", ("samples_fx",), f"SELECT l_orderkey, l_linenumber, {DB} AS sigma0, greatest(round({DB} + theta, 2), -30.0) AS gamma0 FROM samples_fx")(lambda s: sinks.image_layers(s.select(*S, (C("sr") * 0.01 - 0.0005).alias("value"), C("theta").alias("gamma_correction"))).select(*S, "sigma0", "gamma0"))
# the file as written, and read again
on("K5_fit_lines", ("ties_fx",), """, w AS (SELECT pair_id, y, greatest(weight / avg(weight) OVER (PARTITION BY pair_id), 0.1) AS s FROM ties_fx),
 m AS (SELECT pair_id, count(*) AS n, sum(y / s / s) / sum(1 / s / s) AS const, stddev_pop(y) AS spread, 1 / sum(1 / s / s) AS unit FROM w GROUP BY 1)
 SELECT CAST(pair_id AS VARCHAR) AS pair_id, '; Ntiepoints/Ngiven used= ' || n || '/' || n AS head, 12 AS lines, round(const, 6) AS const, round(spread, 6) AS sigma_res, round(unit * spread * spread, 6) AS variance FROM m WHERE n >= 2""")(
    lambda t: (lambda files: text.read_fit_params(t.sparkSession, files, "range").join(files.select(F.regexp_extract("file", "[^/]+$", 0).alias("pair_id"), "text"), "pair_id"))(
        sinks.fit_lines(calibrate.range_params(t.withColumn("slant", F.lit(8.5e5)), "const")).select(F.concat(F.lit("/fits/"), C("pair_id").cast("string")).alias("file"), C("value").alias("text"))
    ).select("pair_id", F.get(F.split("text", "\n"), F.lit(0)).alias("head"), F.size(F.split("text", "\n")).alias("lines"), r6(F.get("params", F.lit(4)), "const"), r6(C("sigma_res"), "sigma_res"), r6(F.get("cov", F.lit(35)), "variance"))
)
on("K6_geocoded_points", ("samples_fx",), "SELECT l_orderkey, l_linenumber, round(CASE WHEN code = 5 THEN -9999 ELSE theta * 4 + 1.5 END, 6) AS range, round(CASE WHEN code = 5 THEN -9999 ELSE psi * 2 + 0.5 END, 6) AS azimuth FROM samples_fx")(
    lambda s: sinks.geocoded_points(s.select(*S, F.when(C("code") != 5, C("theta")).alias("range"), C("psi").alias("azimuth")), 4, 2).select(*S, r6(C("range"), "range"), r6(C("azimuth"), "azimuth"))
)
on("P9_within_max_dt", ("obs_fx",), f", fe AS (SELECT *, 1 AS f FROM obs_fx), m AS (SELECT i, j, {MEANS} FROM fe GROUP BY i, j) SELECT i, j, round(CASE WHEN abs(dt) <= 1.49 THEN vx END, 6) AS vx, round(CASE WHEN abs(dt) <= 1.49 THEN ey END, 6) AS ey FROM m")(lambda o: mosaic.within_max_dt(mosaic.finish(mosaic.mosaic_sums(o)), 10.0, 11.0).select("i", "j", r6(C("vx"), "vx"), r6(C("ey"), "ey")))
on("P10_select_tie_cells", ("obs_fx",), f", fe AS (SELECT *, 1 AS f FROM obs_fx), m AS (SELECT i, j, {MEANS} FROM fe GROUP BY i, j) SELECT i, j FROM m WHERE sqrt(vx * vx + vy * vy) < 40 AND sqrt(ex) BETWEEN 1e-12 AND 119.99 AND sqrt(ey) BETWEEN 1e-12 AND 119.99 AND abs(vz) < 1.6")(lambda o: mosaic.select_tie_cells(mosaic.finish(mosaic.mosaic_sums(o)), 40.0).select("i", "j"))
def _pair_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair lists as files of lines, one for each nation: grid, number of files, then pairs of 5, 6 or 10 fields, with comments and an end."""
    s = C("s_suppkey")
    fields = F.concat_ws(" ", F.concat(F.lit("phase"), s), F.lit("geo"), F.lit("base"), (s % 30).cast("string"), F.when(s % 2 == 0, F.lit("0.5")), F.when(s % 4 == 0, F.lit("a b none d 0")), F.when(s % 3 == 0, F.lit("; checked")))
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("list"), C("s_nationkey")).alias("file"), (s + 10).alias("seq"), fields.alias("value"))
    lists = own.select("file").distinct()
    more = lists.select("file", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("; a pair list").alias("value")), F.struct(F.lit(1).alias("seq"), F.lit("-200 100 40 50 0.5 0.25").alias("value")), F.struct(F.lit(2).alias("seq"), F.lit("7").alias("value")), F.struct(F.lit(1 << 40).alias("seq"), F.lit("&").alias("value")), F.struct(F.lit(1 << 41).alias("seq"), F.lit("never read at all").alias("value")))).alias("x")).select("file", "x.*")
    return own.unionByName(more)


query("S1_pair_list", """SELECT 'list' || s_nationkey AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, 'phase' || s_suppkey AS phase_path, CAST(s_suppkey % 30 AS DOUBLE) AS n_days,
 CASE WHEN s_suppkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE 1 END AS weight, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS cross_flag, CASE WHEN s_suppkey % 4 = 0 THEN 'a' END AS az_offset_path, CAST(NULL AS VARCHAR) AS rg_offset_path FROM supplier""")(
    lambda s, d: text.read_pair_list(s, _pair_lists(s, d)).select("file", F.row_number().over(Window.partitionBy("file").orderBy("input_seq")).cast("long").alias("place"), "phase_path", "n_days", "weight", "cross_flag", "az_offset_path", "rg_offset_path")
)
query("S1_grid_spec", "SELECT DISTINCT 'list' || s_nationkey AS file, -200000.0 AS origin_x, 100000.0 AS origin_y, 40 AS nx, 50 AS ny, 500.0 AS dx, 250.0 AS dy FROM supplier")(lambda s, d: text.read_grid_spec(s, _pair_lists(s, d)))


def _scene_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scenes of suppliers as GeoJSON (every third) and as text (two of three, so that some are both), in tables of file and text."""
    k = C("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int"))
    vector = lambda n, a: F.concat_ws(" ", *[F.format_string("%.1f", (k + 10.0 * n + m + a)) for m in range(3)])
    pairs = [("ImageName", F.concat(F.lit("scene "), k)), ("Date", day.cast("string")), ("CorrectedTime", F.lit("23 59 58.5")), ("MLRangeSize", F.lit("101")), ("MLAzimuthSize", F.lit("200")), ("NumberRangeLooks", F.lit("4")), ("NumberAzimuthLooks", F.lit("5")),
             ("SLCRangePixelSize", F.lit("2.5")), ("SLCAzimuthPixelSize", F.lit("4")), ("MLCenterRange", (850000 + k).cast("string")), ("RangeErrorCorrection", F.lit("5")), ("SpaceCraftAltitude", F.lit("700000")), ("EarthRadiusMajor", F.lit("6378137")), ("EarthRadiusMinor", F.lit("6356752")),
             ("PRF", F.lit("500")), ("Wavelength", F.lit("0.056")), ("PassType", F.lit("Descending")), ("LookDirection", F.when(k % 2 == 0, "left").otherwise("right")), ("NumberOfStateVectors", F.when(k % 7 == 0, "4").otherwise("6")), ("StateVectorInterval", F.lit("10")), ("TimeOfFirstStateVector", F.lit("86340")), ("CenterLatLon", F.lit("[70.5, 10.5]"))]
    pairs += [(f"SV_{kind}_{n}", vector(n, a)) for n in range(1, 7) for kind, a in (("Pos", 0.0), ("Vel", 0.5))]
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((10.0, 70.0), (10.0, 71.0), (11.0, 71.0), (11.0, 70.0), (10.0, 70.0))])).alias("coordinates")).alias("geometry"), F.struct(*[v.cast("string").alias(n) for n, v in pairs]).alias("properties")))
    lines = ["Image name :  text {0}", "Image date : {1}", "; sizes", "101 200 4 5", "6378.137 6356.752 {2} 70.5 700 5", "70 10", "70 11", "71 10", "71 11", "70.5 10.5", "2.5 4", "descending", "{3}", "state", "23 59 58.5", "500", "0.056", "6", "86340", "10"]
    parts = [F.lit(x) if "{" not in x else F.concat(F.lit(x[: x.index("{")]), {"0": k.cast("string"), "1": F.upper(F.date_format(day, "dd MMM yyyy")), "2": ((850000 + k) / 1000).cast("string"), "3": F.when(k % 2 == 0, "left").otherwise("right")}[x[x.index("{") + 1]], F.lit(x[x.index("}") + 1 :])) for x in lines]
    parts += [vector(n, a) for n in range(1, 7) for a in (0.0, 0.5)] + [F.when(k % 5 == 0, "deltaT 3.5")]
    return (rows.where(k % 3 == 0).select(F.concat(F.lit("/s/"), k, F.lit(".geojson")).alias("file"), body.alias("text")), rows.where(k % 3 < 2).select(F.concat(F.lit("/t/"), k, F.lit(".geodat")).alias("file"), F.concat_ws("\n", *parts).alias("text")))


# what both layouts say is the same; 4 state vectors are too few
query("S5_S6_typed_scenes", """WITH s AS (SELECT *, s_suppkey % 3 = 0 AS g FROM supplier WHERE s_suppkey % 3 < 2)
 SELECT CAST(s_suppkey AS VARCHAR) AS scene_id, CASE WHEN g THEN 'geojson' ELSE 'text' END AS source, CASE WHEN g THEN 'scene ' ELSE 'text ' END || s_suppkey AS label, CAST(DATE '2020-01-01' + CAST(s_suppkey % 300 AS INT) AS DATE) AS image_date,
 round(86398.5 + CASE WHEN NOT g AND s_suppkey % 5 = 0 THEN 3.5 ELSE 0.004 END, 6) AS seconds, CAST(849995 + s_suppkey AS DOUBLE) AS rc, CAST(849495 + s_suppkey AS DOUBLE) AS rn, CAST(850495 + s_suppkey AS DOUBLE) AS rf, CAST(10 AS DOUBLE) AS range_pixel, CAST(20 AS DOUBLE) AS azimuth_pixel,
 CASE WHEN s_suppkey % 2 = 0 THEN 'left' ELSE 'right' END AS look_dir, 'descending' AS pass_type, CAST(700000 AS DOUBLE) AS altitude, CAST(70.5 AS DOUBLE) AS lat0, CAST(71 AS DOUBLE) AS lat3, CAST(s_suppkey + 32 AS DOUBLE) AS z3, CAST(86360 AS DOUBLE) AS t3,
 CASE WHEN g AND s_suppkey % 7 = 0 THEN 'states' END AS problem FROM s""")(
    lambda s, d: (lambda g, t: scenes.all_scenes(scenes.geojson_scenes(s, g), scenes.text_scenes(s, t)))(*_scene_files(s, d)).select(
        "scene_id", "source", "label", "image_date", r6(C("seconds"), "seconds"), "rc", "rn", "rf", "range_pixel", "azimuth_pixel", "look_dir", "pass_type", "altitude",
        C("control_points")[0]["lat"].alias("lat0"), C("control_points")[4]["lat"].alias("lat3"), C("states")[2]["z"].alias("z3"), C("states")[2]["t"].alias("t3"), "problem",
    )
)


# ---- kernels, streams and whole plans ----
def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes on circular polar orbits, one for each supplier, in the columns of the kernels."""
    n = F.sequence(F.lit(0), F.lit(11))
    radius, rate = 7071000.0, 7500.0 / 7071000.0
    degrees = (C("s_suppkey") * 37 % 360).cast("double")  # not back from radians, or places on the edge of a box fall out of it
    lon = F.radians(degrees)
    a = lambda k: F.radians(F.lit(70.0)) + (k * 10.0 - 55.0) * rate
    state = lambda k: F.struct((radius * F.cos(a(k)) * F.cos(lon)).alias("x"), (radius * F.cos(a(k)) * F.sin(lon)).alias("y"), (radius * F.sin(a(k))).alias("z"), (-7500.0 * F.sin(a(k)) * F.cos(lon)).alias("vx"), (-7500.0 * F.sin(a(k)) * F.sin(lon)).alias("vy"), (7500.0 * F.cos(a(k))).alias("vz"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(C("s_suppkey").alias("scene_id"), F.lit(60.0).alias("lat_min"), F.lit(80.0).alias("lat_max"), (degrees - 20).alias("lon_min"), (degrees + 20).alias("lon_max"), F.lit(0.0).alias("t0"), F.lit(10.0).alias("step"), F.transform(n, state).alias("states"), F.lit(50.0).alias("start"), F.lit(500.0).alias("prf"), F.lit(800000.0).alias("near"), F.lit(10.0).alias("pixel"), F.lit(6000).alias("n_range"), F.lit(5000).alias("n_azimuth"), F.lit(False).alias("look_left"))


query("J8_geocode_points")(lambda s, d: geocode.geocode_points(fixture(s, d, "points_fx"), _scenes(s, d)))
query("J13_scene_footprints")(lambda s, d: geocode.scene_footprints(_scenes(s, d)))
query("K8_footprint_json")(lambda s, d: sinks.footprint_json(geocode.scene_footprints(_scenes(s, d))))


@query("J11_radar_grid_to_ground")
def _ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _scenes(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long")))
    samples = scenes.select("scene_id", k.alias("sample_id")).select("scene_id", "sample_id", (C("sample_id") % 5 * 1200.0).alias("range"), (F.floor(C("sample_id") / 5) * 1000.0).alias("azimuth"), (C("sample_id") * 20.0).alias("h"))
    return geocode.locate(scenes, samples)


@query("A18_baseline_profile")
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "samples_fx").withColumnsRenamed({"bn": "b0", "bp": "b1"}).select(C("l_orderkey").alias("pair_id"), C("l_linenumber").alias("line"), "theta", (C("slant") * 8).alias("a_x"), *[F.lit(v).alias(k) for k, v in (("a_y", 0.0), ("a_z", 0.0), ("a_vx", 0.0), ("a_vy", 0.0), ("a_vz", 7500.0))], (C("slant") * 8 + C("b0")).alias("b_x"), C("b1").alias("b_y"), C("dr").alias("b_z"))
    return geocode.sv_baseline_profile(df)


A17_TERMS = "0.5 + 0.01 * r - 0.02 * a + 0.0001 * r * a + 0.0002 * r * r"


@query("A17_sv_azimuth_surface", "SELECT s_suppkey AS pair_id, CAST(2500 AS BIGINT) AS n, CAST(0.5 AS DOUBLE) AS p0, CAST(0.01 AS DOUBLE) AS p1, CAST(-0.02 AS DOUBLE) AS p2, CAST(0.0001 AS DOUBLE) AS p3, CAST(0.0002 AS DOUBLE) AS p4, round(CAST(0.5 + 0.01 * 10 - 0.02 * 20 + 0.0001 * 200 + 0.0002 * 100 AS DOUBLE), 5) AS at FROM supplier")
def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 x 50 samples of each pair with a known surface."""
    pairs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(C("s_suppkey").alias("pair_id"), (100 + C("s_suppkey") % 50).alias("n_range"), (200 + C("s_suppkey") % 70).alias("n_azimuth"))
    found = fit.fit_sv_azimuth_surface(fit.sv_sample_grid(pairs).withColumn("offset", F.expr(A17_TERMS).cast("double")))
    return found.select("pair_id", "n", *[r6(F.get("params", F.lit(k)), f"p{k}", 5) for k in range(5)], r6(fit.surface_at(C("params"), F.lit(10.0), F.lit(20.0)), "at", 5))


# ---- planes in files ----
def _plane_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Grids of 64 x 16 parts each, as a file per band, written by the tasks; a row for each grid."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        for band in ("da", "dr"):
            plane = np.full((64, 16), -2e9, ">f4")
            plane[rows["i"], rows["j"]] = rows[band]
            system, name = byte_ranges.file_system(folder)
            system.create_dir(name)
            with system.open_output_stream(f"{name}/g{key[0]}.{band}") as f:
                f.write(plane.tobytes())
        return pd.DataFrame({"id": [f"g{key[0]}"], "cells": [len(rows)]})

    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 7 <> 0")
    cells = part.select(F.expr("p_partkey div 1024").alias("g"), F.expr("cast(p_partkey % 1024 div 16 as int)").alias("i"), (C("p_partkey") % 16).cast("int").alias("j"), C("p_size").cast("double").alias("da"), C("p_retailprice").cast("double").alias("dr"))
    return cells.groupBy("g").applyInPandas(write, "id string, cells long")


@query("S9_plane_byte_ranges", """SELECT 'g' || p_partkey // 1024 AS id, CAST(p_partkey % 1024 // 16 AS INT) AS i, CAST(p_partkey % 16 AS INT) AS j, CAST(p_size AS DOUBLE) AS da, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS dr
 FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 1024 // 16 >= 3 AND p_partkey % 1024 // 16 < 50 AND p_partkey % 16 >= 2 AND p_partkey % 16 < 11""")
def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes written to the shared folder, and a box of them read in splits of ten rows."""
    folder = f"{shared_folder(spark)}/planes-{uuid.uuid4().hex}".removeprefix("file:")
    folder = "/" + folder.lstrip("/") if folder.startswith("/") else folder
    _plane_files(spark, sf_dir, folder).count()
    return byte_ranges.read_plane_files(spark, byte_ranges.grid_files(folder, 16, ("da", "dr")), ("da", "dr"), box={"i_min": 3, "i_max": 50, "j_min": 2, "j_max": 11}, split=2 * 16 * 4 * 10)


# ---- J11 on terrain ----
def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radar grid of every scene on a sloping DEM of 20 km; its nodes are those around the samples' places at height 0."""
    scenes = _scenes(spark, sf_dir)
    samples = geocode.radar_grid(scenes, 1000)
    p = geo.ll_to_xy(C("lat"), C("lon"), 45.0, 70.0)
    flat = geocode.locate(scenes, samples.withColumn("h", F.lit(0.0))).where("lat is not null").withColumn("p", p)
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    nodes = flat.select(F.floor(C("p.x") / 20).cast("int").alias("j"), F.floor(C("p.y") / 20).cast("int").alias("i")).distinct()
    dem = nodes.withColumn("di", around).withColumn("dj", around).select((C("i") + C("di")).alias("i"), (C("j") + C("dj")).alias("j")).distinct().select("i", "j", (1500 + 4.0 * C("i") - 3.0 * C("j")).alias("z"))
    return terrain.radar_grid_on_terrain(scenes, samples, dem, 45.0, 70.0, (0.0, 0.0), 20.0)


@query("J11_terrain", """SELECT s_suppkey AS scene_id, CAST(a AS DOUBLE) AS azimuth, CAST(r AS DOUBLE) AS range, true AS on_dem, true AS on_sphere, true AS quick, false AS layover
 FROM supplier, range(0, 5000, 1000) x(a), range(0, 6000, 1000) y(r)""")
def _on_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every sample lies on the DEM's plane (within 0.2 m) and, put back through J8, in its own pixel."""
    found = _terrain(spark, sf_dir).withColumn("p", geo.ll_to_xy(C("lat"), C("lon"), 45.0, 70.0))
    plane = 1500 + 4.0 * C("p.y") / 20 - 3.0 * C("p.x") / 20
    back = geocode.radar_geometry(found.select("scene_id", "sample_id", "lat", "lon", C("height").alias("h")), _scenes(spark, sf_dir), ["sample_id"])
    back = back.select("scene_id", "sample_id", C("range").alias("r2"), C("azimuth").alias("a2"))
    both = found.join(grid.sorted_in(back), ["scene_id", "sample_id"], "left")
    near = (F.abs(C("r2") - C("range")) < 0.05) & (F.abs(C("a2") - C("azimuth")) < 0.05)
    return both.select("scene_id", "azimuth", "range", F.coalesce(F.abs(C("height") - plane) < 0.2, F.lit(False)).alias("on_dem"), F.coalesce(near, F.lit(False)).alias("on_sphere"), (C("round") <= 12).alias("quick"), "layover")


ARRIVALS = "SELECT CAST(user_id % 15 AS INT) AS i, CAST(event_id % 10 AS INT) AS j, value AS vx, 1.0 + event_id % 3 AS sx FROM events"


@query("ST1_incremental_mosaic", f"WITH a AS ({ARRIVALS}) SELECT i, j, round(sum(vx / sx / sx) / sum(1 / sx / sx), 6) AS vx, count(*) AS n FROM a GROUP BY 1, 2")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the events as a stream of observations; the mosaic is read from the state it leaves."""
    from driftgrid.streaming import incremental

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = shared_folder(spark)
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    sigma = (1.0 + C("event_id") % 3).cast("double")
    obs = events.select((C("user_id") % 15).cast("int").alias("i"), (C("event_id") % 10).cast("int").alias("j"), C("value").alias("vx"), C("value").alias("vy"), sigma.alias("sx"), sigma.alias("sy"))
    incremental.start(obs, f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return incremental.current(spark, f"{at}/state").select("i", "j", r6(C("vx"), "vx"), "n")


@query("speckle_observations", "SELECT l_orderkey, l_linenumber, round(((dr + CASE WHEN code = 1 THEN da * cos(psi) * n_days / 365.25 ELSE 0 END) * 365.25 / n_days / sin(psi) + CASE WHEN code = 1 THEN 0 ELSE da * 365.25 / n_days / tan(psi) * dzda / 4 END) / (1 - CASE WHEN code = 1 THEN 0 ELSE dzdr / 4 / tan(psi) END), 4) AS vr, round(CASE WHEN code = 1 THEN sqrt(sr * sr + pow(CAST(0.1 AS DOUBLE) * cos(psi), 2)) ELSE sr END * 365.25 / n_days / sin(psi), 4) AS er FROM samples_fx", ("samples_fx",))
def _speckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture(spark, sf_dir, "samples_fx").withColumns({"dzdr": C("dzdr") / 4, "dzda": C("dzda") / 4, "tide_rate": C("da")})
    return speckle_observations(df).select(*S, r6(C("vr"), "vr", 4), r6(C("er"), "er", 4))


ORIGIN = (-1200000.0, -1500000.0)
START, END = 2458849.5, 2459029.5
OPTICAL_WEIGHT = re.sub(r"(?<![\d.])90(?![\d.])", "180", DW.replace("2449900.5", str(START)).replace("2449990.5", str(END)))
E2, E4, E6 = geo.ECC2, geo.ECC2**2, geo.ECC2**3
OPTICAL_SQL = f""", m AS (SELECT *, {OPTICAL_WEIGHT} AS weight FROM (SELECT *, jd_early AS a, jd_late AS b FROM matches_fx)),
 bx AS (SELECT *, CAST(greatest(ceil(y0 / 100), 0) AS INT) AS i_min, CAST(floor((y0 + 1500) / 100) + 1 AS INT) AS i_max, CAST(greatest(ceil(x0 / 100), 0) AS INT) AS j_min, CAST(floor((x0 + 1500) / 100) + 1 AS INT) AS j_max FROM m WHERE weight > 0.05 AND weight >= 0.5),
 ci AS (SELECT *, unnest(range(i_min, i_max)) AS i FROM bx), cj AS (SELECT *, unnest(range(j_min, j_max)) AS j FROM ci),
 pt AS (SELECT *, (j * 100 - x0) / 250 AS u, (i * 100 - y0) / 250 AS v FROM cj WHERE (i, j) NOT IN (SELECT (i, j) FROM cells_fx WHERE code = 5)),
 co AS (SELECT match_id, i, j, CAST(floor(v) AS INT) + di AS ni, CAST(floor(u) AS INT) + dj AS nj, (CASE WHEN dj = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN di = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM pt, range(0, 2) a(di), range(0, 2) b(dj)),
 of AS (SELECT co.match_id, co.i, co.j, sum(w * o.dx) AS ox, sum(w * o.dy) AS oy, sum(w * o.sx) AS px, sum(w * o.sy) AS py FROM co LEFT JOIN optical_cells_fx o ON o.match_id = co.match_id AND o.i = ni AND o.j = nj WHERE w > 0 GROUP BY 1, 2, 3 HAVING count(o.dx) = count(*)),
 g AS (SELECT of.*, bx.* EXCLUDE (match_id), of.j * 100 - (x0 + 1000) AS ux, of.i * 100 - (y0 + 1000) AS uy, sqrt(pow(({ORIGIN[0]} + of.j * 100) / 1000, 2) + pow(({ORIGIN[1]} + of.i * 100) / 1000, 2)) AS rho FROM of JOIN bx ON bx.match_id = of.match_id),
 h AS (SELECT *, pi() / 2 - 2 * atan(rho * {t_sql("radians(70.0)", ECC)} / ({geo.RADIUS_KM} * {CM70})) AS chi FROM g),
 l AS (SELECT *, chi + {E2 / 2 + 5 * E4 / 24 + E6 / 12} * sin(2 * chi) + {7 * E4 / 48 + 29 * E6 / 240} * sin(4 * chi) + {7 * E6 / 120} * sin(6 * chi) AS la FROM h),
 k AS (SELECT *, cos(la) / sqrt(1 - {geo.SCALE_ECC2} * sin(la) * sin(la)) / (1.9332279 * {t_sql("la", repr(geo.SCALE_ECC2**0.5))}) AS scale, jd_late - jd_early AS days FROM l),
 ob AS (SELECT match_id AS pair_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, i_min, i_max, j_min, j_max, weight, (ox - px0 - px1 * ux - px2 * uy) * 25 * 365.25 / days * scale AS vx, (oy - py0 - py1 * ux - py2 * uy) * 25 * 365.25 / days * scale AS vy,
  sqrt(least(greatest(pow(sigma_x_res / 25, 2) - pow(mean_sigma_x, 2), 0) + CAST(0.0025 AS DOUBLE) + px * px + (0.0001 * (1 + match_id % 3) + 2e-9 * ux + 1e-11 * ux * ux + 2e-11 * uy * uy), CAST(0.04 AS DOUBLE)) * pow(25 * 365.25 / days, 2)) AS sx,
  sqrt(least(greatest(pow(sigma_y_res / 25, 2) - pow(mean_sigma_y, 2), 0) + CAST(0.0025 AS DOUBLE) + py * py + (0.0002 - 2e-9 * uy + 1e-11 * ux * ux), CAST(0.04 AS DOUBLE)) * pow(25 * 365.25 / days, 2)) AS sy,
  0.5 * (jd_early + jd_late) - 0.5 * ({START} + {END}) AS dt, 0 AS vz FROM k)"""
OB_FEATHER = FEATHER.replace("obs_fx", "ob")
FINISHED = f", fin AS (SELECT i, j, {MEANS} FROM fe GROUP BY i, j)"
FOUR = ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in ("vx", "vy", "ex", "ey"))
IRREGULAR_SQL = ORACLE_SQL["J7_point_in_triangle"].replace("round((", "((").replace(" / twice, 5)", " / twice)").replace("SELECT set_id, tri_id, CAST(i", ", jc AS (SELECT set_id, tri_id, CAST(i", 1) + """ AND i >= 0 AND i < 2000 AND j >= 0 AND j < 20),
 ob AS (SELECT set_id AS pair_id, i, j, arg_min(vx, tri_id) AS vx, arg_min(vy, tri_id) AS vy, 200.0 AS sx, 200.0 AS sy, 1.0 AS weight, 0 AS dt, 0 AS vz, 0 AS i_min, 2000 AS i_max, 0 AS j_min, 20 AS j_max FROM jc GROUP BY 1, 2, 3)"""
query("irregular_round", IRREGULAR_SQL + OB_FEATHER + ", m AS (SELECT i, j, " + MEANS + " FROM fe GROUP BY i, j) SELECT i, j, round(CAST(vx AS DOUBLE), 4) AS vx, round(CAST(vy AS DOUBLE), 4) AS vy, round(CAST(ex AS DOUBLE), 4) AS ex, n FROM m")(
    lambda s, d: mosaic.finish(plans.irregular_sums(s.sql(TRI.replace("pairs_fx", "{p}"), p=fixture(s, d, "pairs_fx")), (0, 2000, 0, 20), max_edge=14.0, max_area=60.0)).select("i", "j", *[r6(C(c), c, 4) for c in ("vx", "vy", "ex")], "n")
)



def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the covariances of their planes."""
    m = fixture(spark, sf_dir, "matches_fx")
    cov = lambda c: F.array(*[v.cast("double") for v in c])
    n = F.lit
    return m.withColumns({
        "cx": cov([0.0001 * (1 + C("match_id") % 3), n(1e-9), n(0.0), n(1e-9), n(1e-11), n(0.0), n(0.0), n(0.0), n(2e-11)]),
        "cy": cov([n(0.0002), n(0.0), n(-1e-9), n(0.0), n(1e-11), n(0.0), n(-1e-9), n(0.0), n(0.0)]),
    })


@query("optical_mosaic", OPTICAL_SQL + OB_FEATHER + FINISHED + f" SELECT i, j, {FOUR}, n FROM (SELECT i, j, n, " + ", ".join(f"CASE WHEN abs(dt) <= ({END} - {START} + 1) / 2 + 0.49 THEN {c} END AS {c}" for c in ("vx", "vy", "ex", "ey")) + " FROM fin)", ("matches_fx", "optical_cells_fx", "cells_fx"))
def _optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optical round with dates, mask, planes and their errors, scale by latitude, feathering and weights."""
    found = optical_mosaic(_matches(spark, sf_dir), fixture(spark, sf_dir, "optical_cells_fx"), START, END, mask=fixture(spark, sf_dir, "cells_fx"), origin=ORIGIN)
    return found.select("i", "j", *[r6(C(c), c, 4) for c in ("vx", "vy", "ex", "ey")], "n")


RADAR_SQL = """, r0 AS (SELECT *, dr + CASE WHEN code = 1 THEN tide_rate * cos(psi) * n_days / 365.25 ELSE 0 END + submergence * cos(psi) * n_days / 365.25 AS d, CASE WHEN code = 1 THEN sqrt(sr * sr + pow(0.1 * cos(psi), 2)) ELSE sr END AS s FROM radar_fx WHERE code NOT IN (5, 2) AND abs(dr) < 13e4 AND abs(da) < 10e4 AND z > -1000 AND z <= 10000)"""
SPECKLE_SQL = RADAR_SQL + """, g0 AS (SELECT *, CASE WHEN z < 75 AND sqrt(dzdx * dzdx + dzdy * dzdy) > 0.05 OR z < 50 AND sqrt(dzdx * dzdx + dzdy * dzdy) > 0.03 THEN 0 ELSE greatest(least(dzdx, 0.12), -0.12) END AS gx, CASE WHEN z < 75 AND sqrt(dzdx * dzdx + dzdy * dzdy) > 0.05 OR z < 50 AND sqrt(dzdx * dzdx + dzdy * dzdy) > 0.03 THEN 0 ELSE greatest(least(dzdy, 0.12), -0.12) END AS gy, cos(heading - xy) AS c, sin(heading - xy) AS n FROM r0),
 v0 AS (SELECT *, da * 365.25 / n_days AS va, (d * 365.25 / n_days / sin(psi) + CASE WHEN code = 1 THEN 0 ELSE da * 365.25 / n_days / tan(psi) * (gx * n + gy * c) END) / (1 - CASE WHEN code = 1 THEN 0 ELSE (gx * c - gy * n) / tan(psi) END) AS vr, s * 365.25 / n_days / sin(psi) AS er, sa * 365.25 / n_days AS ea FROM g0),
 ob AS (SELECT pair_id, i, j, i_min, i_max, j_min, j_max, weight, dt, vr * c + va * n AS vx, va * c - vr * n AS vy, sqrt(er * er * c * c + ea * ea * n * n) AS sx, sqrt(er * er * n * n + ea * ea * c * c) AS sy, (vr * c + va * n) * gx + (va * c - vr * n) * gy AS vz FROM v0)"""
SIX = ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in LAYERS)
on("speckle_mosaic", ("radar_fx",), SPECKLE_SQL + OB_FEATHER + FINISHED + f" SELECT i, j, {SIX}, n FROM fin")(lambda r: plans.speckle_mosaic(r).select("i", "j", *[r6(C(c), c, 4) for c in LAYERS], "n"))
CROSSED_SQL = RADAR_SQL + f""", pq AS (SELECT *, d * 365.25 / n_days / sin(psi) AS p, s * 365.25 / n_days / sin(psi) AS e, greatest(least(dzdx, 0.1), -0.1) AS gx, greatest(least(dzdy, 0.1), -0.1) AS gy FROM r0), cr AS ({CROSS}),
 mt AS (SELECT cr.*, a.i, a.j, a.heading - b.heading AS al, a.xy - a.heading AS be, a.gx, a.gy, a.p AS pa, b.p AS pb, a.e AS ea, b.e AS eb, 0.5 * (a.dt + b.dt) AS dt, a.gx / tan(a.psi) AS b00, a.gy / tan(a.psi) AS b01, a.gx / tan(b.psi) AS b10, a.gy / tan(b.psi) AS b11 FROM cr JOIN pq a ON a.pair_id = a_pair_id JOIN pq b ON b.pair_id = b_pair_id AND b.i = a.i AND b.j = a.j WHERE a.i >= cr.i_min AND a.i < cr.i_max AND a.j >= cr.j_min AND a.j < cr.j_max),
 aa AS (SELECT *, (cos(be) - cos(al) * cos(al + be)) / pow(sin(al), 2) AS a00, (cos(al + be) - cos(al) * cos(be)) / pow(sin(al), 2) AS a01, (sin(be) - sin(al + be) * cos(al)) / pow(sin(al), 2) AS a10, (sin(al + be) - sin(be) * cos(al)) / pow(sin(al), 2) AS a11 FROM mt WHERE abs(al) >= 0.8 AND abs(al) <= 2 * pi() - 0.8),
 cc AS (SELECT *, 1 - (a00 * b00 + a01 * b10) AS c00, -(a00 * b01 + a01 * b11) AS c01, -(a10 * b00 + a11 * b10) AS c10, 1 - (a10 * b01 + a11 * b11) AS c11 FROM aa), dd AS (SELECT *, c00 * c11 - c01 * c10 AS det FROM cc),
 ee AS (SELECT *, (c11 * a00 - c01 * a10) / det AS d00, (c11 * a01 - c01 * a11) / det AS d01, (c00 * a10 - c10 * a00) / det AS d10, (c00 * a11 - c10 * a01) / det AS d11 FROM dd WHERE det >= 0.25),
 ob AS (SELECT a_pair_id * 1000000 + b_pair_id AS pair_id, i, j, i_min, i_max, j_min, j_max, weight, dt, d00 * pa + d01 * pb AS vx, d10 * pa + d11 * pb AS vy, sqrt(pow(d00 * ea, 2) + pow(d01 * eb, 2)) AS sx, sqrt(pow(d10 * ea, 2) + pow(d11 * eb, 2)) AS sy, (d00 * pa + d01 * pb) * gx + (d10 * pa + d11 * pb) * gy AS vz FROM ee)"""
on("crossing_mosaic", ("radar_fx", "pairs_fx"), CROSSED_SQL + OB_FEATHER + FINISHED + f" SELECT i, j, {SIX}, n FROM fin")(lambda r, p: plans.crossing_mosaic(r, p).select("i", "j", *[r6(C(c), c, 4) for c in LAYERS], "n"))


FOLD_SUMS = "sum(vx * f * weight / sx / sx) AS vxs, sum(f * weight / sx / sx) AS xs, sum(f * f * weight * weight / sx / sx) AS xe, sum(vy * f * weight / sy / sy) AS vys, sum(f * weight / sy / sy) AS ys, sum(f * f * weight * weight / sy / sy) AS ye"
FOLD_SQL = CROSSED_SQL + OB_FEATHER + f", one AS MATERIALIZED (SELECT i, j, {FOLD_SUMS} FROM fe GROUP BY i, j)"
SECOND_SQL = SPECKLE_SQL.replace(RADAR_SQL, "").replace("ob AS (", "ob2 AS (") + OB_FEATHER.replace(" ob ", " ob2 ").replace("e AS (", "e2 AS (").replace("fe2 AS (", "fe2 AS (").replace("FROM e WHERE e.pair_id", "FROM e2 e WHERE e.pair_id").replace(", fe AS", ", fe2 AS") + f", two AS (SELECT i, j, {FOLD_SUMS} FROM fe2 GROUP BY i, j)"
THIRD_SQL = """, ed AS (SELECT x.i, x.j FROM one x JOIN one y ON abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 GROUP BY x.i, x.j HAVING count(*) < (least(x.i + 1, 99) - greatest(x.i - 1, 0) + 1) * (least(x.j + 1, 19) - greatest(x.j - 1, 0) + 1)),
 rf AS (SELECT one.*, coalesce((SELECT min(least(greatest(sqrt(pow(one.i - ed.i, 2) + pow(one.j - ed.j, 2)), 0.5) / 2, 1)) FROM ed WHERE abs(ed.i - one.i) <= 2 AND abs(ed.j - one.j) <= 2), 1) AS f FROM one),
 un AS (SELECT i, j, vxs * f AS vxs, xs * f AS xs, xe * f * f AS xe, vys * f AS vys, ys * f AS ys, ye * f * f AS ye FROM rf UNION ALL SELECT * FROM two)
 SELECT i, j, round(CAST(sum(vxs) / sum(xs) AS DOUBLE), 4) AS vx, round(CAST(sum(vys) / sum(ys) AS DOUBLE), 4) AS vy, round(CAST(sum(xe) / pow(sum(xs), 2) AS DOUBLE), 4) AS ex, round(CAST(sum(ye) / pow(sum(ys), 2) AS DOUBLE), 4) AS ey FROM un GROUP BY 1, 2"""
on("velocity_mosaic", ("radar_fx", "pairs_fx"), FOLD_SQL + SECOND_SQL + THIRD_SQL)(
    lambda r, p: plans.velocity_mosaic([plans.crossing_sums(r, p), plans.speckle_sums(r)], 2, (0, 100, 0, 20)).select("i", "j", *[r6(C(c), c, 4) for c in ("vx", "vy", "ex", "ey")])
)


# the queries of the readers fill the same registry
from driftgrid.plans import source_queries  # noqa: E402, F401
