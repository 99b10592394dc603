"""Queries of the readers and of what lies around them: tasks write the driver tables as files of each layout into the shared folder, the reader reads the files, and SQL says what the tables hold.

Imported by queries.py, whose registry it fills.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid.operators import geocode, sampling
from driftgrid.plans import queries as q
from driftgrid.plans.fixtures import fixture
from driftgrid.sources import byte_ranges, rasters, sinks, text
from driftgrid.stages import shared_folder

C = F.col
#: Lines of a list file, and rows of a plane of 16 columns.
LINES, ROWS = 256, 64


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def write_files(files: DataFrame, folder: str) -> str:
    """files(file, text or content) into the folder, by tasks; a file may be under further folders."""

    def write(batches):
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf.iloc[:, 1], strict=True):
                system, at = byte_ranges.file_system(f"{folder}/{name}")
                system.create_dir(at.rpartition("/")[0])
                with system.open_output_stream(at) as f:
                    f.write(content.encode() if isinstance(content, str) else content)
            yield pd.DataFrame({"n": [len(pdf)]})

    files.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spaced(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def listed(rows: DataFrame, key: str, line: Column, stem: str, head: str = "; a list", tail: str = "&\nnever read at all") -> DataFrame:
    """rows as files of LINES lines each, in the order of the key."""
    own = rows.select(F.concat(F.lit(stem), F.expr(f"{key} div {LINES}"), F.lit(".txt")).alias("file"), F.struct(key, line.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return own.groupBy("file").agg(F.concat_ws("\n", F.lit(head), body, F.lit(tail)).alias("text"))


def base(c: str = "file") -> Column:
    return F.regexp_extract(c, "([^/]+)$", 1)


def below(c: str, folder: str) -> Column:
    """A path without what leads to the folder."""
    return F.regexp_replace(c, rf"^.*/{folder.rpartition('/')[2]}/", "")


def place(by: Column, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long").alias("place")


# ---- lists ----
@q.query("S2_image_list", f"""SELECT 'images' || c_custkey // {LINES} || '.txt' AS file, row_number() OVER (PARTITION BY c_custkey // {LINES} ORDER BY c_custkey) AS place, 'img' || c_custkey AS image_path, 'geo' || c_custkey AS geodat_path,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(0.75 AS DOUBLE) ELSE 1 END AS weight, CASE WHEN c_custkey % 8 = 0 THEN 'ALOS.pat' WHEN c_custkey % 8 = 4 THEN 'my.poly' END AS antenna_pattern FROM customer WHERE c_custkey % 11 <> 0""")
def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one field are no images; patterns are those with poly or alos in their names."""
    k = C("c_custkey")
    pattern = F.when(k % 8 == 0, "ALOS.pat").when(k % 8 == 4, "my.poly").otherwise("none.pat")
    full = spaced(F.concat(F.lit("img"), k), F.concat(F.lit("geo"), k), F.when(k % 2 == 0, spaced("0.75", pattern)), F.when(k % 3 == 0, "; note"))
    files = listed(table(spark, sf_dir, "customer"), "c_custkey", F.when(k % 11 == 0, F.lit("alone")).otherwise(full), "images")
    rows = text.read_image_list(spark, write_files(files, new_folder(spark, "images")))
    return rows.select(base().alias("file"), place(C("file"), "input_seq"), "image_path", "geodat_path", "weight", "antenna_pattern")


@q.query("S3_optical_list", f"""SELECT 'optical' || p_partkey // {LINES} || '.txt' AS file, row_number() OVER (PARTITION BY p_partkey // {LINES} ORDER BY p_partkey) AS place, 'm' || p_partkey AS match_path,
 CASE WHEN p_partkey % 3 = 0 THEN 'f' || p_partkey ELSE 'm' || p_partkey || '.fit' END AS fit_path, CASE WHEN p_partkey % 6 = 0 AND p_partkey % 12 <> 0 THEN 'mask' || p_partkey END AS mask_path FROM part""")
def _optical_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the fit is the match's own where it isn't named; the mask may be missing or none."""
    k = C("p_partkey")
    mask = F.when(k % 12 == 0, F.lit("none")).when(k % 6 == 0, F.concat(F.lit("mask"), k))
    files = listed(table(spark, sf_dir, "part"), "p_partkey", spaced(F.concat(F.lit("m"), k), F.when(k % 3 == 0, F.concat(F.lit("f"), k)), mask, F.when(k % 5 == 0, "; seen")), "optical")
    rows = text.read_optical_list(spark, write_files(files, new_folder(spark, "optical")))
    return rows.select(base().alias("file"), place(C("file"), "input_seq"), "match_path", "fit_path", "mask_path")


TURNED = "radians(CAST(point_id * 7 % 360 AS DOUBLE)) + pi() - atan2(-y, -x)"


@q.query("S4_irregular_points", f""", p AS (SELECT point_id, {q.RHO} * sin(radians(lon + 45)) AS x, -{q.RHO} * cos(radians(lon + 45)) AS y, CAST(10 + point_id % 90 AS DOUBLE) AS speed FROM points_fx)
 SELECT 'set' || point_id // {LINES} AS set_id, CAST(speed AS BIGINT) AS speed, round(x, 4) AS x, round(y, 4) AS y, round(speed * cos({TURNED}), 4) AS vx, round(-speed * sin({TURNED}), 4) AS vy FROM p""", ("points_fx",))
def _irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the projection, and the bearing turned to the grid."""
    k = C("point_id")
    line = F.format_string("%.2f %.2f %d %d", "lat", "lon", 10 + k % 90, k * 7 % 360)
    folder = write_files(listed(fixture(spark, sf_dir, "points_fx"), "point_id", line, "set"), new_folder(spark, "irregular"))
    rows = text.read_irregular_points(spark, folder, False, 45.0, 70.0)
    return rows.select(F.regexp_extract("set_id", r"([^/]+)\.txt$", 1).alias("set_id"), C("speed").cast("long").alias("speed"), *[q.r6(C(c), c, 4) for c in ("x", "y", "vx", "vy")])


# ---- headers ----
PATHS = "CASE WHEN s_suppkey % 4 = 0 THEN '/abs/{0}' || s_suppkey WHEN s_suppkey % 4 = 1 THEN 'dat/{0}' || s_suppkey END"


@q.query("S8_offset_headers", f"""SELECT 'p' || s_suppkey AS pair_id, CAST(s_suppkey + 5 AS INT) AS r0, 12 AS a0, 300 AS nr, 400 AS na, CAST(24 AS DOUBLE) AS delta_r, CAST(18.5 AS DOUBLE) AS delta_a,
 CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0.25 WHEN s_suppkey % 3 = 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS sigma_streaks, CAST(CASE WHEN s_suppkey % 6 = 1 THEN 0.125 ELSE 0 END AS DOUBLE) AS sigma_range,
 CASE WHEN s_suppkey % 3 = 0 THEN 'v' || s_suppkey ELSE {PATHS.format("g")} END AS geo1, CASE WHEN s_suppkey % 3 = 0 THEN 'w' || s_suppkey ELSE {PATHS.format("h")} END AS geo2 FROM supplier""")
def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of 6, 7 and 8 numbers, with paths that are relative, whole or missing; of pairs that have a virtual raster too, that one counts."""
    k = C("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    numbers = spaced((k + 5), "12 300 400 24 18.5", F.when(k % 3 == 1, "0.5"), F.when(k % 6 == 1, "0.125"))
    pair = lambda a: spaced(F.concat(F.lit(f"{a}g"), k), F.concat(F.lit(f"{a}h"), k))
    dats = rows.select(F.concat(F.lit("dat/p"), k, F.lit(".dat")).alias("file"), F.concat_ws("\n", numbers, F.when(k % 4 == 0, pair("/abs/")).when(k % 4 == 1, pair(""))).alias("text"))
    key = lambda n, v: F.concat(F.lit(f'<MDI key="{n}">'), F.lit(v) if isinstance(v, str) else v.cast("string"), F.lit("</MDI>"))
    body = F.concat_ws("\n", F.lit('<VRTDataset rasterXSize="300" rasterYSize="400"><Metadata>'), key("r0", k + 5), key("a0", "12"), key("deltaR", "24"), key("deltaA", "18.5"), key("sigmaStreaks", "0.25"), key("geo1", F.concat(F.lit("v"), k)), key("geo2", F.concat(F.lit("w"), k)), F.lit("</Metadata></VRTDataset>"))
    vrts = rows.where(k % 3 == 0).select(F.concat(F.lit("vrt/p"), k, F.lit(".vrt")).alias("file"), body.alias("text"))
    folder = write_files(dats.unionByName(vrts), new_folder(spark, "headers"))
    found = text.prefer(text.read_offset_vrts(spark, f"{folder}/vrt"), text.read_offset_headers(spark, f"{folder}/dat"), "pair_id")
    return found.drop("file").withColumns({c: below(c, folder) for c in ("geo1", "geo2")})


@q.query("S11_optical_matches", """SELECT CAST(match_id AS VARCHAR) AS match_id, x0, y0, dx, dy, nx, ny, step_x, step_y, 3413 AS epsg, jd_early, jd_late, jd_late - jd_early AS delta_t, mean_sigma_x, CASE WHEN match_id % 2 = 0 THEN mean_sigma_y END AS mean_sigma_y FROM matches_fx""", ("matches_fx",))
def _match_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with keys in any case, one of them twice and one missing."""
    names = {"x0": "x0", "y0": "Y0", "dx": "dx", "dy": "DY", "nx": "nx", "ny": "ny", "step_x": "stepX", "step_y": "stepY", "jd_early": "EarlyImageJD", "jd_late": "LateImageJD", "mean_sigma_x": "Mean_sigmaX"}
    lines = [F.concat(F.lit(f"{n} = "), C(c).cast("string")) for c, n in names.items()]
    lines += [F.lit("EPSG=3413"), F.lit("x0 = -1"), F.concat(F.lit("IntervalBetweenImages = "), (C("jd_late") - C("jd_early")).cast("string")), F.when(C("match_id") % 2 == 0, F.concat(F.lit("mean_sigmaY = "), C("mean_sigma_y").cast("string")))]
    files = fixture(spark, sf_dir, "matches_fx").select(F.concat(C("match_id").cast("string"), F.lit(".dat")).alias("file"), F.concat_ws("\n", *lines).alias("text"))
    return text.read_optical_matches(spark, write_files(files, new_folder(spark, "matches"))).drop("file")


@q.query("S12_optical_fits", """SELECT CAST(match_id AS VARCHAR) AS match_id, px0, px1, px2, py0, py2, sigma_x_res, sigma_y_res, CAST(9 AS BIGINT) AS n_cx, CAST(match_id AS DOUBLE) AS cx1, CAST(-0.25 AS DOUBLE) AS cx5, CAST(1e-9 AS DOUBLE) AS cy9 FROM matches_fx""", ("matches_fx",))
def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes, residual sigmas and covariances."""
    n = lambda c: C(c).cast("string")
    lines = [spaced("Xfit =", n("px0"), n("px1"), n("px2")), spaced("Yfit =", n("py0"), n("py1"), n("py2")), spaced("X_residual = 10 20", n("sigma_x_res")), spaced("Y_residual = 10 20", n("sigma_y_res")),
             spaced("CX_1 =", n("match_id"), "0 0"), F.lit("CX_2 = 0 -0.25 0"), F.lit("CX_3 = 0 0 1"), F.lit("CY_1 = 1 0 0"), F.lit("CY_2 = 0 1 0"), F.lit("CY_3 = 0 0 1e-9")]
    files = fixture(spark, sf_dir, "matches_fx").select(F.concat(n("match_id"), F.lit(".fit")).alias("file"), F.concat_ws("\n", *lines).alias("text"))
    rows = text.read_optical_fits(spark, write_files(files, new_folder(spark, "fits")))
    at = lambda c, k, a: F.get(c, F.lit(k)).alias(a)
    return rows.select("match_id", *[at("px", k, f"px{k}") for k in range(3)], at("py", 0, "py0"), at("py", 2, "py2"), "sigma_x_res", "sigma_y_res", F.size("cx").cast("long").alias("n_cx"), at("cx", 0, "cx1"), at("cx", 4, "cx5"), at("cy", 8, "cy9"))


@q.query("S13_fit_params", """SELECT 'p' || s_suppkey AS pair_id, CASE WHEN s_suppkey % 2 = 0 THEN 'deltabp' ELSE 'none' END AS mode, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + s_suppkey AS DOUBLE) AS bn, CAST(-3.5 AS DOUBLE) AS const,
 CASE WHEN s_suppkey % 3 <> 0 THEN CAST(36 AS BIGINT) END AS n_cov, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(6 AS DOUBLE) END AS last, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(0.125 AS DOUBLE) END AS sigma_res FROM supplier""")
def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter files of a mode where there are some, else the base files; some without a covariance."""
    k = C("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("suffix", F.explode(F.when(k % 2 == 0, F.array(F.lit(""), F.lit(".deltabp"), F.lit(".quad"))).otherwise(F.array(F.lit(""), F.lit(".quad")))))
    covariance = F.when(k % 3 != 0, F.concat_ws("\n", F.lit("; sigma*sqrt(X2/n)= 0.125"), *[F.lit(f"; C_{a} = " + " ".join(str(a if b == a else 0) for b in range(1, 7))) for a in range(1, 7)]))
    bn = k + F.when(C("suffix") == "", 0).when(C("suffix") == ".deltabp", 1).otherwise(2)
    files = rows.select(F.concat(F.lit("p"), k, C("suffix")).alias("file"), F.concat_ws("\n", F.lit("; a fit"), covariance, spaced(bn, "10 0 0.5 -3.5 0 0"), F.lit("&")).alias("text"))
    found = text.read_fit_params(spark, write_files(files, new_folder(spark, "params")), "range", "deltabp")
    return found.select("pair_id", "mode", F.get("params", F.lit(0)).alias("bn"), F.get("params", F.lit(4)).alias("const"), F.when(C("cov").isNotNull(), F.size("cov")).cast("long").alias("n_cov"), F.get("cov", F.lit(35)).alias("last"), "sigma_res")


@q.query("S13_pair_modes", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'quad' WHEN s_suppkey % 4 = 2 THEN 'deltabp' ELSE 'none' END AS mode FROM supplier""")
def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in the folders of pairs; with both, quad counts."""
    k = C("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    marks = rows.where(k % 2 == 0).select(F.concat(F.lit("pair"), k, F.lit("/motion/use.")).alias("at"), F.explode(F.when(k % 4 == 0, F.array(F.lit("deltabp"), F.lit("quad"))).otherwise(F.array(F.lit("deltabp")))).alias("m"))
    folder = write_files(marks.select(F.concat("at", "m").alias("file"), F.lit("1").alias("text")), new_folder(spark, "modes"))
    flags = spark.read.format("binaryFile").load(f"{folder}/*/motion").select(F.concat(F.lit("/"), below("path", folder)).alias("file"))
    return text.with_pair_modes(rows.withColumn("geodat_path", F.concat(F.lit("/pair"), k, F.lit("/geodat"))), flags).select("s_suppkey", "mode")


@q.query("S19_sidecars", """SELECT 's' || s_suppkey AS scene_id, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 4 ELSE 0 END AS DOUBLE) AS tide_correction, s_suppkey % 3 = 0 AS has_tide_difference,
 CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 200 + s_suppkey % 700 END AS DOUBLE) AS beta_nought FROM supplier""")
def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the files are missing; values of beta nought out of bounds don't count."""
    k = C("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    one = lambda when, name, value: rows.where(when).select(F.concat(F.lit("s"), k, F.lit(f"/{name}")).alias("file"), value.cast("string").alias("text"))
    files = one(k >= 0, "betaNought", F.when(k % 5 == 0, 20000.0).otherwise(200.0 + k % 700)).unionByName(one(k % 2 == 0, "tide.correction", k / 4)).unionByName(one(k % 3 == 0, "tide.difference", F.lit("x")))
    return text.read_sidecars(spark, write_files(files, new_folder(spark, "sidecars")) + "/*")


@q.query("S19_antenna_patterns", f"SELECT 'poly' || p_partkey // {LINES} || '.txt' AS pattern_id, CAST(row_number() OVER (PARTITION BY p_partkey // {LINES} ORDER BY p_partkey) - 1 AS INT) AS n, CAST(p_partkey AS DOUBLE) AS range, CAST(p_size AS DOUBLE) / 4 AS gain FROM part")
def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antenna patterns, a row for each part."""
    files = listed(table(spark, sf_dir, "part"), "p_partkey", spaced(C("p_partkey"), C("p_size") / 4), "poly")
    return text.read_antenna_patterns(spark, write_files(files, new_folder(spark, "patterns")))


BASELINES = """SELECT 'p' || s_suppkey AS pair_id, CAST(CASE WHEN s_suppkey % 4 = 3 THEN -7 WHEN s_suppkey % 2 = 0 THEN 2 * s_suppkey + 1 ELSE s_suppkey END AS DOUBLE) AS bn, CAST(CASE WHEN s_suppkey % 4 = 3 THEN 1 WHEN s_suppkey % 2 = 0 THEN 20 ELSE 10 END AS DOUBLE) AS bp,
 CAST(CASE WHEN s_suppkey % 4 = 3 THEN 2 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0.5 END AS DOUBLE) AS dbn, CAST({0} AS DOUBLE) AS dbp, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0.125 ELSE 0 END AS DOUBLE) AS dbnq, CAST({1} AS DOUBLE) AS omega FROM supplier"""
OWN_RATE = "CASE WHEN s_suppkey % 4 = 3 THEN {0} WHEN s_suppkey % 2 = 0 THEN {1} ELSE {2} END"


def _baselines(omega: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = C("s_suppkey")
        rows = table(spark, sf_dir, "supplier")
        first = rows.where(k % 4 != 3).select(F.concat(F.lit("p"), k, F.lit("/first")).alias("file"), F.concat_ws("\n", F.lit("; one"), spaced(k, "10 0.5 0.25")).alias("text"))
        second = rows.where(k % 2 == 0).select(F.concat(F.lit("p"), k, F.lit("/second")).alias("file"), spaced(k + 1, "10 0.5 0.25 0.125 0").alias("text"))
        initial = rows.select(F.concat(F.lit("p"), k).alias("pair_id"), *[F.lit(v).alias(c) for c, v in (("bn", -7.0), ("bp", 1.0), ("dbn", 2.0), ("dbp", 3.0))])
        found = text.read_flattening_baselines(spark, write_files(first.unionByName(second), new_folder(spark, "baselines")) + "/*", omega, initial)
        return found.drop("dbpq")

    return run


q.query("S20_flattening_baselines", BASELINES.format(OWN_RATE.format(3, 0.5, 0.25), 0))(_baselines(False))
q.query("S20_flattening_omega", BASELINES.format(OWN_RATE.format(3, 0, 0), OWN_RATE.format(0, 0.5, 0.25)))(_baselines(True))


# ---- points ----
@q.query("S17_tie_points", f"""SELECT m.mode, 'ties' || c_custkey // {LINES} || '.txt' AS file, CAST(c_custkey AS DOUBLE) AS lat, CAST(c_custkey % 360 AS DOUBLE) AS lon, CAST(-12.5 AS DOUBLE) AS z,
 CASE WHEN m.mode = 'vr' THEN CAST(4 AS DOUBLE) END AS vr, CASE WHEN m.mode = 'motion' THEN CAST(6 AS DOUBLE) END AS vz, CASE WHEN m.mode = 'motion' THEN CASE WHEN c_custkey % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE 1 END WHEN m.mode = 'vr' THEN CAST(5 AS DOUBLE) END AS weight
 FROM customer, (VALUES ('height'), ('motion'), ('vr')) m(mode) WHERE m.mode = 'height' OR c_custkey % 7 <> 0""")
def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the three modes; rows with too few numbers are left out, a missing weight is 1."""
    k = C("c_custkey")
    out = []
    for mode, rest in (("height", None), ("motion", F.when(k % 7 != 0, spaced("4 5 6", F.when(k % 3 == 0, "0.5")))), ("vr", F.when(k % 7 != 0, F.lit("4 5")))):
        line = spaced(k, k % 360, "-12.5", *([] if rest is None else [rest]), F.when(k % 4 == 0, "; seen"))
        folder = write_files(listed(table(spark, sf_dir, "customer"), "c_custkey", line, "ties"), new_folder(spark, mode))
        found = text.read_tie_points(spark, folder, mode)
        out.append(found.select(F.lit(mode).alias("mode"), base().alias("file"), "lat", "lon", "z", *[(C(c) if c in found.columns else F.lit(None).cast("double")).alias(c) for c in ("vr", "vz", "weight")]))
    return out[0].unionByName(out[1]).unionByName(out[2])


@q.query("S18_ll_points", f""", p AS (SELECT point_id, lat, lon, CASE WHEN point_id % 3 = 0 THEN CAST(point_id - 300 AS DOUBLE) ELSE 5 * (({q.RHO} * sin(radians(lon + 45)) + 4000) / 900) * ((4000 - {q.RHO} * cos(radians(lon + 45))) / 900) - 60 END AS z FROM points_fx)
 SELECT 'points' || point_id // {LINES} || '.txt' AS file, lat, lon, CASE WHEN z >= 0 THEN round(z, 4) END AS z, z >= 0 AS valid FROM p""", ("points_fx",))
def _ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of two points in three come from a DEM that is bilinear within its cells (nodes are parts); those below 0 aren't valid."""
    k = C("point_id")
    line = F.concat_ws(" ", F.format_string("%.2f %.2f", "lat", "lon"), F.when(k % 3 == 0, (k - 300).cast("string")))
    folder = write_files(listed(fixture(spark, sf_dir, "points_fx"), "point_id", line, "points"), new_folder(spark, "points"))
    dem = fixture(spark, sf_dir, "cells_fx").select("i", "j", (5.0 * C("i") * C("j") - 60).alias("z"))
    rows = text.read_ll_points(spark, folder, dem, 45.0, 70.0, (-4000.0, -4000.0), 900.0)
    return rows.select(base().alias("file"), "lat", "lon", q.r6(C("z"), "z", 4), "valid")


# ---- planes ----
def _planes(spark: SparkSession, sf_dir: str, bands: dict[str, Column], stem: str, kind: str = ">f4", empty: float = -2e9, suffix: str = ".") -> DataFrame:
    """Planes of ROWS x 16 parts as files(file, content), one for each band; every seventh part is no-data."""

    names = list(bands)

    def made(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for band in names:
            plane = np.full((ROWS, 16), empty, kind)
            plane[rows["i"], rows["j"]] = rows[band]
            out.append((f"{stem}{key[0]}{suffix}{band}", plane.tobytes()))
        return pd.DataFrame(out, columns=["file", "content"])

    k, size = "p_partkey", ROWS * 16
    part = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0")
    cells = part.select(F.expr(f"{k} div {size}").alias("g"), F.expr(f"cast({k} % {size} div 16 as int)").alias("i"), (C(k) % 16).cast("int").alias("j"), *[c.cast("double").alias(b) for b, c in bands.items()])
    return cells.groupBy("g").applyInPandas(made, "file string, content binary")


PLANE = f"p_partkey // {ROWS * 16}"
PLACES = f"CAST(p_partkey % {ROWS * 16} // 16 AS INT) AS i, CAST(p_partkey % 16 AS INT) AS j"
REAL = "CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE)"


@q.query("S10_radar_images", f"SELECT 'phase' || {PLANE} AS id, {PLACES}, {REAL} AS value FROM part WHERE p_partkey % 7 <> 0")
def _radar_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase planes; those named nophase have no cells."""
    files = _planes(spark, sf_dir, {"f4": C("p_retailprice")}, "phase")
    none = files.select(F.regexp_replace("file", "^phase", "nophase").alias("file"), "content")
    return rasters.read_radar_images(spark, write_files(files.unionByName(none), new_folder(spark, "phase")), 16)


@q.query("S11_optical_cells", f"SELECT 'm' || {PLANE} AS match_id, {PLACES}, CAST(p_size AS DOUBLE) AS dx, {REAL} AS dy, CAST(1 AS DOUBLE) AS sx, CASE WHEN p_size > 3 THEN CAST(p_size AS DOUBLE) / 8 END AS sy FROM part WHERE p_partkey % 7 <> 0 AND p_size % 5 <> 0")
def _optical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four planes of a match; where the byte mask is 0 all four are no-data, a plane may lack cells of its own."""
    sy = F.when(C("p_size") > 3, C("p_size") / 8).otherwise(-2e9)
    cells = write_files(_planes(spark, sf_dir, {"dx": C("p_size"), "dy": C("p_retailprice"), "sx": F.lit(1.0), "sy": sy}, "m"), new_folder(spark, "optical-cells"))
    masks = write_files(_planes(spark, sf_dir, {"mask": (C("p_size") % 5 != 0).cast("int")}, "m", "u1", 1), new_folder(spark, "optical-masks"))
    mask = rasters.read_planes(spark, masks, 16, "u1", no_data=-1.0).withColumnRenamed("id", "match_id")
    return rasters.read_optical_cells(spark, cells, 16, mask)


@q.query("S14_grids", f"""SELECT 'dem' || {PLANE} AS grid_id, CAST(CASE WHEN {PLANE} % 2 = 0 THEN {ROWS - 1} - p_partkey % {ROWS * 16} // 16 ELSE p_partkey % {ROWS * 16} // 16 END AS INT) AS i, CAST(p_partkey % 16 AS INT) AS j, {REAL} AS z,
 CAST(0.25 AS DOUBLE) AS dy, CASE WHEN {PLANE} % 2 = 0 THEN CAST(100 - {ROWS - 1} * 0.25 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS origin_y, CAST(45 AS DOUBLE) AS rot FROM part WHERE p_partkey % 7 <> 0""")
def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids and their headers; every second one runs from the top and is turned round."""
    planes = _planes(spark, sf_dir, {"f4": C("p_retailprice")}, "dem")
    g = F.regexp_extract("file", r"(\d+)\.f4$", 1).cast("int")
    headers = planes.select(F.concat(F.lit("dem"), g, F.lit(".hdr")).alias("file"), F.concat_ws("\n", F.lit(f"nx = 16\nny = {ROWS}\nx0 = -50000\ny0 = 100000\ndx = 500\nEPSG = 3413"), F.when(g % 2 == 0, "dy = -250").otherwise("dy = 250")).alias("text"))
    head = rasters.read_grid_headers(spark, write_files(headers, new_folder(spark, "grid-headers")))
    cells = rasters.read_grids(spark, write_files(planes, new_folder(spark, "grids")), head)
    return cells.join(head.select("grid_id", "dy", "origin_y", "rot"), "grid_id")


@q.query("S15_velocity_grids", f"SELECT 'v' || {PLANE} AS grid_id, {PLACES}, CAST(p_size AS DOUBLE) AS vx, {REAL} AS vy, CAST(2 AS DOUBLE) AS ex, CASE WHEN p_size > 3 THEN CAST(3 AS DOUBLE) END AS ey FROM part WHERE p_partkey % 7 <> 0 AND p_size % 5 <> 0 AND p_partkey % {ROWS * 16} // 16 BETWEEN 5 AND 39 AND p_partkey % 16 BETWEEN 2 AND 12")
def _velocity_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference velocities with errors, cropped; a cell without both velocities has no row."""
    vx = F.when(C("p_size") % 5 != 0, C("p_size")).otherwise(-2e9)
    files = _planes(spark, sf_dir, {"vx": vx, "vy": C("p_retailprice"), "ex": F.lit(2.0), "ey": F.when(C("p_size") > 3, 3.0).otherwise(-2e9)}, "v")
    return rasters.crop(rasters.read_velocity_grids(spark, write_files(files, new_folder(spark, "velocity")), 16, True), 5, 40, 2, 13)


@q.query("S16_masks", f"SELECT 'shelf' || {PLANE} AS id, {PLACES}, CAST(CASE WHEN p_size < 4 THEN 5 WHEN p_size < 8 THEN 1 WHEN p_size < 10 THEN 2 ELSE 0 END AS DOUBLE) AS code FROM part WHERE p_partkey % 7 <> 0")
def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of byte classes, where 0 is a class; 255 stands where there is no part."""
    code = F.when(C("p_size") < 4, 5).when(C("p_size") < 8, 1).when(C("p_size") < 10, 2).otherwise(0)
    files = _planes(spark, sf_dir, {"mask": code}, "shelf", "u1", 255)
    return rasters.read_planes(spark, write_files(files, new_folder(spark, "masks")), 16, "u1", ("code",), no_data=-1.0).where("code <> 255")


# ---- sinks, slopes and kernels ----
@q.query("K7_radar_grid_layers", """SELECT i, j, CAST(60 + i * 0.01 AS DOUBLE) AS lat, CAST(CASE WHEN code = 5 THEN -2e9 ELSE j * 0.5 END AS DOUBLE) AS lon, CAST(CASE WHEN code IN (1, 5) THEN -2e9 ELSE z END AS DOUBLE) AS height, code AS mask FROM cells_fx WHERE i BETWEEN 3 AND 1299 AND j BETWEEN 2 AND 18""", ("cells_fx",))
def _radar_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: layers of a radar grid written by tile, and a crop of them read back."""
    cells = fixture(spark, sf_dir, "cells_fx")
    layers = sinks.radar_grid_layers(cells.select("i", "j", (60 + C("i") * 0.01).alias("lat"), F.when(C("code") != 5, C("j") * 0.5).alias("lon"), F.when(~C("code").isin(1, 5), C("z")).alias("height"), C("code").alias("mask")))
    folder = new_folder(spark, "radar-layers")
    sinks.write_tiles(layers, folder)
    return rasters.crop(spark.read.parquet(folder), 3, 1300, 2, 19).drop("ti", "tj")


@q.query("K2_product_meta", """, m AS (SELECT pair_id, jd1, n_days, sqrt(pow(-1200 + CAST(j_min + j_max AS DOUBLE) / 2 * 0.5, 2) + pow(-1500 + CAST(i_min + i_max AS DOUBLE) / 2 * 0.5, 2)) AS rho, atan2(-1200 + CAST(j_min + j_max AS DOUBLE) / 2 * 0.5, 1500 - CAST(i_min + i_max AS DOUBLE) / 2 * 0.5) AS o FROM pairs_fx WHERE pair_id IN (SELECT pair_id FROM obs_fx)),
"""
+ f""" h AS (SELECT *, pi() / 2 - 2 * atan(rho * {q.t_sql("radians(70.0)", q.ECC)} / ({q.geo.RADIUS_KM} * {q.CM70})) AS chi FROM m)
 SELECT pair_id, jd1 + n_days / 2 AS central_jd, n_days, CASE pair_id % 3 WHEN 0 THEN 'Sentinel-1A' WHEN 1 THEN 'Landsat 8' ELSE 'unknown' END AS sensor, printf('%02d:%02d:%02d', pair_id * 97 % 86400 // 3600, pair_id * 97 % 3600 // 60, pair_id * 97 % 60) AS nominal_time,
 round(degrees(chi + {q.E2 / 2 + 5 * q.E4 / 24 + q.E6 / 12} * sin(2 * chi) + {7 * q.E4 / 48 + 29 * q.E6 / 240} * sin(4 * chi) + {7 * q.E6 / 120} * sin(6 * chi)), 5) AS lat, round(CASE WHEN degrees(o) - 45 < 0 THEN degrees(o) + 315 ELSE degrees(o) - 45 END, 5) AS lon,
 CASE pair_id % 3 WHEN 0 THEN 's1a_' WHEN 1 THEN 'LC08_' ELSE 'other_' END || pair_id AS source FROM h""", ("pairs_fx", "obs_fx"))
def _product_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: sensor, time of day and the centre's place for each used pair."""
    pairs = fixture(spark, sf_dir, "pairs_fx")
    k = C("pair_id")
    labels = pairs.select("pair_id", F.concat(F.when(k % 3 == 0, "s1a_").when(k % 3 == 1, "LC08_").otherwise("other_"), k).alias("label"), (k * 97 % 86400 + 0.5).alias("second"))
    found = sinks.product_meta(sinks.mosaic_meta(pairs, fixture(spark, sf_dir, "obs_fx")), labels, (-1200.0, -1500.0, 0.5, 0.5), False, 45.0, 70.0)
    return found.select("pair_id", "central_jd", "n_days", "sensor", "nominal_time", q.r6(C("lat"), "lat", 5), q.r6(C("lon"), "lon", 5), "source")


@q.query("W4_dem_slope_at", """, p AS (SELECT i, j, j + 0.25 AS u, i + 0.5 AS v FROM cells_fx),
 en AS (SELECT i, j, k, u + CASE k WHEN 0 THEN 0.9 WHEN 1 THEN -0.9 ELSE 0 END AS u, v + CASE k WHEN 2 THEN 0.5 WHEN 3 THEN -0.5 ELSE 0 END AS v FROM p, range(4) x(k)),
 co AS (SELECT en.*, CAST(floor(v) AS INT) + di AS ni, CAST(floor(u) AS INT) + dj AS nj, (CASE WHEN dj = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN di = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM en, range(2) a(di), range(2) b(dj)),
 z AS (SELECT co.i, co.j, k, sum(w * c.z) AS z FROM co LEFT JOIN cells_fx c ON c.i = ni AND c.j = nj WHERE w > 0 GROUP BY 1, 2, 3 HAVING count(c.z) = count(*))
 SELECT p.i * 20 + p.j AS place, round((max(CASE k WHEN 0 THEN z END) - max(CASE k WHEN 1 THEN z END)) / 90, 5) AS dzdx, round((max(CASE k WHEN 2 THEN z END) - max(CASE k WHEN 3 THEN z END)) / 200, 5) AS dzdy FROM p LEFT JOIN z ON z.i = p.i AND z.j = p.j GROUP BY 1""", ("cells_fx",))
def _slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes at places between the nodes, over 90 m along x (nodes 50 m apart) and over a cell of 200 m along y."""
    cells = fixture(spark, sf_dir, "cells_fx")
    found = sampling.dem_slope_at(cells.select((C("i") * 20 + C("j")).alias("place"), (C("j") + 0.25).alias("u"), (C("i") + 0.5).alias("v")), cells.select("i", "j", "z"), ["place"], 50.0, 200.0)
    return found.select("place", q.r6(C("dzdx"), "dzdx", 5), q.r6(C("dzdy"), "dzdy", 5))


#: A scene's orbit in closed form: the plane of its longitude, the angle from the equator that a place is abreast of, and the range there.
ABREAST = f""", n AS (SELECT *, {q.N_SQL} AS n FROM points_fx), e AS (SELECT point_id, lat, lon, 1000 * n * cos(radians(lat)) + h * cos(radians(lat)) AS q, (1000 * n * pow(CAST({q.geo.MINOR_KM} AS DOUBLE) / {q.geo.MAJOR_KM}, 2) + h) * sin(radians(lat)) AS z FROM n),
 s AS (SELECT s_suppkey AS scene_id, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS own FROM supplier), b AS (SELECT scene_id, point_id, q, z, q * cos(radians(lon - own)) AS ahead FROM e JOIN s ON lon BETWEEN own - 20.5 AND own + 20.5 WHERE lat BETWEEN 59.5 AND 80.5),
 a AS (SELECT *, atan2(z, ahead) AS angle, sqrt(q * q + z * z + 7071000.0 * 7071000.0 - 2 * 7071000.0 * sqrt(ahead * ahead + z * z)) AS slant FROM b),
 g AS (SELECT scene_id, point_id, (slant - 800000) / 10 AS range, ((angle - radians(70.0)) * 7071000.0 / 7500.0 + 55 - 50) * 500 AS azimuth FROM a)"""


@q.query("J8_geocode_places", ABREAST + " SELECT scene_id, point_id, range > -2000 AND range < 8000 AND azimuth > -2000 AND azimuth < 7000 AS in_image, true AS abreast FROM g", ("points_fx",))
def _abreast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether places have a pixel, and whether it is within a hundredth of that which the circular orbits give in closed form."""
    # places go along through the kernel: a join by their ids would send all of them through the driver
    found = geocode.geocode_points(fixture(spark, sf_dir, "points_fx"), q._scenes(spark, sf_dir), keep=("lat", "lon", "h"))
    p = q.geo.ll_to_ecef(F.when(C("range").isNotNull(), C("lat")), C("lon"), C("h"))  # places out of the image need no closed form
    found = found.withColumns({"x": p["x"] * 1000, "y": p["y"] * 1000, "z": p["z"] * 1000, "own": F.radians((C("scene_id") * 37 % 360).cast("double"))})
    found = found.withColumn("ahead", C("x") * F.cos("own") + C("y") * F.sin("own"))
    radius = 7071000.0
    slant = F.sqrt(C("x") ** 2 + C("y") ** 2 + C("z") ** 2 + radius**2 - 2 * radius * F.sqrt(C("ahead") ** 2 + C("z") ** 2))
    azimuth = ((F.atan2("z", "ahead") - F.radians(F.lit(70.0))) * radius / 7500.0 + 5) * 500
    near = (F.abs((slant - 800000) / 10 - C("range")) < 0.01) & (F.abs(azimuth - C("azimuth")) < 0.01)
    return found.select("scene_id", "point_id", C("range").isNotNull().alias("in_image"), F.coalesce(near, F.lit(True)).alias("abreast"))


@q.query("A18_baseline_components", """SELECT l_orderkey AS pair_id, l_linenumber AS line, round(dr * cos(theta) - bn * sin(theta), 5) AS across, round(-bn * cos(theta) - dr * sin(theta), 5) AS along FROM samples_fx""", ("samples_fx",))
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits that pass along z over the x axis: what lies between them is bn away from the Earth and dr to the side, turned by the look angle; bp along z doesn't count."""
    rows = fixture(spark, sf_dir, "samples_fx").withColumnsRenamed({"bn": "b0", "bp": "b1"})
    zero = {f"a_{c}": F.lit(0.0) for c in ("y", "z", "vx", "vy")}
    df = rows.withColumns({"a_x": C("slant") * 8, **zero, "a_vz": F.lit(7500.0), "b_x": C("slant") * 8 + C("b0"), "b_y": C("dr"), "b_z": C("b1")}).withColumnsRenamed({"l_orderkey": "pair_id", "l_linenumber": "line"})
    found = geocode.sv_baseline_profile(df)
    return found.select("pair_id", "line", q.r6(C("bn"), "across", 5), q.r6(C("bp"), "along", 5))


@q.query("J13_footprint_places", "SELECT s_suppkey AS scene_id, CAST(k AS BIGINT) AS sample_id, true AS in_place, CAST(4 AS BIGINT) AS centre FROM supplier, range(9) x(k)")
def _footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each of a footprint's nine places is where the circular orbit sees its pixel, within a twentieth, at height 0."""
    rows = geocode.scene_footprints(q._scenes(spark, sf_dir)).select("scene_id", F.explode("grid").alias("g"), C("centre.sample_id").alias("centre")).select("scene_id", "g.*", "centre")
    p = q.geo.ll_to_ecef(C("lat"), C("lon"), F.lit(0.0))
    rows = rows.withColumns({"x": p["x"] * 1000, "y": p["y"] * 1000, "z": p["z"] * 1000, "own": F.radians((C("scene_id") * 37 % 360).cast("double"))})
    rows = rows.withColumn("ahead", C("x") * F.cos("own") + C("y") * F.sin("own"))
    radius = 7071000.0
    slant = F.sqrt(C("x") ** 2 + C("y") ** 2 + C("z") ** 2 + radius**2 - 2 * radius * F.sqrt(C("ahead") ** 2 + C("z") ** 2))
    azimuth = ((F.atan2("z", "ahead") - F.radians(F.lit(70.0))) * radius / 7500.0 + 5) * 500
    near = (F.abs((slant - 800000) / 10 - C("sample_id") % 3 * 5999 / 2) < 0.05) & (F.abs(azimuth - F.floor(C("sample_id") / 3) * 4999 / 2) < 0.05)
    return rows.select("scene_id", "sample_id", F.coalesce(near, F.lit(False)).alias("in_place"), "centre")


@q.query("K8_footprint_features", "SELECT s_suppkey AS scene_id, 'Feature' AS type, 'Polygon' AS shape, CAST(5 AS BIGINT) AS corners, true AS closed, true AS centred, 'right' AS look_direction, CAST(800000 AS DOUBLE) AS near_range, CAST(60 AS DOUBLE) AS last_second, CAST(12 AS BIGINT) AS n_states FROM supplier")
def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the features as written and read again: a closed ring around the centre, and what the scene says."""
    scenes = q._scenes(spark, sf_dir)
    folder = new_folder(spark, "footprints")
    sinks.footprint_json(geocode.scene_footprints(scenes), scenes).write.text(folder)
    schema = "type string, geometry struct<type:string, coordinates:array<array<array<double>>>>, properties struct<scene_id:long, centre_lat:double, centre_lon:double, look_direction:string, near_range:double, last_second:double, states:array<struct<x:double>>>"
    f = spark.read.schema(schema).json(folder).withColumn("ring", C("geometry.coordinates")[0])
    lats = F.transform("ring", lambda p: p[1])
    centred = C("properties.centre_lat").between(F.array_min(lats), F.array_max(lats))
    return f.select("properties.scene_id", "type", C("geometry.type").alias("shape"), F.size("ring").cast("long").alias("corners"), (C("ring")[0] == C("ring")[4]).alias("closed"), centred.alias("centred"), "properties.look_direction", "properties.near_range", "properties.last_second", F.size("properties.states").cast("long").alias("n_states"))


# ---- whole plans from raw planes ----
#: The middle of the images: latitude, longitude from the orbit's plane, and distance from the pole on the projection, in km.
MIDDLE_LAT, MIDDLE_LON, CELL, AROUND = 69.68, 10.6, 8, 8
_lat = np.radians(MIDDLE_LAT)
_std = np.radians(70.0)
_e = q.geo.ECC2**0.5
_t = lambda a: np.tan(np.pi / 4 - a / 2) / ((1 - _e * np.sin(a)) / (1 + _e * np.sin(a))) ** (_e / 2)
MIDDLE_RHO = float(q.geo.RADIUS_KM * np.cos(_std) / np.sqrt(1 - q.geo.ECC2 * np.sin(_std) ** 2) * _t(_lat) / _t(_std))


def coarse_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 60 by 50 pixels of a km and a fifth of a second, on the circular orbits, with the box of cells around each."""
    turn = F.radians((C("scene_id") * 37 % 360).cast("double") + (MIDDLE_LON + 45))
    i, j = F.floor(-MIDDLE_RHO * F.cos(turn) / CELL).cast("int"), F.floor(MIDDLE_RHO * F.sin(turn) / CELL).cast("int")
    boxes = {"i_min": i - AROUND, "i_max": i + AROUND + 1, "j_min": j - AROUND, "j_max": j + AROUND + 1}
    made = {"pixel": F.lit(1000.0), "prf": F.lit(5.0), "n_range": F.lit(60), "n_azimuth": F.lit(50), "weight": (0.5 + C("scene_id") % 3 * 0.25).cast("double"), "image_date": F.date_add(F.lit("2020-01-01").cast("date"), (C("scene_id") % 90).cast("int")), "pass_type": (C("scene_id") % 2).cast("int")}
    return q._scenes(spark, sf_dir).withColumns(boxes | made)


def ground_layers(scenes: DataFrame) -> dict[str, DataFrame]:
    cells = q.grid.cells_for_pairs(scenes.select("i_min", "i_max", "j_min", "j_max")).select("i", "j").distinct()
    i, j = C("i"), C("j")
    made = {"z": (F.abs(i * 7 + j * 3) % 100 * 10).cast("double"), "code": F.when(F.abs(i + j) % 9 == 0, 1).otherwise(0), "dzdx": (F.abs(i) % 5 * 0.01).cast("double"), "dzdy": (F.abs(j) % 4 * 0.01).cast("double")}
    return {n: cells.select("i", "j", c.alias(n)) for n, c in made.items()}


MAJ, MIN = q.geo.MAJOR_KM, q.geo.MINOR_KM
ORBIT = "7071000.0"


def n_sql(lat: str) -> str:
    return f"(1000 * {MAJ} * {MAJ} / sqrt(pow({MAJ} * cos({lat}), 2) + pow({MIN} * sin({lat}), 2)))"


def seen_sql(lat: str, h: str, name: str) -> str:
    """Columns of a place (lat and lam in radians, own the orbit's longitude): its distance from the axis and height over the equator's plane, then what lies abreast."""
    return f"({n_sql(lat)} + {h}) * cos({lat}) AS q{name}, ({n_sql(lat)} * pow(CAST({MIN} AS DOUBLE) / {MAJ}, 2) + {h}) * sin({lat}) AS z{name}"


def pixel_sql(name: str) -> str:
    ahead = f"(q{name} * cos(lam - radians(own)))"
    return f"sqrt(q{name} * q{name} + z{name} * z{name} + {ORBIT} * {ORBIT} - 2 * {ORBIT} * sqrt({ahead} * {ahead} + z{name} * z{name})) AS slant{name}, ((atan2(z{name}, {ahead}) - radians(70.0)) * {ORBIT} / 7500.0 + 5) * 5 AS azimuth{name}, sqrt(q{name} * q{name} + z{name} * z{name}) AS away{name}"


STEP = "radians(0.0025)"
GROUND_SQL = f"""WITH RECURSIVE s AS (SELECT s_suppkey AS pair_id, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS own, CAST(0.5 + s_suppkey % 3 * 0.25 AS DOUBLE) AS weight FROM supplier),
 mi AS (SELECT *, CAST(floor(-{MIDDLE_RHO} * cos(radians(own + {MIDDLE_LON + 45})) / {CELL}) AS INT) AS i0, CAST(floor({MIDDLE_RHO} * sin(radians(own + {MIDDLE_LON + 45})) / {CELL}) AS INT) AS j0 FROM s),
 bx AS (SELECT *, i0 - {AROUND} AS i_min, i0 + {AROUND + 1} AS i_max, j0 - {AROUND} AS j_min, j0 + {AROUND + 1} AS j_max FROM mi),
 ci AS (SELECT *, CAST(unnest(range(i_min, i_max)) AS INT) AS i FROM bx), cj AS (SELECT *, CAST(unnest(range(j_min, j_max)) AS INT) AS j FROM ci),
 rh AS (SELECT *, CAST(abs(i * 7 + j * 3) % 100 * 10 AS DOUBLE) AS h, {CELL} * sqrt(CAST(i * i + j * j AS DOUBLE)) AS rho, atan2(CAST(j AS DOUBLE), CAST(-i AS DOUBLE)) - pi() / 4 AS lam FROM cj),
 ch AS (SELECT *, pi() / 2 - 2 * atan(rho * {q.t_sql("radians(70.0)", q.ECC)} / ({q.geo.RADIUS_KM} * {q.CM70})) AS chi FROM rh),
 la AS (SELECT *, chi + {q.E2 / 2 + 5 * q.E4 / 24 + q.E6 / 12} * sin(2 * chi) + {7 * q.E4 / 48 + 29 * q.E6 / 240} * sin(4 * chi) + {7 * q.E6 / 120} * sin(6 * chi) AS lat FROM ch),
 pl AS (SELECT *, {seen_sql("lat", "h", "")}, {seen_sql(f"(lat - {STEP})", "0", "1")}, {seen_sql(f"(lat + {STEP})", "0", "2")}, sqrt(pow({n_sql("lat")} * cos(lat), 2) + pow({n_sql("lat")} * pow(CAST({MIN} AS DOUBLE) / {MAJ}, 2) * sin(lat), 2)) + h AS ground FROM la),
 px AS (SELECT *, {pixel_sql("")}, {pixel_sql("1")}, {pixel_sql("2")} FROM pl),
 lk AS (SELECT *, (slant - 800000) / 1000 AS range, acos((slant * slant + {ORBIT} * {ORBIT} - ground * ground) / (2 * slant * {ORBIT})) AS theta, acos(({ORBIT} * {ORBIT} - slant * slant - ground * ground) / (2 * slant * ground)) AS psi FROM px)"""

IMAGE_SQL = GROUND_SQL + """, ob AS (SELECT pair_id, i, j, i_min, i_max, j_min, j_max, weight, ((1 + 0.01 * azimuth) * (2 + 0.02 * range) + pair_id % 7) * pow(sin(psi), 3) AS value FROM lk WHERE range >= 0 AND range <= 59 AND azimuth >= 0 AND azimuth <= 49)""" + q.OB_FEATHER


def _image_samples(spark: SparkSession, sf_dir: str, fl: int) -> DataFrame:
    scenes = coarse_scenes(spark, sf_dir)
    pixels = scenes.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("j"))
    pixels = pixels.withColumn("power", (1 + 0.01 * C("i")) * (2 + 0.02 * C("j")) + C("scene_id") % 7)
    return q.plans.image_samples(scenes, pixels, {"z": ground_layers(scenes)["z"]}, "none", CELL * 1000.0, fl=fl)


@q.query("image_mosaic", IMAGE_SQL + ", m AS (SELECT i, j, sum(value * f * weight) / sum(f) AS value FROM fe GROUP BY 1, 2) SELECT i, j, round(value, 3) AS value, round(log10(value) * 1000) / 100 AS sigma0 FROM m")
def _image_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image mosaic from pixels: cells geocoded on a DEM, bilinear power, incidence, feathering and the average with gains."""
    found = q.plans.image_mosaic(_image_samples(spark, sf_dir, 3))
    return found.select("i", "j", q.r6(C("value"), "value", 3), "sigma0")


@q.query("image_mosaic_nearest", IMAGE_SQL.replace(q.OB_FEATHER, "") + ", r AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY abs(pair_id % 90 - 41), pair_id) AS k FROM ob) SELECT i, j, round(value, 3) AS value, round(log10(value) * 1000) / 100 AS sigma0 FROM r WHERE k = 1")
def _image_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images, of each cell the one nearest to a date."""
    found = q.plans.image_mosaic(_image_samples(spark, sf_dir, 0), "nearest_date", "2020-02-11")
    return found.select("i", "j", q.r6(C("value"), "value", 3), "sigma0")


U, V = "(range / 4)", "(azimuth / 4)"
SAMPLED_SQL = GROUND_SQL + f""", of AS (SELECT *, theta - 0.3 AS td, (azimuth - 25) / 50 AS x, 0.01 * {U} * {V} + 0.1 * (pair_id % 5) AS dr0, 0.2 - 0.01 * {U} + 0.005 * {V} AS da0, 0.05 + 0.002 * {U} AS sr0, 0.03 + 0.001 * {V} AS sa0 FROM lk WHERE range >= 0 AND range <= 60 AND azimuth >= 0 AND azimuth <= 48),
 bs AS (SELECT *, 50 + pair_id % 7 + 3 * x + 0.5 * x * x AS bn, 20 + x AS bp, sin(td) AS s, cos(td) AS c FROM of),
 cal AS (SELECT *, dr0 * 2.5 - (sqrt(slant * slant - 2 * slant * (bn * s + bp * c) + bn * bn + bp * bp) - slant + 0.75) AS dr, da0 * 4 - (0.2 + slant * sin(theta) * 1e-6 - slant * cos(theta) * 2e-6) - 0.3 * x AS da, greatest(0.02, least(sr0, 0.2)) * 2.5 AS sr1, sqrt(pow(least(sa0, 0.2), 2) + 0.01 * 0.01) * 4 AS sa1, bn * 15 / (slant * sin(theta)) AS de FROM bs)"""


def _radar_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """Pairs with their calibration, scenes, offsets on grids of 13 by 16 nodes, and the layers of the ground."""
    scenes = coarse_scenes(spark, sf_dir)
    k = C("pair_id")
    known = {"r0": 0, "a0": 0, "delta_r": 4.0, "delta_a": 4.0, "n_days": 12.0, "range_pixel": 2.5, "azimuth_pixel": 4.0, "theta_c": 0.3, "sigma_streaks": 0.01, "sigma_range": 0.02, "dbn": 3.0, "dbnq": 0.5, "bp": 20.0, "dbp": 1.0, "dbpq": 0.0, "const": 0.75, "c1": 0.2, "dbc": 1e-6, "dbh": 2e-6, "doffdx": 0.3}
    diagonal = lambda n, a, off: F.array(*[F.lit(a * (r + 1) if r == c else off if {r, c} == {0, n - 1} else 0.0) for r in range(n) for c in range(n)])
    pairs = scenes.select(C("scene_id").alias("pair_id"), "scene_id", "i_min", "i_max", "j_min", "j_max", "weight").withColumns({n: F.lit(v) for n, v in known.items()} | {"bn": 50.0 + k % 7, "range_cov": diagonal(6, 1e-6, 1e-7), "azimuth_cov": F.transform(F.sequence(F.lit(0), F.lit(15)), lambda n: F.when(n == 0, 1e-6).when(n == 15, 4e-6).otherwise(0.0))})
    nodes = pairs.select("pair_id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j"))
    i, j = C("i"), C("j")
    offsets = nodes.withColumns({"dr": 0.01 * i * j + 0.1 * (k % 5), "da": 0.2 - 0.01 * j + 0.005 * i, "sr": 0.05 + 0.002 * j, "sa": 0.03 + 0.001 * i})
    return pairs, scenes, offsets, ground_layers(scenes)


HEADING = f"atan2((azimuth2 - azimuth1) * 7500 / 5 * away / {ORBIT}, away2 * acos(({ORBIT} * {ORBIT} + away2 * away2 - slant2 * slant2) / (2 * {ORBIT} * away2)) - away1 * acos(({ORBIT} * {ORBIT} + away1 * away1 - slant1 * slant1) / (2 * {ORBIT} * away1)))"
SR = "sqrt(sr1 * sr1 + de * de + 1e-6 * s * s + 2e-6 * x * x * s * s + 3e-6 * x * x * c * c + 4e-6 * pow(x, 4) * s * s + 5e-6 * pow(x, 4) * c * c + 6e-6 - 2e-7 * s)"


@q.query("radar_samples", SAMPLED_SQL + f""" SELECT pair_id, i, j, CASE WHEN abs(i + j) % 9 = 0 THEN 1 ELSE 0 END AS code, round(psi, 5) AS psi, round(theta, 5) AS theta,
 round({HEADING}, 3) AS heading,
 round(dr, 2) AS dr, round(da, 3) AS da, round({SR}, 4) AS sr, round(sqrt(sa1 * sa1 + 1e-6 + 4e-6 * x * x), 4) AS sa FROM cal""")
def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw offsets of pairs on output cells: geocoded places, bilinear offsets, baselines, azimuth terms, errors with covariances, and the heading."""
    rows = q.plans.radar_samples(*_radar_inputs(spark, sf_dir), CELL * 1000.0)
    return rows.select("pair_id", "i", "j", "code", *[q.r6(C(c), c, d) for c, d in (("psi", 5), ("theta", 5), ("heading", 3), ("dr", 2), ("da", 3), ("sr", 4), ("sa", 4))])


WINDOW = (2458860.5, 2458950.5)
OVERLAP = q.DW.replace("2449900.5", str(WINDOW[0])).replace("2449990.5", str(WINDOW[1]))
DATED_SQL = SAMPLED_SQL + f""", dated AS (SELECT *, a + 6 - 0.5 * ({WINDOW[0]} + {WINDOW[1]}) AS dt, {OVERLAP} AS overlap FROM (SELECT *, 2458849.5 + pair_id * 7 % 180 AS a, 2458849.5 + pair_id * 7 % 180 + 12 AS b FROM cal)),
 radar_fx AS (SELECT pair_id, i, j, i_min, i_max, j_min, j_max, weight * overlap AS weight, dt, dr, da, {SR} AS sr, sqrt(sa1 * sa1 + 1e-6 + 4e-6 * x * x) AS sa, psi, {HEADING} AS heading, atan2(CAST(-i AS DOUBLE), CAST(-j AS DOUBLE)) AS xy, h AS z, CAST(abs(i) % 5 * 0.01 AS DOUBLE) AS dzdx, CAST(abs(j) % 4 * 0.01 AS DOUBLE) AS dzdy,
  CASE WHEN abs(i + j) % 9 = 0 THEN 1 ELSE 0 END AS code, CAST(12 AS DOUBLE) AS n_days, CAST(0.3 AS DOUBLE) AS tide_rate, CAST(0 AS DOUBLE) AS submergence FROM dated WHERE overlap > 0)"""


@q.query("speckle_from_offsets", DATED_SQL + q.SPECKLE_SQL + q.OB_FEATHER + f", fin AS (SELECT i, j, {q.MEANS} FROM fe GROUP BY i, j) SELECT CAST(floor(i / 16.0) AS BIGINT) AS bi, CAST(floor(j / 16.0) AS BIGINT) AS bj, round(CAST(avg(vx) AS DOUBLE)) AS vx, round(CAST(avg(vy) AS DOUBLE)) AS vy, round(CAST(avg(dt) AS DOUBLE), 2) AS dt, CAST(sum(n) AS BIGINT) AS n FROM fin GROUP BY 1, 2")
def _from_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speckle round end to end, from dated pairs, scenes and raw offsets; in means over blocks of 16 by 16 cells, because headings come out of an iteration."""
    pairs, scenes, offsets, layers = _radar_inputs(spark, sf_dir)
    pairs = pairs.withColumns({"jd1": 2458849.5 + C("pair_id") * 7 % 180, "tide_rate": F.lit(0.3)})
    found = q.mosaic.finish(q.plans.speckle_round(pairs, scenes, offsets, layers, *WINDOW, cell=CELL * 1000.0))
    blocks = found.groupBy(F.floor(C("i") / 16).alias("bi"), F.floor(C("j") / 16).alias("bj"))
    return blocks.agg(q.r6(F.avg("vx"), "vx", 0), q.r6(F.avg("vy"), "vy", 0), q.r6(F.avg("dt"), "dt", 2), F.sum("n").alias("n"))


# ---- formulas without a query of their own ----
q.per_row("F5_to_ellipsoid", "points_fx", q.P, {"sphere": (lambda: q.geo.to_spherical(C("h"), C("lat"), 6371000.0), f"h + ({q.ER_SQL} * 1000 - 6371000)"), "back": (lambda: q.geo.to_ellipsoid(q.geo.to_spherical(C("h"), C("lat"), 6371000.0), C("lat"), 6371000.0), "h")}, 4)
q.per_row("F4_cell_xy", "cells_fx", ["i", "j"], {"x": (lambda: q.geo.cell_xy(C("i"), C("j"), -200.5, 100.25, 0.5, 0.25)["x"], "-200.5 + j * CAST(0.5 AS DOUBLE)"), "y": (lambda: q.geo.cell_xy(C("i"), C("j"), -200.5, 100.25, 0.5, 0.25)["y"], "100.25 + i * CAST(0.25 AS DOUBLE)")})
q.per_row("F23_fine_beam_final", "samples_fx", q.S, {"sigma": (lambda: q.image.fine_beam_final(C("sr")), "sr / CAST(27.3 AS DOUBLE) - CAST(0.0058 AS DOUBLE)")})

CORNERS = [(0, 0), (1, 0), (1, 1), (0, 1)]


@q.query("S6_scene_bounds", f"""WITH c AS (SELECT s_suppkey, 60 + s_suppkey * 7 % 25 + a AS lat, CAST(s_suppkey * 37 % 350 + b AS DOUBLE) AS lon FROM supplier, (VALUES {", ".join(map(str, CORNERS))}) k(a, b)), p AS (SELECT s_suppkey, {q.RHO} * sin(radians(lon + 45)) AS x, -{q.RHO} * cos(radians(lon + 45)) AS y FROM c)
 SELECT 'scene' || s_suppkey AS scene_id, round(min(x), 4) AS x_min, round(max(x), 4) AS x_max, round(min(y), 4) AS y_min, round(max(y), 4) AS y_max FROM p GROUP BY s_suppkey""")
def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as files, read, and boxed on the projection."""
    k = C("s_suppkey")
    lat, lon = 60 + k * 7 % 25, k * 37 % 350
    ring = F.array(F.array(*[F.array((lon + b).cast("double"), (lat + a).cast("double")) for a, b in [*CORNERS, CORNERS[0]]]))
    body = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"), F.struct(F.concat(F.lit("scene "), k).alias("ImageName")).alias("properties")))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("scene"), k, F.lit(".geojson")).alias("file"), body.alias("text"))
    found = text.scene_bounds(text.read_scenes_geojson(spark, write_files(files, new_folder(spark, "features"))), 45.0, 70.0)
    return found.select("scene_id", *[q.r6(C(c), c, 4) for c in ("x_min", "x_max", "y_min", "y_max")])
