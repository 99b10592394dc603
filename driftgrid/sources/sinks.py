"""Sinks: tables by tile, with sentinels put back only in text and raster forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rasters import tile

NO_DATA = -2.0e9


def velocity_layers(mosaic: DataFrame, time_overlap: bool = True) -> DataFrame:
    """K1: vx, vy, the third layer (dt with time overlap, else vz), ex, ey with sigmas from variances (both where ex > 0) and the sentinel for no data."""
    has = F.col("ex") > 0
    sigma = {c: F.when(has, F.sqrt(F.col(c))).otherwise(F.col(c)) for c in ("ex", "ey")}
    layers = mosaic.withColumns(sigma)
    kept = [c for c in ("vx", "vy", "dt" if time_overlap else "vz", "ex", "ey") if c in mosaic.columns]
    out = layers.withColumns({c: F.coalesce(F.col(c), F.lit(NO_DATA)) for c in kept})
    return out.drop("vz" if time_overlap else "dt")


def write_tiles(df: DataFrame, path: str) -> None:
    """K1, K4, K6, K7: cells by tile, rows in order within; one file per tile."""
    df.select("*", *tile()).repartition("ti", "tj").sortWithinPartitions("ti", "tj", "i", "j").write.partitionBy("ti", "tj").parquet(path)


def write_velocity_mosaic(mosaic: DataFrame, path: str, first_date: str, last_date: str, epsg: int, time_overlap: bool = True) -> None:
    """K1: layers by tile, and a row of metadata beside them."""
    write_tiles(velocity_layers(mosaic, time_overlap), f"{path}/cells")
    mosaic.sparkSession.range(1).select(F.lit(first_date).alias("first_date"), F.lit(last_date).alias("last_date"), F.current_timestamp().alias("created"), F.lit(epsg).alias("epsg")).write.json(f"{path}/metadata")


def mosaic_meta(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """K2: a record for each used pair: central day, dates, and the middle of its box."""
    used = pairs.join(obs.select("pair_id").distinct(), "pair_id", "left_semi")
    day = lambda jd: F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(jd + 0.5) - 2440588).cast("int"))
    end = F.col("jd1") + F.col("n_days")
    return used.select("pair_id", (F.col("jd1") + F.col("n_days") / 2).alias("central_jd"), day(F.col("jd1")).alias("date1"), day(end).alias("date2"), "n_days", ((F.col("i_min") + F.col("i_max")) / 2).alias("i_mid"), ((F.col("j_min") + F.col("j_max")) / 2).alias("j_mid"))


#: K2: the sensor by what a product's label begins with. Fixed values.
SENSORS = {"S1A": "Sentinel-1A", "S1B": "Sentinel-1B", "LC08": "Landsat 8", "LC09": "Landsat 9", "TDX": "TanDEM-X", "TSX": "TerraSAR-X", "ALOS": "ALOS", "RSAT": "RADARSAT"}


def product_meta(meta: DataFrame, labels: DataFrame, grid: tuple[float, float, float, float], south: bool, rot: float, std_lat: float) -> DataFrame:
    """K2: records of mosaic_meta with the sensor from labels(pair_id, label, second), the nominal time of day, the centre's lat and lon and what they came from.

    grid is the origin and step (x, y) in km.
    """
    from driftgrid.functions.geo import xy_to_ll

    ox, oy, dx, dy = grid
    sensor = F.lit("unknown")
    for prefix, name in SENSORS.items():
        sensor = F.when(F.upper("label").startswith(prefix), name).otherwise(sensor)
    centre = xy_to_ll(ox + F.col("j_mid") * dx, oy + F.col("i_mid") * dy, south, rot, std_lat)
    second = F.floor("second").cast("int")
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600).cast("int"), F.floor(second % 3600 / 60).cast("int"), second % 60)
    return meta.join(labels, "pair_id", "left").withColumn("centre", centre).select(*meta.columns, sensor.alias("sensor"), clock.alias("nominal_time"), F.col("centre.lat").alias("lat"), F.col("centre.lon").alias("lon"), F.col("label").alias("source"))


def tie_lines(ties: DataFrame) -> DataFrame:
    """K3: control points as formatted lines; the file ends with '&'."""
    lines = ties.select(F.format_string("%.6f %.6f %.2f %.3f %.3f %.3f", "lat", "lon", "z", "vx", "vy", "vz").alias("value"))
    return lines


def write_tie_points(ties: DataFrame, path: str) -> None:
    tie_lines(ties).unionByName(ties.sparkSession.range(1).select(F.lit("&").alias("value"))).write.text(path)


def image_layers(image: DataFrame, layers: tuple[str, ...] = ("sigma0", "gamma0", "gamma_correction")) -> DataFrame:
    """K4: the layers that are asked for of image(i, j, value, gamma_correction, incidence): sigma nought and gamma nought in dB, the correction, the incidence angle in degrees, the plain image."""
    from driftgrid.functions.image import gamma0, to_db

    sigma = to_db(F.col("value"))
    made = {"image": F.col("value"), "sigma0": sigma}
    if "gamma_correction" in image.columns:
        made |= {"gamma0": gamma0(sigma, F.col("gamma_correction")), "gamma_correction": F.col("gamma_correction")}
    if "incidence" in image.columns:
        made["incidence"] = F.col("incidence")
    missing = [n for n in layers if n not in made]
    if missing:
        raise ValueError(f"no column for {missing}")
    return image.select(*[c for c in image.columns if c not in layers], *[made[n].alias(n) for n in layers])


#: K5: the order of the parameters in their line, and what the rows of the covariance are, by kind.
FIT_LAYOUTS = {
    "range": (("bn", "bp", "dbn", "dbp", "const", "dbnq", "dbpq"), "Bn, dBn, dBp, dBnQ, dBpQ, const"),
    "azimuth": (("c1", "dbc", "dbh", "doffdx"), "c1, dbc, dbh, doffdx"),
    "baseline": (("bn", "bp", "dbn", "dbp", "dbnq", "dbpq"), "Bn, Bp, dBn, dBp, dBnQ, dBpQ"),
}


def fit_lines(fits: DataFrame, kind: str = "range") -> DataFrame:
    """K5: fits(pair_id, the parameters by name, cov (flat), n, sigma_res) as the text of a parameter file, which S13 reads.

    The counts of ties (n_given, if there, beside n), the spread of the residuals, a line for each row of the covariance, and all parameters in
    their places, whether solved for or known.
    """
    names, rows = FIT_LAYOUTS[kind]
    size = 4 if kind == "azimuth" else 6
    number = lambda c: F.format_string("%.12g", c)
    given = F.col("n_given") if "n_given" in fits.columns else F.col("n")
    covariance = [F.concat(F.lit(f";* C_{a + 1}  "), F.array_join(F.transform(F.slice("cov", a * size + 1, size), number), " ")) for a in range(size)]
    lines = [
        F.concat(F.lit("; Ntiepoints/Ngiven used= "), F.col("n"), F.lit("/"), given),
        F.concat(F.lit(";* sigma*sqrt(X2/n)= "), number(F.col("sigma_res"))),
        F.lit(f"; Covariance Matrix {rows}"), *covariance,
        F.lit("; " + " ".join(names)), F.concat_ws(" ", *[number(F.col(n)) for n in names]), F.lit("&"),
    ]
    return fits.select("pair_id", F.concat_ws("\n", *lines).alias("value"))


def geocoded_points(df: DataFrame, looks_r: int, looks_a: int) -> DataFrame:
    """K6: single-look coordinates of df(range, azimuth in looks); both -9999 outside the image."""
    out = F.col("range").isNull() | F.col("azimuth").isNull()
    single = lambda c, looks: F.when(out, -9999.0).otherwise(F.col(c) * looks + 0.5 * (looks - 1))
    return df.withColumns({"range": single("range", looks_r), "azimuth": single("azimuth", looks_a)})


def radar_grid_layers(df: DataFrame, looks_r: int = 1, looks_a: int = 1) -> DataFrame:
    """K7: lat, lon, height and mask by radar cell, with no data as the sentinel."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(NO_DATA)) for c in ("lat", "lon", "height") if c in df.columns})


def footprint_json(footprints: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """K8: footprints(scene_id, grid, centre) as GeoJSON lines: ll, ul, ur, lr and the centre.

    With scenes, the properties also have the look direction, near range and range pixel, first and last second, PRF, sizes and the state vectors.
    """
    at = lambda k: F.array(F.get("grid", F.lit(k))["lon"], F.get("grid", F.lit(k))["lat"])
    ring = F.array(at(0), at(6), at(8), at(2), at(0))
    properties = ["scene_id", F.col("centre.lat").alias("centre_lat"), F.col("centre.lon").alias("centre_lon")]
    if scenes is not None:
        more = scenes.select("scene_id", F.when(F.col("look_left"), "left").otherwise("right").alias("look_direction"), F.col("near").alias("near_range"), F.col("pixel").alias("range_pixel"), F.col("start").alias("first_second"), (F.col("start") + F.col("n_azimuth") / F.col("prf")).alias("last_second"), "prf", "n_range", "n_azimuth", F.col("t0").alias("first_state"), F.col("step").alias("state_step"), "states")
        footprints = footprints.join(more, "scene_id")
        properties += [c for c in more.columns if c != "scene_id"]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return footprints.select(F.to_json(feature).alias("value"))
