"""Sources in text: manifests, headers, fits and points. Each is one Spark job over a folder of many files, with explicit schemas.

No-data sentinels become NULL here. Paths are anything that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR_FIELDS = ["phase_path", "geodat_path", "baseline_path", "n_days", "weight", "az_offset_path", "az_params_path", "rg_offset_path", "rg_params_path", "cross_flag"]


def _none(c: Column) -> Column:
    return F.when(c.isin("none", "None", ""), None).otherwise(c)


def _lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """file, seq (rises along the file) and line, without blanks, comments after ';' and anything from a line '&' on.

    In place of a path a table (file, seq, value) of lines will do. A large file is read in several splits, so lines are numbered by the split's place, then within it.
    """
    if isinstance(path, DataFrame):
        raw = path.select("file", F.col("seq").cast("decimal(38,0)").alias("seq"), "value")
    else:
        start = F.col("_metadata.file_block_start").cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)")
        raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (start + F.monotonically_increasing_id()).cast("decimal(38,0)").alias("seq"), "value")
    rows = raw.select("file", "seq", F.trim(F.regexp_replace("value", ";.*$", "")).alias("line"))
    ends = rows.where(F.col("line").startswith("&")).groupBy("file").agg(F.min("seq").alias("end"))
    return rows.join(ends, "file", "left").where((F.col("line") != "") & (F.col("end").isNull() | (F.col("seq") < F.col("end")))).drop("end")


def _whole(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """One row per file: file, id (its name without the suffix) and text. In place of a path a table (file, text) will do."""
    if isinstance(path, DataFrame):
        rows = path.select("file", "text")
    else:
        rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))
    return rows.select("file", F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("id"), "text")


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"), 0), lambda x: x.cast("double"))


def read_grid_spec(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """The first line of a pair list, km turned to m: origin_x, origin_y, nx, ny, dx, dy."""
    first = _lines(spark, path).groupBy("file").agg(F.min_by("line", "seq").alias("line"))
    n = F.col("n")
    return first.select("file", F.transform(F.split("line", r"\s+"), lambda x: x.cast("double")).alias("n")).select("file", (n[0] * 1000).alias("origin_x"), (n[1] * 1000).alias("origin_y"), n[2].cast("int").alias("nx"), n[3].cast("int").alias("ny"), (n[4] * 1000).alias("dx"), (n[5] * 1000).alias("dy"))


def read_pair_list(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Rows after the first two lines; 10 to 5 fields, weight and cross_flag 1 where missing, 'none' is NULL; input_seq keeps the order."""
    rows = _lines(spark, path)
    head = rows.groupBy("file").agg(F.slice(F.array_sort(F.collect_list("seq")), 1, 2).alias("head"))
    f = F.split("line", r"\s+")
    own = rows.join(head, "file").where(~F.array_contains("head", F.col("seq")) & (F.size(f) >= 4)).withColumn("f", f)
    get = lambda k: F.get("f", F.lit(k))
    texts = [_none(get(k)).alias(PAIR_FIELDS[k]) for k in (0, 1, 2, 5, 6, 7, 8)]
    return own.select("file", F.col("seq").alias("input_seq"), *texts, get(3).cast("double").alias("n_days"), F.coalesce(get(4).cast("double"), F.lit(1.0)).alias("weight"), F.coalesce(get(9).cast("int"), F.lit(1)).alias("cross_flag"))


def read_image_list(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Image, geodat, weight (1), and an antenna pattern only if its name holds 'poly' or 'alos'."""
    f = F.split("line", r"\s+")
    get = lambda k: F.get(f, F.lit(k))
    return _lines(spark, path).where(F.size(f) >= 2).select("file", F.col("seq").alias("input_seq"), get(0).alias("image_path"), get(1).alias("geodat_path"), F.coalesce(get(2).cast("double"), F.lit(1.0)).alias("weight"), F.when(F.lower(get(3)).rlike("poly|alos"), get(3)).alias("antenna_pattern"))


def read_optical_list(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """S3: match, fit (the match with .fit where missing) and mask."""
    f = F.split("line", r"\s+")
    get = lambda k: _none(F.get(f, F.lit(k)))
    return _lines(spark, path).select("file", F.col("seq").alias("input_seq"), get(0).alias("match_path"), F.coalesce(get(1), F.concat(get(0), F.lit(".fit"))).alias("fit_path"), get(2).alias("mask_path"))


def read_irregular_points(spark: SparkSession, path: str | DataFrame, south: bool, rot: float, std_lat: float) -> DataFrame:
    """Lat lon speed bearing as x, y (km) and vx, vy, the bearing turned to the grid."""
    from driftgrid.functions.geo import ll_to_xy, xy_angle

    f = F.split("line", r"\s+")
    n = [F.get(f, F.lit(k)).cast("double") for k in range(4)]
    rows = _lines(spark, path).where(F.size(f) >= 4).select(F.col("file").alias("set_id"), *[c.alias(a) for c, a in zip(n, ("lat", "lon", "speed", "bearing"), strict=True)])
    rows = rows.withColumn("p", ll_to_xy(F.col("lat"), F.col("lon"), rot, std_lat)).select("*", "p.*").drop("p")
    phi = F.lit(0.0) if south else F.pi()
    turn = F.radians("bearing") + phi - xy_angle(F.col("x"), F.col("y"), south)
    return rows.withColumn("vx", F.col("speed") * F.cos(turn)).withColumn("vy", F.col("speed") * -F.sin(turn))


def key_values(spark: SparkSession, path: str | DataFrame, separator: str = "=") -> DataFrame:
    """File, id, and the map of 'key separator value' lines; keys in lower case, first of repeated ones."""
    pairs = F.filter(F.transform(F.split("text", "\n"), lambda x: F.split(x, separator, 2)), lambda p: F.size(p) == 2)
    named = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(p[0])).alias("key"), F.trim(p[1]).alias("value")))
    rows = _whole(spark, path).select("file", "id", F.posexplode(named).alias("n", "p")).groupBy("file", "id", F.col("p.key").alias("key")).agg(F.min_by("p.value", "n").alias("value"))
    return rows.groupBy("file", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("kv"))


def _kv(name: str, kind: str = "double") -> Column:
    return F.try_element_at("kv", F.lit(name.lower())).cast(kind)


def read_optical_matches(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Headers of optical matches."""
    doubles = ["x0", "y0", "dx", "dy"]
    return key_values(spark, path).select("file", F.col("id").alias("match_id"), *[_kv(n).alias(n) for n in doubles], *[_kv(n, "int").alias(a) for n, a in (("nx", "nx"), ("ny", "ny"), ("stepx", "step_x"), ("stepy", "step_y"), ("epsg", "epsg"))], _kv("earlyimagejd").alias("jd_early"), _kv("lateimagejd").alias("jd_late"), _kv("intervalbetweenimages").alias("delta_t"), _kv("mean_sigmax").alias("mean_sigma_x"), _kv("mean_sigmay").alias("mean_sigma_y"))


def read_optical_fits(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Plane coefficients, residual sigmas (third of their numbers) and flat 3 x 3 covariances; files without one are an error."""
    numbers = lambda name: _numbers(F.try_element_at("kv", F.lit(name)))
    cov = lambda axis: F.concat(*[F.coalesce(numbers(f"c{axis}_{a}"), F.raise_error(F.concat(F.lit("no covariance in "), F.col("file"))).cast("array<double>")) for a in (1, 2, 3)])
    return key_values(spark, path).select("file", F.col("id").alias("match_id"), numbers("xfit").alias("px"), numbers("yfit").alias("py"), F.get(numbers("x_residual"), F.lit(2)).alias("sigma_x_res"), F.get(numbers("y_residual"), F.lit(2)).alias("sigma_y_res"), cov("x").alias("cx"), cov("y").alias("cy"))


def read_scenes_text(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Scene metadata in 'key: value' lines, as a map; numbers by metadata_number."""
    return key_values(spark, path, ":").select("file", F.col("id").alias("scene_id"), F.col("kv").alias("metadata"))


def metadata_number(name: str) -> Column:
    return F.try_element_at("metadata", F.lit(name.lower())).cast("double")


SCENE = "type string, geometry struct<type:string, coordinates:array<array<array<double>>>>, properties map<string,string>"


def read_scenes_geojson(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Typed scene features: properties, the polygon's corners (last repeats the first) and state vectors gathered from SV_Pos_n, SV_Vel_n; the range error is taken from the range of the centre."""
    if isinstance(path, DataFrame):
        rows = path.select("file", F.from_json("text", SCENE).alias("f")).select("file", "f.*")
    else:
        rows = spark.read.schema(SCENE).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "*")
    get = lambda n: F.try_element_at("properties", F.lit(n))
    number = lambda n: get(n).cast("double")
    count = F.coalesce(get("NumberOfStateVectors").cast("int"), F.lit(0))
    place = lambda kind, k: _numbers(F.try_element_at("properties", F.concat(F.lit(f"SV_{kind}_"), k.cast("string"))))
    state = lambda k: F.struct((F.coalesce(number("TimeOfFirstStateVector"), number("SV_t0")) + (k - 1) * F.coalesce(number("StateVectorInterval"), number("SV_dt"))).alias("t"), *[F.get(place(kind, k), F.lit(n)).alias(c) for kind, names in (("Pos", "x y z"), ("Vel", "vx vy vz")) for n, c in enumerate(names.split())])
    states = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), state))
    corners = F.transform(F.get(F.col("geometry.coordinates"), F.lit(0)), lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    centre = number("MLCenterRange") - F.coalesce(number("RangeErrorCorrection"), F.lit(0.0))
    half = (number("MLRangeSize") - 1) * number("MLRangePixelSize") / 2
    return rows.select("file", F.regexp_extract("file", r"([^/]+)\.geojson$", 1).alias("scene_id"), get("ImageName").alias("label"), get("Date").cast("date").alias("date"), *[number(n).alias(a) for n, a in (("MLRangeSize", "range_size"), ("MLAzimuthSize", "azimuth_size"), ("NumberRangeLooks", "range_looks"), ("NumberAzimuthLooks", "azimuth_looks"), ("PRF", "prf"), ("Wavelength", "wavelength"))], centre.alias("rc"), (centre - half).alias("rn"), (centre + half).alias("rf"), get("PassType").alias("pass_type"), get("LookDirection").alias("look_dir"), F.slice(corners, 1, 4).alias("control_points"), states.alias("states"))


def scene_bounds(scenes: DataFrame, rot: float, std_lat: float) -> DataFrame:
    """Scenes with the box of their control points on the projection, in km: x_min, x_max, y_min, y_max."""
    from driftgrid.functions.geo import ll_to_xy

    places = F.transform("control_points", lambda p: ll_to_xy(p["lat"], p["lon"], rot, std_lat))
    ends = {"x_min": F.array_min(F.transform("places", lambda p: p["x"])), "x_max": F.array_max(F.transform("places", lambda p: p["x"])), "y_min": F.array_min(F.transform("places", lambda p: p["y"])), "y_max": F.array_max(F.transform("places", lambda p: p["y"]))}
    return scenes.withColumn("places", places).withColumns(ends).drop("places")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of first, and those of second whose key first lacks; columns of both."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def read_sar_par(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Old parameter files of fixed order: the numbers of each line, by place."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _whole(spark, path).select("file", F.col("id").alias("scene_id"), F.transform(lines, _numbers).alias("lines"))


def read_offset_headers(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """6 to 8 numbers (missing sigmas 0), then an optional line of two paths, taken from the header's folder where relative."""
    line = F.split(F.trim("text"), "\n")
    n, paths = _numbers(line[0]), F.split(F.trim(F.get(line, F.lit(1))), r"\s+")
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    merged = lambda k: F.when(F.get(paths, F.lit(k)).startswith("/"), F.get(paths, F.lit(k))).when(F.size(paths) == 2, F.concat_ws("/", folder, F.get(paths, F.lit(k))))
    ints, doubles = ("r0", "a0", "nr", "na"), ("delta_r", "delta_a", "sigma_streaks", "sigma_range")
    return _whole(spark, path).select("file", F.col("id").alias("pair_id"), *[F.get(n, F.lit(k)).cast("int").alias(c) for k, c in enumerate(ints)], *[F.coalesce(F.get(n, F.lit(k + 4)), F.lit(0.0)).alias(c) for k, c in enumerate(doubles)], merged(0).alias("geo1"), merged(1).alias("geo2"))


def read_offset_vrts(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """The same from the metadata of virtual rasters."""
    get = lambda n: F.nullif(F.regexp_extract("text", rf'(?i)<MDI key="{n}">([^<]*)</MDI>', 1), F.lit(""))
    size = lambda n: F.regexp_extract("text", rf'{n}="(\d+)"', 1).cast("int")
    return _whole(spark, path).select("file", F.col("id").alias("pair_id"), get("r0").cast("int").alias("r0"), get("a0").cast("int").alias("a0"), size("rasterXSize").alias("nr"), size("rasterYSize").alias("na"), get("deltaR").cast("double").alias("delta_r"), get("deltaA").cast("double").alias("delta_a"), F.coalesce(get("sigmaStreaks").cast("double"), F.lit(0.0)).alias("sigma_streaks"), F.coalesce(get("sigmaRange").cast("double"), F.lit(0.0)).alias("sigma_range"), get("geo1").alias("geo1"), get("geo2").alias("geo2"))


#: Suffixes of parameter files by correction mode, the base file last.
FIT_SUFFIXES = {"range": {"none": [""], "deltabp": [".deltabp", ""], "quad": [".quad", ""]}, "azimuth": {"none": [""], "const": [".const", ""], "svlinear": [".svlinear", ""]}, "baseline": {"none": [""]}}


def read_fit_params(spark: SparkSession, path: str | DataFrame, kind: str, mode: str = "none") -> DataFrame:
    """Per pair (the file's name up to its mode suffix) the parameters (last plain line), flat covariance rows C_n and residual sigma; the mode's file if there, else the base file with mode 'none'."""
    suffixes = FIT_SUFFIXES[kind][mode]
    own = F.regexp_extract("file", r"(\.deltabp|\.quad|\.const|\.svlinear)$", 1)
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith(";") & (F.trim(x) != "&"))
    cov = F.flatten(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"C_\d+")), lambda x: _numbers(F.regexp_extract(x, r"C_\d+\s*=?(.*)$", 1))))
    sigma = F.regexp_extract("text", r"sigma\*sqrt\(X2/n\)\s*=\s*([-+.\deE]+)", 1)
    rows = _whole(spark, path).select(F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"(\.deltabp|\.quad|\.const|\.svlinear)$", "").alias("pair_id"), own.alias("suffix"), _numbers(F.element_at(lines, -1)).alias("params"), F.when(F.size(cov) > 0, cov).alias("cov"), F.nullif(sigma, F.lit("")).cast("double").alias("sigma_res"))
    rank = F.array_position(F.array(*map(F.lit, suffixes)), F.col("suffix"))
    best = rows.where(F.col("suffix").isin(*suffixes)).groupBy("pair_id").agg(F.min_by(F.struct("suffix", "params", "cov", "sigma_res"), rank).alias("b"))
    return best.select("pair_id", F.when(F.col("b.suffix") == "", "none").otherwise(F.lit(mode)).alias("mode"), "b.params", "b.cov", "b.sigma_res")


def with_pair_modes(pairs: DataFrame, flags: DataFrame, mode: str = "none") -> DataFrame:
    """Pairs with the range correction mode of each: 'deltabp' or 'quad' where its folder has motion/use.deltabp or motion/use.quad, else the run's.

    flags(file) lists the files that are there; a pair's folder is that of its geodat_path.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    own = flags.select(F.regexp_extract("file", r"^(.*)/motion/use\.(?:deltabp|quad)$", 1).alias("folder"), F.regexp_extract("file", r"/motion/use\.(deltabp|quad)$", 1).alias("own")).where("own <> ''")
    own = own.groupBy("folder").agg(F.max("own").alias("own"))  # quad before deltabp
    found = pairs.withColumn("folder", folder("geodat_path")).join(own, "folder", "left")
    return found.withColumn("mode", F.coalesce("own", F.lit(mode))).drop("folder", "own")


def read_tie_points(spark: SparkSession, path: str | DataFrame, mode: str) -> DataFrame:
    """S17: 'height' rows have 3 numbers, 'motion' 7 or 6 (weight 1), 'vr' 5; other rows are left out."""
    names = {"height": ["lat", "lon", "z"], "motion": ["lat", "lon", "z", "vx", "vy", "vz", "weight"], "vr": ["lat", "lon", "z", "vr", "weight"]}[mode]
    f = F.split("line", r"\s+")
    least = len(names) - (mode == "motion")
    cols = [F.get(f, F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)]
    rows = _lines(spark, path).where(F.size(f) >= least).select("file", "seq", *cols)
    return rows.fillna({"weight": 1.0}) if mode == "motion" else rows


def read_ll_points(spark: SparkSession, path: str | DataFrame, dem: DataFrame | None = None, rot: float = 45.0, std_lat: float = 70.0, origin: tuple[float, float] = (0.0, 0.0), step: float = 1.0) -> DataFrame:
    """Lat, lon and z; without a z, that of dem(i, j, z) on a grid of step km from origin; points with z below 0 have null z and are invalid."""
    f = F.split("line", r"\s+")
    rows = _lines(spark, path).select("file", F.col("seq").alias("point_id"), *[F.get(f, F.lit(k)).cast("double").alias(n) for k, n in enumerate(("lat", "lon", "z"))])
    if dem is not None:
        from driftgrid.functions.geo import ll_to_xy
        from driftgrid.operators.sampling import sample_bilinear

        at = rows.withColumn("p", ll_to_xy(F.col("lat"), F.col("lon"), rot, std_lat)).select("point_id", ((F.col("p.x") - origin[0]) / step).alias("u"), ((F.col("p.y") - origin[1]) / step).alias("v"))
        found = sample_bilinear(at, dem, ["point_id"], ["z"]).withColumnRenamed("z", "_z")
        rows = rows.join(found, "point_id", "left").withColumn("z", F.coalesce("z", "_z")).drop("_z")
    return rows.withColumn("valid", F.coalesce(F.col("z") >= 0, F.lit(False))).withColumn("z", F.when(F.col("valid"), F.col("z")))


def read_sidecars(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Per scene folder the tide correction (0 where missing), whether a tide difference grid is there, and beta nought (100 to 1000)."""
    rows = _whole(spark, path).withColumn("scene_id", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)).withColumn("name", F.regexp_extract("file", r"([^/]+)$", 1))
    first = F.get(_numbers(F.col("text")), F.lit(0))
    pick = lambda n: F.max(F.when(F.col("name") == n, first))
    beta = pick("betaNought")
    return rows.groupBy("scene_id").agg(F.coalesce(pick("tide.correction"), F.lit(0.0)).alias("tide_correction"), F.coalesce(F.max((F.col("name") == "tide.difference").cast("int")), F.lit(0)).cast("boolean").alias("has_tide_difference"), F.when(beta.between(100, 1000), beta).alias("beta_nought"))


def read_antenna_patterns(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Antenna patterns, a file each: pattern_id, n (place in the file), range and gain of its rows."""
    f = F.split("line", r"\s+")
    rows = _lines(spark, path).where(F.size(f) >= 2).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("pattern_id"), "seq", F.get(f, F.lit(0)).cast("double").alias("range"), F.get(f, F.lit(1)).cast("double").alias("gain"))
    n = F.row_number().over(Window.partitionBy("pattern_id").orderBy("seq")) - 1  # a pattern has a few hundred rows
    return rows.select("pattern_id", n.alias("n"), "range", "gain")


def read_flattening_baselines(spark: SparkSession, path: str | DataFrame, omega: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """The baselines of each pair (folder), summed to a virtual one: linear (4 numbers: bn, bp, dbn, dbp) or quadratic (6).

    With omega the four numbers are bn, bp, dbn and the ramp omega. Pairs of initial(pair_id, bn, bp, dbn, dbp), made from state vectors, without a file start from those.
    """
    n = _numbers(F.element_at(F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith(";")), -1))
    rows = _whole(spark, path).select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("pair_id"), n.alias("n")).where(F.size("n").isin(4, 6))
    at = {c: F.get("n", F.lit(k)) for k, c in enumerate(("bn", "bp", "dbn", "dbp", "dbnq", "dbpq"))}
    at["omega"] = at["dbp"] if omega else F.lit(0.0)
    if omega:
        at["dbp"] = F.lit(0.0)
    summed = rows.groupBy("pair_id").agg(*[F.sum(F.coalesce(v, F.lit(0.0))).alias(c) for c, v in at.items()])
    if initial is None:
        return summed
    rest = initial.join(summed.select("pair_id"), "pair_id", "left_anti").select("pair_id", "bn", "bp", "dbn", "dbp", *[F.lit(0.0).alias(c) for c in ("dbnq", "dbpq", "omega")])
    return summed.unionByName(rest)
