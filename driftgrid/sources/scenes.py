"""One typed table of scenes from three layouts: GeoJSON features, text metadata in a fixed order, and old parameter files.

All give the same columns (SCENE_COLUMNS): a layout without one has it null. What is wrong with a file stands in ``problem``; of a scene in more than one
layout GeoJSON wins, then text, then parameter files. radar_scenes() turns good scenes into the columns that the geocoding kernels read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import SCENE, _numbers, _whole

#: Least and most state vectors of a scene.
STATES = (5, 75)
POINT = "struct<lat:double,lon:double>"
STATE = "struct<t:double,x:double,y:double,z:double,vx:double,vy:double,vz:double>"
SCENE_COLUMNS = {
    "scene_id": "string", "source": "string", "label": "string", "image_date": "date", "seconds": "double", "range_size": "int", "azimuth_size": "int", "range_looks": "int",
    "azimuth_looks": "int", "slp_r": "double", "slp_a": "double", "rc": "double", "altitude": "double", "re_major": "double", "re_minor": "double", "range_error": "double",
    "prf": "double", "wavelength": "double", "pass_type": "string", "look_dir": "string", "control_points": f"array<{POINT}>", "states": f"array<{STATE}>",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _typed(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """rows with the scene's columns, what follows from them, and problem."""
    df = rows.select(*[(made[n] if n in made else F.lit(None)).cast(t).alias(n) for n, t in SCENE_COLUMNS.items()])
    pixel = F.col("range_looks") * F.col("slp_r")
    half = (F.col("range_size") - 1) * pixel / 2
    jd = F.datediff("image_date", F.lit("1970-01-01").cast("date")) + 2440588 + F.col("seconds") / 86400
    df = df.withColumns({"range_pixel": pixel, "azimuth_pixel": F.col("azimuth_looks") * F.col("slp_a"), "rn": F.col("rc") - half, "rf": F.col("rc") + half, "jd": jd})
    whole = F.forall("states", lambda s: s["x"].isNotNull() & s["y"].isNotNull() & s["z"].isNotNull() & s["vx"].isNotNull() & s["vy"].isNotNull() & s["vz"].isNotNull())
    wrong = [F.when(F.col(n).isNull(), n) for n in ("image_date", "seconds", "range_size", "azimuth_size", "range_looks", "azimuth_looks", "slp_r", "slp_a", "rc", "prf", "wavelength", "pass_type", "look_dir")]
    wrong += [F.when(~F.coalesce((F.size("control_points") == 5) & F.forall("control_points", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), F.lit(False)), "control_points")]
    wrong += [F.when(~F.coalesce(F.size("states").between(*STATES) & whole, F.lit(False)), "states")]
    return df.withColumn("problem", F.nullif(F.concat_ws(", ", *wrong), F.lit("")))


def _direction(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("descending"), "descending").when(low.contains("ascending"), "ascending")


def _side(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("left"), "left").when(low.contains("right"), "right")


def _date(text: Column) -> Column:
    """Day, month by name, year."""
    part = lambda k: F.regexp_extract(F.lower(text), rf"(\d{{1,2}})[\s:.-]*({'|'.join(MONTHS)})[a-z]*[\s:.,-]*(\d{{4}})", k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(2))
    return F.when(part(1) != "", F.make_date(part(3).cast("int"), month.cast("int"), part(1).cast("int")))


def _seconds(text: Column, delta: Column) -> Column:
    """h m s as seconds of the day, with a correction; no carry is needed."""
    n = _numbers(F.regexp_replace(text, ":", " "))
    return F.get(n, F.lit(0)) * 3600 + F.get(n, F.lit(1)) * 60 + F.get(n, F.lit(2)) + delta


def geojson_scenes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Scenes of GeoJSON features, a file each (or a table file, text). The range error is taken from the range of the centre."""
    if isinstance(path, DataFrame):
        rows = path.select("file", F.from_json("text", SCENE).alias("f")).select("file", "f.*")
    else:
        rows = spark.read.schema(SCENE).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "*")
    get = lambda n: F.try_element_at("properties", F.lit(n))
    number = lambda n: get(n).try_cast("double")
    place = lambda kind, k: _numbers(F.try_element_at("properties", F.concat(F.lit(f"SV_{kind}_"), k.cast("string"))))
    state = lambda k: F.struct(
        (number("TimeOfFirstStateVector") + (k - 1) * number("StateVectorInterval")).alias("t"),
        *[F.get(place(kind, k), F.lit(n)).alias(c) for kind, names in (("Pos", ("x", "y", "z")), ("Vel", ("vx", "vy", "vz"))) for n, c in enumerate(names)],
    )
    count = F.least(F.coalesce(number("NumberOfStateVectors").cast("int"), F.lit(0)), F.lit(STATES[1] + 1))
    states = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), state))
    ring = F.get(F.col("geometry.coordinates"), F.lit(0))
    corner = lambda k: F.struct(F.get(F.get(ring, F.lit(k)), F.lit(1)).alias("lat"), F.get(F.get(ring, F.lit(k)), F.lit(0)).alias("lon"))
    centre = _numbers(get("CenterLatLon"))
    points = F.array(F.struct(F.get(centre, F.lit(0)).alias("lat"), F.get(centre, F.lit(1)).alias("lon")), *[corner(k) for k in (0, 3, 1, 2)])
    error = F.coalesce(number("RangeErrorCorrection"), F.lit(0.0))
    own = F.coalesce(number("deltaT"), F.lit(0.0))
    delta = F.when(F.abs(own) < 1e-6, own + (number("NumberAzimuthLooks") - 1) * 0.5 / number("PRF")).otherwise(own)
    return _typed(rows, {
        "scene_id": F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1), "source": F.lit("geojson"), "label": get("ImageName"), "image_date": get("Date").try_cast("date"), "seconds": _seconds(get("CorrectedTime"), delta),
        "range_size": number("MLRangeSize"), "azimuth_size": number("MLAzimuthSize"), "range_looks": number("NumberRangeLooks"), "azimuth_looks": number("NumberAzimuthLooks"),
        "slp_r": number("SLCRangePixelSize"), "slp_a": number("SLCAzimuthPixelSize"), "rc": number("MLCenterRange") - error, "range_error": error, "altitude": number("SpaceCraftAltitude"),
        "re_major": number("EarthRadiusMajor") / 1000, "re_minor": number("EarthRadiusMinor") / 1000, "prf": number("PRF"), "wavelength": number("Wavelength"),
        "pass_type": _direction(get("PassType")), "look_dir": _side(get("LookDirection")), "control_points": points, "states": states,
    })


def text_scenes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Scenes of text metadata: a label (from its 15th character), a date, then data lines in a fixed order; lines that begin with ; are comments.

    The lines: sizes and looks; Earth radii, range and latitude of the centre, height (km) and perhaps the range error (m); four corners and the centre;
    pixel sizes; pass; look; a state flag; time; PRF; wavelength; number, first time and interval of the state vectors, two lines for each;
    perhaps deltaT, in place of the correction from single to multiple looks.
    """
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n")
    data = F.filter(F.slice(lines, 3, 1 << 20), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith(";"))
    rows = _whole(spark, path).select(F.col("id").alias("file_id"), lines.alias("head"), data.alias("d"))
    line = lambda k: F.get("d", k if isinstance(k, Column) else F.lit(k))
    n = lambda k, m=0: F.get(_numbers(line(k)), F.lit(m))
    count = F.least(F.coalesce(n(14).cast("int"), F.lit(0)), F.lit(STATES[1] + 1))
    state = lambda k: F.struct((n(15) + k * n(16)).alias("t"), *[n(17 + 2 * k + half, m).alias(c) for half, names in enumerate((("x", "y", "z"), ("vx", "vy", "vz"))) for m, c in enumerate(names)])
    last = line(17 + 2 * count)
    delta = F.when(last.contains("deltaT"), F.get(_numbers(F.regexp_replace(last, "^.*deltaT", "")), F.lit(0))).otherwise((n(0, 3) - 1) * 0.5 / n(12))
    point = lambda k: F.struct(n(k, 0).alias("lat"), n(k, 1).alias("lon"))
    error = F.coalesce(n(1, 5), F.lit(0.0))
    return _typed(rows, {
        "scene_id": F.col("file_id"), "source": F.lit("text"), "label": F.expr("substring(head[0], 15)"), "image_date": _date(F.get("head", F.lit(1))), "seconds": _seconds(line(11), delta),
        "range_size": n(0, 0), "azimuth_size": n(0, 1), "range_looks": n(0, 2), "azimuth_looks": n(0, 3), "slp_r": n(7, 0), "slp_a": n(7, 1), "rc": n(1, 2) * 1000 - error, "range_error": error,
        "altitude": n(1, 4) * 1000, "re_major": n(1, 0), "re_minor": n(1, 1), "prf": n(12), "wavelength": n(13), "pass_type": _direction(line(8)), "look_dir": _side(line(9)),
        "control_points": F.array(point(6), *[point(k) for k in (2, 3, 4, 5)]), "states": F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), state)),
    })


def par_scenes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """What old parameter files say of a scene in their fixed lines: label, date, time, height and PRF; the rest is null, and problem says so."""
    rows = _whole(spark, path).select("id", F.split(F.regexp_replace("text", "\r", ""), "\n").alias("d"))
    line = lambda k: F.get("d", F.lit(k))
    n = lambda k: F.get(_numbers(line(k)), F.lit(0))
    return _typed(rows, {"scene_id": F.col("id"), "source": F.lit("par"), "label": line(0), "image_date": _date(line(1)), "seconds": _seconds(line(2), F.lit(0.0)), "altitude": n(6), "prf": n(11)})


def all_scenes(*layouts: DataFrame) -> DataFrame:
    """Scenes of several layouts, in the order of precedence, one row for each scene_id: a min over ranks, no window."""
    ranked = None
    for k, df in enumerate(layouts):
        own = df.withColumn("rank", F.lit(k))
        ranked = own if ranked is None else ranked.unionByName(own)
    columns = layouts[0].columns
    best = ranked.groupBy("scene_id").agg(F.min_by(F.struct(*columns), "rank").alias("s"))
    return best.select("s.*")


def radar_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes without a problem in the columns of the geocoding kernels; times in seconds of the day, pixels in multiple looks."""
    places = {c: F.col(f"control_points.{c}") for c in ("lat", "lon")}
    ends = {f"{c}_{n}": f(p) for c, p in places.items() for n, f in (("min", F.array_min), ("max", F.array_max))}
    states = F.transform("states", lambda s: F.struct(*[s[n].alias(n) for n in ("x", "y", "z", "vx", "vy", "vz")]))
    good = scenes.where("problem is null").withColumns(ends)
    first, second = F.get("states", F.lit(0)), F.get("states", F.lit(1))
    return good.select(
        "scene_id", *ends, first["t"].alias("t0"), (second["t"] - first["t"]).alias("step"), states.alias("states"), F.col("seconds").alias("start"), (F.col("prf") / F.col("azimuth_looks")).alias("prf"),
        F.col("rn").alias("near"), F.col("range_pixel").alias("pixel"), F.col("range_size").alias("n_range"), F.col("azimuth_size").alias("n_azimuth"), (F.col("look_dir") == "left").alias("look_left"),
    )
