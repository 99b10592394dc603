"""J11 on terrain: the place and height of radar grid samples on a DEM, by rounds over those that haven't settled.

At a height h the range sphere and zero Doppler give one place; T(h) is the DEM's height there. A sample settles where T(h) = h. T stays between the
least and the greatest height, so a bracket holds a solution from the start: each round narrows it, takes T(h) as the next height while that
converges, and else the chord of the bracket or its middle. A round is one kernel over Arrow batches and one bilinear join, of the open samples
only, and is kept in the shared folder; the rounds end when no sample is open.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.geo import ll_to_xy
from driftgrid.stages import kept

from .geocode import _kernel, _numbers, _on_ground, _orbit, flat_scenes
from .grid import sorted_in
from .sampling import sample_bilinear, sample_nearest

KEYS = ("scene_id", "sample_id", "azimuth", "range")
STATE = ("h", "low", "high", "f_low", "f_high", "before")


def _heights(at: DataFrame, scenes: DataFrame, dem: DataFrame, uv, keys: list[str], ladder: Column | None = None) -> DataFrame:
    """at(keys, h) with lat, lon and z, the height of the DEM (0 where it has none) at the place of height h; samples without a place have no row.

    With a ladder, at has no h and each row stands for all heights of the ladder.
    """

    def work(batch, scene):
        return dict(zip(("lat", "lon"), _on_ground(batch, scene, _numbers(batch, "h")[0]), strict=True))

    seen = at.join(sorted_in(flat_scenes(scenes)), "scene_id")
    seen = seen if ladder is None else seen.withColumn("h", ladder)  # after the join, so that a row is shuffled once
    located = _kernel(seen, keys, work, ("lat", "lon")).where("lat is not null")
    points = located.withColumn("p", uv(F.col("lat"), F.col("lon"))).select(*keys, "lat", "lon", F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    return sample_bilinear(points, dem, [*keys, "lat", "lon"], ["z"], policy="zero")


def _next(f: Column) -> dict[str, Column]:
    """The narrowed bracket, and the height to try next."""
    h = F.col("h")
    low, high = F.when(f > 0, h).otherwise(F.col("low")), F.when(f < 0, h).otherwise(F.col("high"))
    f_low, f_high = F.when(f > 0, f).otherwise(F.col("f_low")), F.when(f < 0, f).otherwise(F.col("f_high"))
    chord = low + (high - low) * f_low / (f_low - f_high)
    step = h + f
    fast = (F.abs(f) < 0.5 * F.col("before")) & (step > low) & (step < high)
    # a chord that hardly moves off an end would take many rounds
    inner = chord.isNotNull() & (chord > low + 0.1 * (high - low)) & (chord < high - 0.1 * (high - low))
    return {"h": F.when(fast, step).when(inner, chord).otherwise((low + high) / 2), "low": low, "high": high, "f_low": f_low, "f_high": f_high, "before": F.abs(f)}


def radar_grid_on_terrain(
    scenes: DataFrame, samples: DataFrame, dem: DataFrame, rot: float, std_lat: float, origin: tuple[float, float], step: float, mask: DataFrame | None = None,
    tolerance: float = 0.1, rounds: int = 40, flags: bool = True, levels: int = 16,
) -> DataFrame:
    """samples(scene_id, sample_id, range, azimuth) with lat, lon, height, round and, with flags, layover and shadow.

    dem(i, j, z) is a grid with its origin and step in km; places off it have height 0. Heights settle to within tolerance m; round says in which round.
    A sample that the range sphere doesn't bring to the ground, or that hasn't settled after so many rounds, has nulls. layover: the
    sphere meets the DEM more than once, as seen at so many levels between its least and greatest height; the place given is one of them. shadow: a nearer sample of the
    azimuth line is seen at a greater look angle. mask(i, j, code) adds its code, 0 where it has none.
    """

    def uv(lat: Column, lon: Column) -> Column:
        p = ll_to_xy(lat, lon, rot, std_lat)
        return F.struct(((p["x"] - origin[0]) / step).alias("u"), ((p["y"] - origin[1]) / step).alias("v"))

    least, most = dem.agg(F.least(F.min("z"), F.lit(0.0)) - 1, F.greatest(F.max("z"), F.lit(0.0)) + 1).first()
    least, most = (least, most) if least is not None else (-1.0, 1.0)
    number = lambda x: F.lit(x).cast("double")
    start = {"h": number(0.0), "low": number(least), "high": number(most), "f_low": number(None), "f_high": number(None), "before": number(1e300)}
    still = samples.select(*[F.col(k) for k in KEYS]).withColumns(start)
    done: list[DataFrame] = []
    for n in range(1, rounds + 1):
        f = F.col("z") - F.col("h")
        found = _heights(still, scenes, dem, uv, [*KEYS, *STATE])
        found = kept(found.withColumns({"f": f, "settled": F.abs(f) <= tolerance}))
        done.append(found.where("settled").select(*KEYS, "lat", "lon", F.col("h").alias("height"), F.lit(n).alias("round")))
        rest = found.where("not settled")
        if rest.isEmpty():
            break
        made = _next(F.col("f"))
        still = rest.select(*KEYS, *[c.alias(k) for k, c in made.items()])
    settled = done[0]
    for d in done[1:]:
        settled = settled.unionByName(d)
    if flags:
        settled = _flagged(kept(settled), scenes, dem, uv, least, most, levels)
    if mask is not None:
        points = settled.withColumn("p", uv(F.col("lat"), F.col("lon"))).select(*settled.columns, F.col("p.u").alias("u"), F.col("p.v").alias("v"))
        settled = sample_nearest(points, mask, "code").withColumnRenamed("code", "mask").drop("u", "v")
    return samples.join(sorted_in(settled.drop("range", "azimuth")), ["scene_id", "sample_id"], "left")


def _flagged(settled: DataFrame, scenes: DataFrame, dem: DataFrame, uv, least: float, most: float, levels: int) -> DataFrame:
    """settled with layover, from a ladder of heights, and shadow, from the look angles along each line of azimuth."""

    def work(batch, scene):
        azimuth, rng, h, lat = _numbers(batch, "azimuth", "range", "height", "lat")
        state = _orbit(scene["start"] + azimuth / scene["prf"], scene["t0"], scene["step"], scene["vectors"])
        top, slant = np.linalg.norm(state[:, :3], axis=1), scene["near"] + rng * scene["pixel"]
        s2 = np.sin(np.radians(lat)) ** 2
        earth = np.sqrt((6378137.0**4 * (1 - s2) + 6356752.3142**4 * s2) / (6378137.0**2 * (1 - s2) + 6356752.3142**2 * s2)) + h
        return {"look": np.arccos(np.clip((slant**2 + top**2 - earth**2) / (2 * slant * top), -1, 1))}

    columns = list(settled.columns)
    seen = _kernel(settled.join(sorted_in(flat_scenes(scenes)), "scene_id"), columns, work, ("look",))
    line = Window.partitionBy("scene_id", "azimuth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the image has columns
    seen = seen.withColumn("shadow", F.coalesce(F.col("look") < F.max("look").over(line), F.lit(False))).drop("look")
    # a height of the ladder is above the DEM at its place or not; more than one change from below to above means more than one place
    ladder = F.explode(F.array(*[F.lit(least + (most - least) * k / levels) for k in range(levels + 1)]))
    tried = _heights(settled.select(*KEYS), scenes, dem, uv, [*KEYS, "h"], ladder)
    sides = F.transform(F.array_sort(F.collect_list(F.struct("h", (F.col("z") > F.col("h")).alias("under")))), lambda x: x["under"])
    falls = tried.groupBy("scene_id", "sample_id").agg(sides.alias("s")).select("scene_id", "sample_id", F.size(F.filter(F.transform("s", lambda x, k: x & ~F.coalesce(F.get("s", k + 1), F.lit(True))), lambda x: x)).alias("falls"))
    return seen.join(sorted_in(falls), ["scene_id", "sample_id"], "left").withColumn("layover", F.coalesce(F.col("falls") > 1, F.lit(False))).drop("falls")
