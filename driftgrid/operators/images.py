"""Image mosaics: averaging, nearest date, priority of passes, smoothing and terrain areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def image_mosaic_average(images: DataFrame, as_gain: bool = True) -> DataFrame:
    """Per cell sum(value f weight) / sum(f) where the weight is a gain, else over sum(f weight)."""
    f, w = (F.col(c) if c in images.columns else F.lit(1.0) for c in ("f", "weight"))
    under = F.sum(f) if as_gain else F.sum(f * w)
    return images.groupBy("i", "j").agg(F.when(under > 0, F.sum(F.col("value") * f * w) / under).alias("value"))


def day_number(date: Column) -> Column:
    """365 days to a year, leap days left out."""
    return F.year(date) * 365 + F.dayofyear(date) - F.when((F.dayofyear(date) > 59) & (F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31))) == 366), 1).otherwise(0)


def nearest_date_mosaic(images: DataFrame, date: str) -> DataFrame:
    """Per cell the value of the image nearest in time; the first in input order among equals. A hash aggregate, no sort."""
    apart = F.abs(F.datediff(F.col("image_date"), F.lit(date).cast("date")))
    best = F.min(F.struct(apart.alias("apart"), F.col("image_id"), F.col("value")))
    return images.groupBy("i", "j").agg(best.alias("b")).select("i", "j", "b.image_id", "b.value", "b.apart")


def orbit_priority_mosaic(images: DataFrame, preferred: int) -> DataFrame:
    """Per cell the first image of the preferred pass, else of the other."""
    best = F.min(F.struct((F.col("pass_type") != preferred).alias("other"), F.col("image_id"), F.col("value")))
    return images.groupBy("i", "j").agg(best.alias("b")).select("i", "j", "b.image_id", "b.value")


def hybrid_mosaic(images: DataFrame, heights: DataFrame, z_threshold: int, date: str) -> DataFrame:
    """Cells above the height by average, others by nearest date."""
    high = heights.select("i", "j", (F.col("z").cast("int") > z_threshold).alias("high"))
    tagged = images.join(high, ["i", "j"])
    average = image_mosaic_average(tagged.where("high"))
    return average.unionByName(nearest_date_mosaic(tagged.where("not high"), date).select("i", "j", "value"))


def smooth_separable(image: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """image(keys, a, r, value) through a box of odd size along r, then a (size 1: weights 1/4, 1/2, 1/4 of neighbours); 0 unless all taps are valid."""
    half = max(1, size // 2)

    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        w = Window.partitionBy(*keys, other).orderBy(axis)
        near = w.rangeBetween(-half, half)
        valid = F.col("value") > 1e-6
        count = F.sum(F.when(valid, 1).otherwise(0)).over(near)
        total = F.sum("value").over(near)
        mean = (total + F.col("value")) / 4 if size == 1 else total / (2 * half + 1)
        return df.withColumn("value", F.when(count == 2 * half + 1, mean).otherwise(0.0))

    return along(along(image, "r", "a"), "a", "r")


def trim_pad(image: DataFrame, pad: int, width: int, looks: int = 1) -> DataFrame:
    """Zero in the first and last columns; wide images lose 120 single looks more."""
    pad = pad + (120 // looks if width * looks > 8500 else 0)
    return image.withColumn("value", F.when((F.col("r") < pad) | (F.col("r") >= width - pad), 0.0).otherwise(F.col("value")))


def rtc_area_sum(cells: DataFrame, columns: int = 3, rows: int = 2, least_db: float = -2.0, most_ratio: float = 0.65) -> DataFrame:
    """cells(i, j, r, a, ab, ag, db, shadow = 1) with ab_sum, ag_sum and their ratio.

    ab and ag are the facet areas on the beta and gamma planes, r and a the cell's range and azimuth. A bright cell of small ratio gathers the areas of
    its neighbours, so many columns (j, along x) and rows (i, along y) away, times the overlap of unit boxes in range; boxes that don't touch in range
    and azimuth don't overlap. A dark cell, or one of a large ratio, keeps its own areas. A cell in shadow (below 0) gathers nothing and has the ratio -1.
    """
    away = [(di, dj) for di in range(-rows, rows + 1) for dj in range(-columns, columns + 1) if (di, dj) != (0, 0)]
    lit = F.coalesce(F.col("shadow") >= -0.001, F.lit(True)) if "shadow" in cells.columns else F.lit(True)
    gathers = lit & (F.col("db") >= least_db) & (F.col("ab") / F.col("ag") <= most_ratio)
    # only cells that gather look around: few, beside all
    around = F.explode(F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j")) for di, dj in away]))
    asked = cells.where(gathers).select(F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("r").alias("cr"), F.col("a").alias("ca"), around.alias("at")).select("ci", "cj", "cr", "ca", "at.*")
    overlap = F.when(F.abs(F.col("ca") - F.col("a")) <= 1, F.greatest(1 - F.abs(F.col("cr") - F.col("r")), F.lit(0.0))).otherwise(0.0)
    met = asked.join(cells.select("i", "j", "r", "a", "ab", "ag"), ["i", "j"])
    more = met.groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.sum(F.col("ab") * overlap).alias("more_b"), F.sum(F.col("ag") * overlap).alias("more_g"))
    summed = cells.join(more, ["i", "j"], "left")
    summed = summed.withColumn("ab_sum", F.col("ab") + F.coalesce("more_b", F.lit(0.0))).withColumn("ag_sum", F.col("ag") + F.coalesce("more_g", F.lit(0.0)))
    return summed.withColumn("ratio", F.when(lit, F.col("ab_sum") / F.col("ag_sum")).otherwise(-1.0)).drop("more_b", "more_g")


def orbit_coverage(scenes: DataFrame, slack: float = 45.0) -> DataFrame:
    """Of scenes(scene_id, start, n_azimuth, azimuth_looks, prf, states) those whose state vectors miss the acquisition by more than slack s, with the gaps.

    start is in seconds of the day, states an array of structs with t. The first and the last vector count, as they stand in the file.
    """
    end = F.col("start") + F.col("n_azimuth") * F.col("azimuth_looks") / F.col("prf")
    gaps = scenes.select("scene_id", (F.get("states", F.lit(0))["t"] - F.col("start")).alias("late"), (end - F.get("states", F.size("states") - 1)["t"]).alias("early"))
    return gaps.where((F.col("late") > slack) | (F.col("early") > slack))


def images_on(images: DataFrame, first: str, last: str) -> DataFrame:
    """Images with a date in the window."""
    return images.where(F.col("image_date").between(first, last))
