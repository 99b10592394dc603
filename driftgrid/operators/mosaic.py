"""Feathering and error-weighted mosaicking. All accumulators are sums per cell, so rounds, batches and partial aggregates add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import feather

SUMS = ["vx_sum", "vy_sum", "x_scale", "y_scale", "x_error", "y_error", "dt_sum", "dt_scale", "vz_sum", "n"]


def edge_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of cells(keys, i, j, i_min, i_max, j_min, j_max) with valid data, those with an invalid neighbour; the box's border is no edge.

    A row's neighbours are counted along j, then those counts along i: two windows in place of nine copies of each cell.
    """
    beside = Window.partitionBy(*keys, "i").orderBy("j").rangeBetween(-1, 1)
    above = Window.partitionBy(*keys, "j").orderBy("i").rangeBetween(-1, 1)
    counted = cells.withColumn("_row", F.count(F.lit(1)).over(beside)).withColumn("_all", F.sum("_row").over(above))
    span = lambda c: F.least(F.col(c) + 1, F.col(f"{c}_max") - 1) - F.greatest(F.col(c) - 1, F.col(f"{c}_min")) + 1
    return counted.where(F.col("_all") < span("i") * span("j")).drop("_row", "_all")


def mosaic_sums(obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sums of obs(i, j, vx, vy, sx, sy, f, weight) per cell; dt and vz count where obs has them. Sigmas are of the velocities."""
    col = lambda c, d=0.0: F.col(c) if c in obs.columns else F.lit(d)
    px, py, fw = 1 / (F.col("sx") * F.col("sx")), 1 / (F.col("sy") * F.col("sy")), col("f", 1.0) * col("weight", 1.0)
    both = F.sqrt(px * py) * fw
    return obs.groupBy(*(by or []), "i", "j").agg(
        F.sum(F.col("vx") * px * fw).alias("vx_sum"), F.sum(F.col("vy") * py * fw).alias("vy_sum"), F.sum(px * fw).alias("x_scale"), F.sum(py * fw).alias("y_scale"),
        F.sum(px * fw * fw).alias("x_error"), F.sum(py * fw * fw).alias("y_error"), F.sum(col("dt") * both).alias("dt_sum"), F.sum(both).alias("dt_scale"),
        F.sum(col("vz")).alias("vz_sum"), F.count(F.lit(1)).alias("n"),
    )


def finish(sums: DataFrame) -> DataFrame:
    """A1-A4: vx, vy, their variances ex, ey, the mean dt and the plain mean of vz; null where nothing has weight."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    error = lambda a, b: F.when(F.col(b) > 0, F.col(a) / (F.col(b) * F.col(b)))
    return sums.select("i", "j", over("vx_sum", "x_scale").alias("vx"), over("vy_sum", "y_scale").alias("vy"), error("x_error", "x_scale").alias("ex"), error("y_error", "y_scale").alias("ey"), over("dt_sum", "dt_scale").alias("dt"), over("vz_sum", "n").alias("vz"), "n")


def mosaic_stats(obs: DataFrame) -> DataFrame:
    """A5: per cell the plain means, population variances (0 unless n > 1) and the count."""
    var = lambda c: F.when(F.count(F.lit(1)) > 1, F.var_pop(c)).otherwise(0.0)
    return obs.groupBy("i", "j").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"), var("vx").alias("ex"), var("vy").alias("ey"), F.count(F.lit(1)).alias("n"))


def add_sums(*parts: DataFrame) -> DataFrame:
    """Sums of several accumulators."""
    return reduce(DataFrame.unionByName, [p.select("i", "j", *SUMS) for p in parts]).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def refeather(sums: DataFrame, fl: int, box: tuple[int, int, int, int]) -> DataFrame:
    """An accumulator feathered at the edges of what it covers: sums times f, error sums times f squared."""
    names = ("i_min", "i_max", "j_min", "j_max")
    cells = feather(sums.select("*", *[F.lit(b).alias(n) for n, b in zip(names, box, strict=True)]).where("x_scale > 0"), [], fl)
    f = F.col("f")
    scaled = {c: F.col(c) * (f * f if c.endswith("error") else f) for c in SUMS if c not in ("vz_sum", "n")}
    return cells.withColumns(scaled).select("i", "j", *SUMS)


def merge_rounds(rounds: list[DataFrame], fl: int, box: tuple[int, int, int, int], seed: DataFrame | None = None) -> DataFrame:
    """Rounds of sums in order; before each, what has gathered so far is feathered. A seed (A7) goes first."""
    gathered = seed
    for sums in rounds:
        gathered = sums if gathered is None else add_sums(refeather(gathered, fl, box), sums)
    return gathered


def seed_from_reference(ref: DataFrame) -> DataFrame:
    """The sums that stand for a map ref(i, j, vx, vy, ex, ey) with sigmas ex, ey."""
    px, py = 1 / (F.col("ex") * F.col("ex")), 1 / (F.col("ey") * F.col("ey"))
    zero = F.lit(0.0)
    return ref.select("i", "j", (F.col("vx") * px).alias("vx_sum"), (F.col("vy") * py).alias("vy_sum"), px.alias("x_scale"), py.alias("y_scale"), px.alias("x_error"), py.alias("y_error"), zero.alias("dt_sum"), zero.alias("dt_scale"), zero.alias("vz_sum"), F.lit(1).cast("long").alias("n"))


def within_max_dt(mosaic: DataFrame, jd1: float, jd2: float) -> DataFrame:
    """All layers null where the mean date is too far from the window's middle."""
    ok = F.abs("dt") <= (jd2 - jd1 + 1) / 2 + 0.49
    return mosaic.withColumns({c: F.when(ok, F.col(c)) for c in ("vx", "vy", "ex", "ey", "dt")})


def valid_sample(df: DataFrame) -> DataFrame:
    """Rows whose offsets and heights are in range."""
    return df.where((F.abs("dr") < 13e4) & (F.abs("da") < 10e4) & (F.col("z") > -1000) & (F.col("z") <= 10000))


def mask_policy(df: DataFrame, tides: bool = True) -> DataFrame:
    """Rows that the mask lets through: not without solution, not grounding zone, floating ice only with tides."""
    return df.where(~F.col("code").isin(5, 2) & (F.lit(tides) | (F.col("code") != 1)))


def clip_to_reference(obs: DataFrame, ref: DataFrame, threshold: float) -> DataFrame:
    """P5: obs without those far from the reference where either is slow."""
    r = ref.select("i", "j", F.col("vx").alias("_rx"), F.col("vy").alias("_ry"))
    far = F.hypot(F.col("vx") - F.col("_rx"), F.col("vy") - F.col("_ry")) > threshold
    slow = (F.hypot("_rx", "_ry") < 100) | (F.hypot("vx", "vy") < 100)
    return obs.join(r, ["i", "j"], "left").where(~F.coalesce(far & slow, F.lit(False))).drop("_rx", "_ry")


def pairs_used(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Pairs with at least one observation."""
    return pairs.join(obs.select("pair_id").distinct(), "pair_id", "left_semi")


def pairs_dropped(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Pairs without."""
    return pairs.join(obs.select("pair_id").distinct(), "pair_id", "left_anti")


def run_summary(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Counts of pairs by pass and whether they were used."""
    used = obs.select("pair_id").distinct().withColumn("_used", F.lit(1))
    return pairs.join(used, "pair_id", "left").groupBy("pass_type").agg(F.count(F.lit(1)).alias("given"), F.count("_used").alias("used"), (F.count(F.lit(1)) - F.count("_used")).alias("dropped"))


def row_major(df: DataFrame) -> DataFrame:
    """Rows by i, then j."""
    return df.orderBy("i", "j")


def select_tie_cells(mosaic: DataFrame, threshold: float) -> DataFrame:
    """P10: cells slow and sure enough to serve as control points."""
    sure = (F.sqrt("ex") > 0) & (F.sqrt("ex") < 120) & (F.sqrt("ey") > 0) & (F.sqrt("ey") < 120)
    return mosaic.where((F.hypot("vx", "vy") < threshold) & sure & (F.abs("vz") < 0.04 * threshold))


def ties_in_bbox(ties: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """ties(x, y) inside x1, x2, y1, y2; all without a box."""
    return ties if box is None else ties.where(F.col("x").between(box[0], box[1]) & F.col("y").between(box[2], box[3]))


def all_pairs(ascending: DataFrame, descending: DataFrame) -> DataFrame:
    """Ascending pairs, then descending ones; repeated rows stay."""
    return ascending.unionByName(descending)


def observations(**families: DataFrame) -> DataFrame:
    """The observations of several solutions, each with the name of its family."""
    return reduce(DataFrame.unionByName, [df.withColumn("family", F.lit(name)) for name, df in families.items()])


def extra_ties(lines: DataFrame, box: tuple[float, float, float, float] | None = None, code: str | None = None, tide: float = 0.0) -> DataFrame:
    """Extra control points lines(seq, f, x, y, height, ...) as ties(lat, lon, z, vx, vy, vz, weight).

    f is the line's numbers: six (weight 1) or seven, or two, which stand for no motion at the DEM's height. Others, and the file's first line, are
    left out. On floating ice (``code`` names the mask's column) tide is added to vz. Points outside the box in x, y are left out.
    """
    n, get = F.size("f"), lambda k: F.get("f", F.lit(k))
    rows = lines.where((F.col("seq") > 0) & ((n >= 6) | (n == 2)))
    floating = (F.col(code) == 1) if code else F.lit(False)
    still = n == 2
    ties = rows.select(
        get(0).alias("lat"), get(1).alias("lon"), F.when(still, F.col("height")).otherwise(get(2)).alias("z"), *[F.when(still, 0.0).otherwise(get(k)).alias(c) for k, c in ((3, "vx"), (4, "vy"))],
        F.when(still, 0.0).otherwise(get(5) + F.when(floating, tide).otherwise(0.0)).alias("vz"), F.coalesce(get(6), F.lit(1.0)).alias("weight"), "x", "y",
    )
    return ties_in_bbox(ties, box).drop("x", "y")


def all_ties(mosaic_ties: DataFrame, extra: DataFrame) -> DataFrame:
    """The mosaic's control points and extra ones; columns that either lacks are null."""
    return mosaic_ties.unionByName(extra, allowMissingColumns=True)


def date_range(pairs: DataFrame) -> DataFrame:
    """The first day of pairs(jd1, n_days) and the last, as jd1 and jd2."""
    return pairs.agg(F.min("jd1").alias("jd1"), F.max(F.col("jd1") + F.col("n_days")).alias("jd2"))


def infer_hemisphere(scenes: DataFrame, order: str = "input_seq") -> DataFrame:
    """Hemisphere, rotation and standard latitude by the sign of the first scene's (or tie's) latitude; without any, has_scenes is false and they are null."""
    first = scenes.agg(F.min_by("lat", order).alias("lat"))
    south = F.col("lat") < 0
    pick = lambda a, b: F.when(south, a).when(F.col("lat").isNotNull(), b)
    return first.select(pick("south", "north").alias("hemisphere"), pick(0, 45).alias("rot"), pick(71, 70).alias("std_lat"), F.col("lat").isNotNull().alias("has_scenes"))
