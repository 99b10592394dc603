"""Placing pairs, boxes and triangles on grid cells; every range join is an explosion of integer bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_in(table: DataFrame) -> DataFrame:
    """A table that a join sorts with the other side. Spark takes a table that it explodes to be as small as it was, and would send all of it to every task."""
    return table.hint("merge")


def cells_for_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with a row for each cell i, j in [i_min, i_max) x [j_min, j_max)."""
    span = lambda a, b: F.when(F.col(b) > F.col(a), F.sequence(F.col(a).cast("int"), F.col(b).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return pairs.withColumn("i", F.explode(span("i_min", "i_max"))).withColumn("j", F.explode(span("j_min", "j_max")))


def boxes_intersect(a: str, b: str) -> Column:
    """U4: whether boxes of the two prefixes share cells."""
    return (F.greatest(f"{a}i_min", f"{b}i_min") < F.least(f"{a}i_max", f"{b}i_max")) & (F.greatest(f"{a}j_min", f"{b}j_min") < F.least(f"{a}j_max", f"{b}j_max"))


def intersection(a: str, b: str) -> list[Column]:
    """U4: the inner bounds of two boxes."""
    return [(F.greatest if n.endswith("min") else F.least)(f"{a}{n}", f"{b}{n}").alias(n) for n in ("i_min", "i_max", "j_min", "j_max")]


def overlaps_grid(pairs: DataFrame, rows: int, columns: int, pad: int = 0) -> DataFrame:
    """Pairs whose padded box reaches the grid, clamped to it."""
    low = lambda c: F.greatest(F.col(c) - pad, F.lit(0)).cast("int")
    high = lambda c, n: F.least(F.col(c) + pad, F.lit(n)).cast("int")
    boxed = pairs.withColumns({"i_min": low("i_min"), "i_max": high("i_max", rows), "j_min": low("j_min"), "j_max": high("j_max", columns)})
    return boxed.where("i_min < i_max and j_min < j_max")


def crossing_candidates(pairs: DataFrame, max_days: float, min_weight: float, tile: int) -> DataFrame:
    """Pairs met through an index of grid tiles and time buckets: a_*, b_* and the tile, once for each tile and bucket that both are in.

    A pair is in the index once for each tile of its box. Buckets are as long as max_days; one side also looks into the buckets beside its own.
    """
    usable = pairs.where((F.col("cross_flag") == 1) & (F.col("weight") >= min_weight))
    bucket = F.floor(F.col("jd1") / max_days)
    names = ["pair_id", "pass_type", "jd1", "weight", "i_min", "i_max", "j_min", "j_max"]
    tiles = lambda c: F.sequence(F.floor(F.col(f"{c}_min") / tile), F.floor((F.col(f"{c}_max") - 1) / tile))
    placed = usable.where("i_min < i_max and j_min < j_max").withColumn("ti", F.explode(tiles("i"))).withColumn("tj", F.explode(tiles("j")))
    a = placed.select(*[F.col(n).alias(f"a_{n}") for n in names], "ti", "tj", bucket.alias("bucket"))
    b = placed.select(*[F.col(n).alias(f"b_{n}") for n in names], "ti", "tj", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    return a.join(b, ["ti", "tj", "bucket"]).where(F.col("a_pair_id") < F.col("b_pair_id"))


def crossing_pairs(pairs: DataFrame, max_days: float = 12.0, min_weight: float = 0.05, pad: int = 0, any_pass: bool = False, tile: int = 64) -> DataFrame:
    """Unordered pairs a < b of opposite passes, near in time, whose boxes meet; with the inner box and the joint weight.

    Candidates share a tile of the grid and a span of time, so a long max_days (548 for phase) doesn't make all pairs meet. Two boxes that share more
    tiles are taken in the tile of the first cell that they share.
    """
    met = crossing_candidates(pairs, max_days, min_weight, tile)
    near = (F.abs(F.col("a_jd1") - F.col("b_jd1")) <= max_days) & boxes_intersect("a_", "b_")
    owner = (F.floor(F.greatest("a_i_min", "b_i_min") / tile) == F.col("ti")) & (F.floor(F.greatest("a_j_min", "b_j_min") / tile) == F.col("tj"))
    if not any_pass:
        near &= F.col("a_pass_type") != F.col("b_pass_type")
    box = intersection("a_", "b_")
    if pad:
        box = [(c - pad if k % 2 == 0 else c + pad).alias(n) for k, (c, n) in enumerate(zip(box, ("i_min", "i_max", "j_min", "j_max"), strict=True))]
    return met.where(near & owner).select("a_pair_id", "b_pair_id", F.sqrt(F.col("a_weight") * F.col("b_weight")).alias("weight"), *box)


def auto_bounds(points: DataFrame, dx: float, dy: float, margin: float = 3.0) -> DataFrame:
    """Origin and size of a grid around points(x, y) in km: bounds cut to whole km with a margin, sizes rounded."""
    box = points.agg(*[getattr(F, f)(c).alias(f"{c}_{f}") for c in "xy" for f in ("min", "max")])
    low = lambda c: (F.col(f"{c}_min") - margin).cast("int")
    high = lambda c: (F.col(f"{c}_max") + margin).cast("int")
    return box.select(low("x").alias("origin_x"), low("y").alias("origin_y"), ((high("x") - low("x")) / dx + 0.5).cast("int").alias("nx"), ((high("y") - low("y")) / dy + 0.5).cast("int").alias("ny"))


def point_in_triangle(triangles: DataFrame, max_edge: float | None = None, max_area: float | None = None) -> DataFrame:
    """Cells inside triangles(set_id, tri_id, x1, y1, vx1, vy1, x2 ...), edges included, with vx, vy of the plane; cell units.

    Only triangles with edges below max_edge and area up to max_area are used.
    """
    t = triangles
    edge = lambda a, b: F.hypot(F.col(f"x{a}") - F.col(f"x{b}"), F.col(f"y{a}") - F.col(f"y{b}"))
    twice = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    if max_edge is not None:
        t = t.where(F.greatest(edge(1, 2), edge(2, 3), edge(3, 1)) < max_edge)
    if max_area is not None:
        t = t.where(F.abs(twice) / 2 <= max_area)
    bound = lambda c: (F.floor(F.least(*[f"{c}{k}" for k in (1, 2, 3)])).cast("int"), F.ceil(F.greatest(*[f"{c}{k}" for k in (1, 2, 3)])).cast("int"))
    t = t.where(twice != 0).withColumn("i", F.explode(F.sequence(*bound("y")))).withColumn("j", F.explode(F.sequence(*bound("x"))))
    x, y = F.col("j"), F.col("i")
    side = lambda a, b: (F.col(f"x{b}") - F.col(f"x{a}")) * (y - F.col(f"y{a}")) - (x - F.col(f"x{a}")) * (F.col(f"y{b}") - F.col(f"y{a}"))
    w3, w1, w2 = side(1, 2) / twice, side(2, 3) / twice, side(3, 1) / twice
    inside = t.where((w1 >= 0) & (w2 >= 0) & (w3 >= 0))
    plane = lambda v: (w1 * F.col(f"{v}1") + w2 * F.col(f"{v}2") + w3 * F.col(f"{v}3")).alias(v)
    return inside.select("set_id", "tri_id", "i", "j", plane("vx"), plane("vy"))


def separation_samples(pairs: DataFrame) -> DataFrame:
    """About 4 x 4 cells over the common box of each of pairs(a_pair_id, b_pair_id, i_min, i_max, j_min, j_max)."""
    at = lambda n: F.explode(F.sequence(F.col(f"{n}_min"), F.col(f"{n}_max") - 1, F.greatest(F.floor((F.col(f"{n}_max") - F.col(f"{n}_min")) / 4).cast("int"), F.lit(1)))).alias(n)
    return pairs.select("*", at("i")).select("*", at("j"))


def separated_pairs(samples: DataFrame, least: float = 0.7) -> DataFrame:
    """(a_pair_id, b_pair_id, alpha) of pairs whose headings at the last sample that has both, by i and j, differ enough.

    samples(a_pair_id, b_pair_id, i, j, a_heading, b_heading); a null heading is outside the image.
    """
    last = F.max_by(F.col("a_heading") - F.col("b_heading"), F.struct("i", "j")).alias("alpha")
    found = samples.where("a_heading is not null and b_heading is not null").groupBy("a_pair_id", "b_pair_id").agg(last)
    return found.where(F.abs("alpha").between(least, 2 * math.pi - least))
