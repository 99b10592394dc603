"""Sampling of gridded layers: bilinear as an equi-join on four corners, nearest, and layers attached to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import sorted_in


def sample_bilinear(points: DataFrame, cells: DataFrame, keys: list[str], values: list[str], grid_keys: list[str] | None = None, policy: str = "strict", rows: int | None = None, columns: int | None = None, shift: float = 0.0) -> DataFrame:
    """points(keys, u, v) in cell units (u along j, v along i) with values of cells(i, j); cells without a row, or null, are no-data.

    grid_keys (columns of both) name the grid. Policies: 'strict': null if a corner with weight is missing, edges use the pixel itself.
    'interior': also null beyond the last but one row or column (of ``rows``, ``columns``). 'max': the largest corner where one is missing.
    'zero': missing corners and places off the grid count as 0. ``shift`` moves u and v, for grids registered by pixel centres.
    """
    grid_keys = grid_keys or []
    p = points.withColumn("_u", F.col("u") + shift).withColumn("_v", F.col("v") + shift)
    if policy == "interior":
        p = p.where((F.col("_u") >= 0) & (F.col("_v") >= 0) & (F.col("_u") <= columns - 2) & (F.col("_v") <= rows - 2))
    p = p.withColumn("_j", F.floor("_u").cast("int")).withColumn("_i", F.floor("_v").cast("int"))
    p = p.withColumn("_t", F.col("_u") - F.col("_j")).withColumn("_s", F.col("_v") - F.col("_i"))
    corner = lambda di, dj, w: F.struct((F.col("_i") + di).alias("i"), (F.col("_j") + dj).alias("j"), w.alias("w"))
    t, s = F.col("_t"), F.col("_s")
    corners = F.array(corner(0, 0, (1 - t) * (1 - s)), corner(0, 1, t * (1 - s)), corner(1, 1, t * s), corner(1, 0, (1 - t) * s))
    spread = p.select(*keys, *[k for k in grid_keys if k not in keys], F.explode(F.filter(corners, lambda c: c["w"] > 0)).alias("c")).select("*", "c.*").drop("c")
    joined = spread.join(sorted_in(cells.select(*grid_keys, "i", "j", *values)), [*grid_keys, "i", "j"], "left")
    out = []
    for v in values:
        weighted = F.sum(F.col("w") * F.col(v))
        whole = F.count(v) == F.count(F.lit(1))
        out.append({"max": F.when(whole, weighted).otherwise(F.max(v)), "zero": F.coalesce(weighted, F.lit(0.0))}.get(policy, F.when(whole, weighted)).alias(v))
    return joined.groupBy(*keys).agg(*out)


def sample_squares(points: DataFrame, cells: DataFrame, grid_keys: list[str], values: list[str]) -> DataFrame:
    """J3 (strict) for wide points(grid_keys, u, v, ...): those of which no corner with weight is missing, without u and v, with values of cells(grid_keys, i, j).

    Cells go to the four squares that they are a corner of, so that points are neither multiplied nor grouped.
    """
    ends = [(0, 0), (0, 1), (1, 0), (1, 1)]
    square = F.explode(F.array(*[F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.lit(k).alias("corner")) for k, (di, dj) in enumerate(ends)]))
    of = cells.select(*grid_keys, square.alias("_square"), *values).groupBy(*grid_keys, F.col("_square.i").alias("_i"), F.col("_square.j").alias("_j"))
    squares = of.agg(*[F.max(F.when(F.col("_square.corner") == k, F.col(v))).alias(f"_{v}_{k}") for v in values for k in range(4)])
    own = [c for c in points.columns if c not in ("u", "v")]
    at = points.select(*own, F.floor("u").cast("int").alias("_j"), F.floor("v").cast("int").alias("_i"), (F.col("u") - F.floor("u")).alias("_t"), (F.col("v") - F.floor("v")).alias("_s"))
    weights = [(F.col("_s") if di else 1 - F.col("_s")) * (F.col("_t") if dj else 1 - F.col("_t")) for di, dj in ends]
    summed = lambda v: sum((F.when(w > 0, w * F.col(f"_{v}_{k}")).otherwise(0.0) for k, w in enumerate(weights)), F.lit(0.0))
    return at.join(sorted_in(squares), [*grid_keys, "_i", "_j"]).select(*own, *[summed(v).alias(v) for v in values]).dropna(subset=values)


def sample_nearest(points: DataFrame, mask: DataFrame, value: str, default: int = 0, grid_keys: list[str] | None = None) -> DataFrame:
    """points(u, v) with the value of the nearest cell, or the default where there is none."""
    grid_keys = grid_keys or []
    at = points.withColumn("i", (F.col("v") + 0.5).cast("int")).withColumn("j", (F.col("u") + 0.5).cast("int"))
    found = at.join(mask.select(*grid_keys, "i", "j", F.col(value).alias("_value")), [*grid_keys, "i", "j"], "left")
    return found.withColumn(value, F.coalesce("_value", F.lit(default))).drop("i", "j", "_value")


def attach_layers(cells: DataFrame, **layers: DataFrame) -> DataFrame:
    """cells(i, j) with the columns of co-registered layers(i, j, ...), null where a layer has no row."""
    for name, layer in layers.items():
        values = [c for c in layer.columns if c not in ("i", "j")]
        cells = cells.join(sorted_in(layer.select("i", "j", *[F.col(c).alias(c if len(values) > 1 else name) for c in values])), ["i", "j"], "left")
    return cells


def attach_params(pairs: DataFrame, key: str, required: list[DataFrame], optional: list[DataFrame]) -> DataFrame:
    """Pairs with parameter tables by key: rows need those required; others may be missing. Spark broadcasts what is small."""
    for t in required:
        pairs = pairs.join(t, key)
    for t in optional:
        pairs = pairs.join(t, key, "left")
    return pairs


def antenna_gain(points: DataFrame, pattern: DataFrame, r0: float, dr: float, size: int) -> DataFrame:
    """points(range) with the gain of pattern(n, gain) at the range's index, held to the table."""
    index = F.greatest(F.lit(0), F.least(((F.col("range") - r0) / dr).cast("int"), F.lit(size - 1)))
    return points.withColumn("n", index).join(pattern.select("n", "gain"), "n", "left")


def sample_ties(ties: DataFrame, headers: DataFrame, cells: DataFrame, values: list[str]) -> DataFrame:
    """ties(pair_id, tie_id, r, a) in looks with offsets of cells(pair_id, i, j) on the grid of headers(pair_id, r0, a0, delta_r, delta_a), in pixels."""
    at = ties.join(sorted_in(headers), "pair_id").select("pair_id", "tie_id", ((F.col("r") - F.col("r0")) / F.col("delta_r")).alias("u"), ((F.col("a") - F.col("a0")) / F.col("delta_a")).alias("v"))
    return sample_bilinear(at, cells, ["pair_id", "tie_id"], values, ["pair_id"])


def dem_slope(cells: DataFrame, dx: float, dy: float, keys: list[str] | None = None, forward: bool = False) -> DataFrame:
    """cells(i, j, z) with dzdx and dzdy from the neighbours in a row and a column; null where one is missing.

    Central differences, or forward ones. Cells are m, on nodes; a neighbour counts only if it is the next node.
    """
    from pyspark.sql import Window

    keys = keys or []
    across, along = Window.partitionBy(*keys, "i").orderBy("j"), Window.partitionBy(*keys, "j").orderBy("i")

    def slope(axis: str, w, step: float):
        at = lambda n: F.when(F.lead(axis, n).over(w) - F.col(axis) == n, F.lead("z", n).over(w)) if n > 0 else F.when(F.lag(axis, -n).over(w) - F.col(axis) == n, F.lag("z", -n).over(w))
        return (at(1) - F.col("z")) / step if forward else (at(1) - at(-1)) / (2 * step)

    return cells.withColumn("dzdx", slope("j", across, dx)).withColumn("dzdy", slope("i", along, dy))


def dem_slope_at(points: DataFrame, dem: DataFrame, keys: list[str], dx: float, dy: float, least: float = 90.0) -> DataFrame:
    """points(keys, u, v) in cells of a DEM(i, j, z) with nodes dx and dy m apart: dzdx, dzdy by central differences over a cell, or over ``least`` m.

    Heights half a step to each side are bilinear; a slope is null where one is missing.
    """
    du, dv = max(dx, least) / dx, max(dy, least) / dy
    sides = F.array(*[F.struct(F.lit(n).alias("side"), (F.col("u") + a * du / 2).alias("u"), (F.col("v") + b * dv / 2).alias("v")) for n, a, b in ((0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1))])
    ends = points.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    z = sample_bilinear(ends, dem, [*keys, "side"], ["z"])
    at = lambda n: F.max(F.when(F.col("side") == n, F.col("z")))
    return z.groupBy(*keys).agg(((at(0) - at(1)) / (dx * du)).alias("dzdx"), ((at(2) - at(3)) / (dy * dv)).alias("dzdy"))
