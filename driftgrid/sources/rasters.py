"""Binary planes as cell tables: each file is a task's rows, read by Spark and unpacked by numpy; sentinels become NULL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No-data is at or below this.
NO_DATA = -1.9e9
TILE = 256


def _files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """path and content of files; in place of a path a table of them will do."""
    return path.select("path", "content") if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select("path", "content")


def _unpacked(raw: DataFrame, key: str, contents: list[str], columns: int | None, kind: str, names: tuple[str, ...], flip: bool, no_data: float) -> DataFrame:
    """raw(key, binary columns, width) as cells key, i, j and names; each content holds as many planes as there are names for it, all of a row are unpacked together."""
    each = len(names) // len(contents)

    def unpack(batches):
        for pdf in batches:
            for k in range(len(pdf)):
                wide = int(pdf["width"].iloc[k])
                planes = [np.frombuffer(c, kind).astype(float).reshape(each, -1, wide) if c is not None else None for c in (pdf[n].iloc[k] for n in contents)]
                rows = next((p.shape[1] for p in planes if p is not None), 0)
                values = np.concatenate([np.full((each, rows, wide), np.nan) if p is None else p for p in planes])
                if flip:
                    values = values[:, ::-1]
                values = np.where(values > no_data, values, np.nan)
                for start in range(0, rows, 1024):  # a block of rows at a time
                    part = values[:, start : start + 1024]
                    i, j = np.nonzero(~np.isnan(part).all(axis=0))
                    yield pd.DataFrame({key: pdf[key].iloc[k], "i": i + start, "j": j} | {n: part[m, i, j] for m, n in enumerate(names)})

    schema = f"{key} string, i int, j int, " + ", ".join(f"{n} double" for n in names)
    rows = raw if "width" in raw.columns else raw.withColumn("width", F.lit(columns))
    cells = rows.select(key, *contents, "width").mapInPandas(unpack, schema)
    return cells.select(key, "i", "j", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def read_planes(spark: SparkSession, path: str | DataFrame, columns: int, kind: str = ">f4", names: tuple[str, ...] = ("value",), flip: bool = False, no_data: float = NO_DATA) -> DataFrame:
    """Cells id, i, j and one value for each of the planes that a file holds one after another.

    kind is a numpy type ('>f4' big-endian floats, 'u1' masks); flip counts rows from the bottom. Cells that are no-data in all planes have no row.
    """
    raw = _files(spark, path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("id"), "content")
    return _unpacked(raw, "id", ["content"], columns, kind, names, flip, no_data)


def read_offset_cells(spark: SparkSession, path: str | DataFrame, columns: int, bands: tuple[str, ...] = ("da", "dr", "sa", "sr"), kind: str = ">f4") -> DataFrame:
    """Offset planes, a file per band (<pair>.<band>); bands that aren't asked for aren't read. The bands of a pair meet in one row and are unpacked together."""
    files = _files(spark, path if isinstance(path, DataFrame) else f"{path}/*.{{{','.join(bands)}}}")
    raw = files.select(F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1).alias("pair_id"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("band"), "content").where(F.col("band").isin(*bands))
    wide = raw.groupBy("pair_id").agg(*[F.max(F.when(F.col("band") == b, F.col("content"))).alias(f"of_{b}") for b in bands])
    return _unpacked(wide, "pair_id", [f"of_{b}" for b in bands], columns, kind, tuple(bands), False, NO_DATA)


def read_radar_images(spark: SparkSession, path: str | DataFrame, columns: int, kind: str = ">f4") -> DataFrame:
    """Phase or power planes; a file named nophase is all no-data and has no cells."""
    files = _files(spark, path).where(~F.lower("path").contains("nophase"))
    return read_planes(spark, files, columns, kind)


def read_grid_headers(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """grid_id, nx, ny, dx, dy (km, from m), origin_x, origin_y (km, of the first node's centre), flip and epsg, from 'key = value' headers.

    Keys: nx, ny, dx, dy, x0, y0 and epsg; a negative dy counts rows from the top, so that the grid is flipped and y0 is that of its last row. EPSG 3413 and 3031 give rotation and standard latitude.
    """
    from .text import _kv, key_values

    dx, dy, ny = _kv("dx"), _kv("dy"), _kv("ny", "int")
    low = F.when(dy < 0, _kv("y0") + (ny - 1) * dy).otherwise(_kv("y0"))
    epsg = _kv("epsg", "int")
    return key_values(spark, path).select(
        F.col("id").alias("grid_id"), _kv("nx", "int").alias("nx"), ny.alias("ny"), (dx / 1000).alias("dx"), (F.abs(dy) / 1000).alias("dy"), (_kv("x0") / 1000).alias("origin_x"), (low / 1000).alias("origin_y"), (dy < 0).alias("flip"), epsg.alias("epsg"),
        F.when(epsg == 3413, 45.0).when(epsg == 3031, 0.0).alias("rot"), F.when(epsg == 3413, 70.0).when(epsg == 3031, 71.0).alias("std_lat"),
    )


def read_grids(spark: SparkSession, path: str | DataFrame, headers: DataFrame, names: tuple[str, ...] = ("z",), kind: str = ">f4", no_data: float = NO_DATA) -> DataFrame:
    """Cells grid_id, i, j and values of grids whose widths and flips their headers give."""
    raw = _files(spark, path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("grid_id"), "content")
    sized = raw.join(headers.select("grid_id", F.col("nx").alias("width"), "ny", "flip"), "grid_id")
    cells = _unpacked(sized.select("grid_id", "content", "width"), "grid_id", ["content"], None, kind, names, False, no_data)
    own = headers.select("grid_id", "ny", "flip")
    return cells.join(own, "grid_id").withColumn("i", F.when(F.col("flip"), F.col("ny") - 1 - F.col("i")).otherwise(F.col("i")).cast("int")).drop("ny", "flip")


def read_velocity_grids(spark: SparkSession, path: str | DataFrame, columns: int, with_errors: bool = False, kind: str = ">f4") -> DataFrame:
    """Reference velocities, a file per layer (<grid>.vx, .vy and, with errors, .ex, .ey), as cells grid_id, i, j; a cell without both velocities has no row."""
    bands = ("vx", "vy", "ex", "ey") if with_errors else ("vx", "vy")
    return read_offset_cells(spark, path, columns, bands, kind).withColumnRenamed("pair_id", "grid_id").where("vx is not null and vy is not null")


def read_optical_cells(spark: SparkSession, path: str | DataFrame, columns: int, mask: DataFrame | None = None) -> DataFrame:
    """Dx, dy, sx, sy of matches; where a mask(match_id, i, j, value) is 0 all four are no-data."""
    cells = read_offset_cells(spark, path, columns, ("dx", "dy", "sx", "sy")).withColumnRenamed("pair_id", "match_id")
    return cells if mask is None else cells.join(mask.where("value = 0").select("match_id", "i", "j"), ["match_id", "i", "j"], "left_anti")


def crop(cells: DataFrame, i_min: int, i_max: int, j_min: int, j_max: int) -> DataFrame:
    """Cells in [i_min, i_max) x [j_min, j_max); on stored tiles the filter prunes folders and row groups."""
    out = cells.where(F.col("i").between(i_min, i_max - 1) & F.col("j").between(j_min, j_max - 1))
    if "ti" in cells.columns:
        out = out.where(F.col("ti").between(i_min // TILE, (i_max - 1) // TILE) & F.col("tj").between(j_min // TILE, (j_max - 1) // TILE))
    return out


def tile(i: str = "i", j: str = "j") -> list[Column]:
    return [F.floor(F.col(i) / TILE).cast("int").alias("ti"), F.floor(F.col(j) / TILE).cast("int").alias("tj")]
