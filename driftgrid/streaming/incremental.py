"""ST1: a mosaic that grows with a stream. What is stored are sums per cell, in versions of tiles.

A batch reads the newest version of the tiles that it touches, adds its own sums and writes their next version under its number; what it hands on are
the cells that it touched. A batch that runs again finds the versions before its own and writes the same. Of a tile, the newest version and the
one before it are kept, so the folders are bounded by the tiles, however many batches there were, and reading needs no sum over batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.operators.mosaic import SUMS, finish, mosaic_sums
from driftgrid.sources.rasters import tile

Tile = tuple[int, int]


def _files(spark: SparkSession, path: str):
    """The path's file system and Path class, whatever store it is."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_of


def versions(spark: SparkSession, state: str) -> dict[Tile, list[int]]:
    """The numbers of the batches of which each tile has a version, in order: a listing of folders, none of data."""
    fs, path_of = _files(spark, state)
    found: dict[Tile, list[int]] = {}
    for f in fs.globStatus(path_of(f"{state}/batch=*/ti=*/tj=*")) or []:
        batch, ti, tj = map(int, re.search(r"batch=(\d+)/ti=(-?\d+)/tj=(-?\d+)$", f.getPath().toString()).groups())
        found.setdefault((ti, tj), []).append(batch)
    return {t: sorted(b) for t, b in found.items()}


def _tiles(spark: SparkSession, state: str, of: dict[Tile, int]) -> DataFrame | None:
    """The sums of tiles at the versions given."""
    paths = [f"{state}/batch={b}/ti={ti}/tj={tj}" for (ti, tj), b in of.items()]
    return spark.read.option("basePath", state).parquet(*paths).drop("batch") if paths else None


def add_batch(batch: DataFrame, number: int, state: str) -> DataFrame | None:
    """Adds observations(i, j, vx, vy, sx, sy ...) to the state as batch number; the mosaic's cells that they touched, None if there were none."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        sums = mosaic_sums(batch).select("*", *tile())
        touched = [(r.ti, r.tj) for r in sums.select("ti", "tj").distinct().collect()]  # numbers of tiles
        known = versions(spark, state)
        before = {t: [b for b in known.get(t, []) if b < number] for t in touched}
        stored = _tiles(spark, state, {t: b[-1] for t, b in before.items() if b})
        cells = ["i", "j", "ti", "tj"]
        parts = sums.select(*cells, *SUMS, F.lit(number).cast("long").alias("last"))
        if stored is not None:
            parts = parts.unionByName(stored.select(*cells, *SUMS, "last"))
        added = parts.groupBy(*cells).agg(*[F.sum(c).alias(c) for c in SUMS], F.max("last").alias("last"))
        added.repartition("ti", "tj").write.mode("overwrite").partitionBy("ti", "tj").parquet(f"{state}/batch={number}")
    finally:
        batch.unpersist()
    fs, path_of = _files(spark, state)
    for (ti, tj), b in before.items():
        for old in b[:-1]:
            fs.delete(path_of(f"{state}/batch={old}/ti={ti}/tj={tj}"), True)
    if not touched:
        return None
    return finish(_tiles(spark, state, dict.fromkeys(touched, number)).where(F.col("last") == number))


def start(observations: DataFrame, state: str, checkpoint: str, emit: Callable[[DataFrame, int], None] | None = None, **trigger):
    """Starts the stream of observations(i, j, vx, vy, sx, sy ...); emit(cells, number), if given, gets the touched cells of each batch."""

    def add(batch: DataFrame, number: int) -> None:
        cells = add_batch(batch, number, state)
        if emit is not None and cells is not None:
            emit(cells, number)

    return observations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, state: str, tiles: list[Tile] | None = None) -> DataFrame:
    """The mosaic as it stands, of all tiles or some: their newest versions, which are read as they are."""
    newest = {t: b[-1] for t, b in versions(spark, state).items() if tiles is None or t in tiles}
    found = _tiles(spark, state, newest)
    if found is None:
        number = ", ".join(f"{c} {'bigint' if c == 'n' else 'double'}" for c in SUMS)
        found = spark.createDataFrame([], f"i int, j int, {number}")
    return finish(found)
