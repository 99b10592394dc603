"""Sharding by extendible hashing: a directory over leading hash bits in which only oversized buckets split.

A document's hash is 60 bits of the MD5 of its doc_id and text, so that copies of one id spread too. A bucket is named by its depth d and
the first d bits. Starting with one bucket of depth 0, a bucket above the byte limit is split on its next bit, until every
bucket fits. Sizes are first summed in cells of equal leading bits, about 256 cells to a shard; the depths of cells follow
from their own sums. Only documents of cells that are themselves above the limit are looked at again, with more bits.

Rows that no bit can part (repeated rows, or one above the limit alone) share a bucket of full depth; repeated rows there are numbered and
go to overflow shards in order, one text to a shard where it is above the limit alone. Null texts have 0 bytes; null doc_ids hash as
the empty string. An empty table has no shards. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 60


def _hash(doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _split(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Depth per cell: cells(cell, bytes) have their first ``high`` bits; depths from low to high are tried, the smallest that fits counts.

    Each cell gives a row for each depth and sums are made before the shuffle; cells that fit at no depth get null.
    """
    tried = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = tried.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    return tried.join(fits, ["depth", "prefix"], "left").groupBy("cell").agg(F.min(F.when(F.col("total").isNotNull(), F.col("depth"))).alias("depth"))


def shard_documents(docs: DataFrame, limit: int, step: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, bytes, depth, shard (the bits as text, with the overflow number after a dot).

    Columns named in carry come along.
    """
    sized = docs.select("doc_id", *carry, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), _hash(F.col("doc_id"), F.col("text")).alias("hash"))
    sized = written(sized, "sized")
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    left, done = sized, None
    while True:
        cell = F.shiftright("hash", BITS - high)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"))
        depths = written(_split(cells, low, high, limit), "depths")
        placed = left.join(depths, F.shiftright("hash", BITS - high) == F.col("cell")).drop("cell")
        fits = placed.where("depth is not null")
        done = fits if done is None else done.unionByName(fits)
        if high == BITS or depths.where("depth is null").isEmpty():
            break
        left = written(placed.where("depth is null").drop("depth"), "split")
        low, high = high, min(BITS, high + step)
    bits = F.substring(F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), BITS, "0"), F.lit(1), F.col("depth"))
    fitting = done.select("doc_id", *carry, "bytes", "depth", bits.alias("shard"))
    if high < BITS or depths.where("depth is null").isEmpty():
        return fitting
    return fitting.unionByName(_overflow(placed.where("depth is null"), limit, carry))


def _overflow(rows: DataFrame, limit: int, carry: tuple[str, ...]) -> DataFrame:
    """Shards of rows that share all bits, hence the text: as many to a shard as fit.

    Rows are numbered within salted parts whose counts are summed, so no task holds a whole group.
    """
    salted = written(rows.drop("depth").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "overflow")
    own = F.row_number().over(Window.partitionBy("hash", "part").orderBy("at")) - 1
    counts = salted.groupBy("hash", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = salted.withColumn("own", own).join(counts.select("hash", "part", before.alias("before")), ["hash", "part"])
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))))
    name = F.concat(F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), BITS, "0"), F.lit("."), F.floor((F.col("before") + F.col("own")) / each).cast("string"))
    return numbered.select("doc_id", *carry, "bytes", F.lit(BITS).alias("depth"), name.alias("shard"))


def directory(shards: DataFrame) -> DataFrame:
    """One row per shard: shard, depth, documents and bytes."""
    return shards.groupBy("shard", "depth").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """The texts of docs, written with a folder per shard and a directory table beside them."""
    shards = written(shard_documents(docs, limit, carry=("text",)), "sharded")
    shards.repartition("shard").write.partitionBy("shard").parquet(f"{path}/documents")
    directory(shards).write.parquet(f"{path}/directory")


#: The same shards in SQL, for inputs without documents above the limit or repeated rows.
SHARDING_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents
), split(depth, prefix, total) AS (
  SELECT 0, CAST(0 AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM sized
  UNION ALL
  SELECT s.depth + 1, d.hash >> (59 - s.depth), CAST(sum(d.bytes) AS BIGINT)
  FROM split s JOIN sized d ON (d.hash >> (60 - s.depth)) = s.prefix
  WHERE s.total > {limit}
  GROUP BY s.depth, d.hash >> (59 - s.depth)
)
SELECT d.doc_id, d.bytes, s.depth, substr(lpad(bin(d.hash), 60, '0'), 1, s.depth) AS shard
FROM split s JOIN sized d ON (d.hash >> (60 - s.depth)) = s.prefix
WHERE s.total <= {limit}
"""
