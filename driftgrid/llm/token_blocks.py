"""Token-ID / binary output: ids in the minimum bits of the vocabulary, in blocks that can be read at random.

A token table is a folder with two datasets. ``blocks`` has a row per block of whole documents: ``shard`` and ``block``
(its place), ``before`` (the ids of the shard before it), ``bits``, ``n_ids``, ``doc_ids``, ``ends`` (per document the ids of the block up to its end) and
``payload``: id k takes bits [k * bits, (k + 1) * bits), lowest bit first. ``shards`` has a row per shard with
``first_id``, the ids of all shards before it. Ids of place p in a block are found without reading what precedes them.
Spark's writer commits the files, so a lost executor or a second attempt leaves no half-written block.

Rows are in ascending order of doc_id (null first), then of text. Null and empty texts have the end id alone. Repeated rows
are separate documents. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, shared_dir
from .tokens import encoder

BLOCKS = "shard int, block int, before bigint, bits int, n_ids bigint, doc_ids array<bigint>, ends array<bigint>, payload binary"
READ = "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as fixed-width fields, lowest bit first; ids that don't fit are an error."""
    ids = np.ascontiguousarray(ids, "<u4")
    if not 1 <= bits <= 32 or (len(ids) and int(ids.max()) >> bits):
        raise ValueError(f"ids need more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = np.unpackbits(ids.view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(fields.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids of the places start to stop of a payload, touching only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype("<u4")
    first = start * bits // 8
    held = np.frombuffer(payload, "u1", -(-stop * bits // 8) - first, first).astype("<u8")
    held = np.concatenate([held, np.zeros(8, "<u8")])
    at = np.arange(start, stop, dtype=np.int64) * bits - first * 8
    byte, shift = at >> 3, (at & 7).astype("<u8")
    wide = np.zeros(len(at), "<u8")
    for k in range(5):
        wide |= held[byte + k] << np.uint64(8 * k)
    return ((wide >> shift) & np.uint64((1 << bits) - 1)).astype("<u4")


def write_token_table(docs: DataFrame, tokenizer: str, path: str, block_ids: int = 1 << 16) -> None:
    """Encodes every whole text of docs(doc_id, text) and writes the token table at path.

    One shuffle puts the documents in order (spark.sql.shuffle.partitions ranges); a range becomes a shard.
    """

    def packed(batches):
        enc = encoder(tokenizer)
        bits = max(1, (enc.size - 1).bit_length())
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, ends, ids, total = [], [], [], 0

        def row():
            joined = np.concatenate(ids)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "before": before, "bits": bits, "n_ids": total, "doc_ids": doc_ids, "ends": ends, "payload": pack(joined, bits)}],
                schema=schema,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = enc.encode(text)
                doc_ids.append(doc_id)
                ids.append(own)
                total += len(own)
                ends.append(total)
                if total >= block_ids:
                    yield row()
                    block, before = block + 1, before + total
                    doc_ids, ends, ids, total = [], [], [], 0
        if ids:
            yield row()

    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())]
    )
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    spark = docs.sparkSession
    with arrow_rows(spark, 500):
        ordered.mapInArrow(packed, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    totals.select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id")).write.parquet(f"{path}/shards")


def read_token_table(spark, path: str) -> DataFrame:
    """Documents of a token table: doc_id, start (the ids of all documents before it), n_tokens, ids (32-bit, little-endian)."""

    def rows(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ends = b["ends"]
                starts = [0, *ends[:-1]]
                ids = unpack(b["payload"], b["bits"], 0, b["n_ids"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(b["doc_ids"], pa.int64()),
                        "shard": pa.array([b["shard"]] * len(ends), pa.int32()),
                        "start_in_shard": pa.array([b["before"] + s for s in starts], pa.int64()),
                        "n_tokens": pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        "ids": pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
                    }
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    docs = blocks.mapInArrow(rows, READ)
    shards = spark.read.parquet(f"{path}/shards").select("shard", "first_id")
    return docs.join(shards, "shard").select("doc_id", (F.col("first_id") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


def token_table_digest(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the token table and returns, from the files, doc_id, start, n_tokens and the crc32 of each document's ids."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/driftgrid-tokens-{uuid.uuid4().hex}"
    write_token_table(docs, tokenizer, path)
    return read_token_table(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
