"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut. What packing depends on is how many
pieces there are of each length, at most ``capacity`` numbers at any corpus size. From these, bins are filled one pattern
at a time: the longest piece left opens the bin, a bitset subset-sum over the lengths left finds the fullest combination
beside it, and the pattern is repeated while its lengths last, which is what filling bin after bin would do. Every pattern
uses up a length, so there are few patterns, and they are the plan. Pieces find their place in it by their rank among
those of the same length, which comes from counts per (partition, length), never from one task holding a length.

Null and empty texts are one end id. Repeated rows and null doc_ids are documents like others; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, written
from .tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, rank bigint"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pieces of docs(doc_id, text): the first of a cut document holds what is over; ids are 32-bit, little-endian."""

    def cut(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids", "part", "rank")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text).astype("<u4")
                start, stop, piece = 0, len(ids) % capacity or min(len(ids), capacity), 0
                while start < len(ids):
                    n = stop - start
                    for k, v in zip(out.values(), (doc_id, piece, start, n, ids[start:stop].tobytes(), part, seen[n]), strict=True):
                        k.append(v)
                    seen[n] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("rank", pa.int64())]
    )
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """The lengths, longest first, of a combination of the counted pieces whose sum is the largest up to room.

    reach is a bitset of the sums that can be made; what each length added is kept to find the way back.
    """
    reach, steps, full = 1, [], (1 << room + 1) - 1
    for n in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        for _ in range(min(counts[n], room // n)):
            more = (reach | reach << n) & full
            if more == reach:
                break
            steps.append((n, more & ~reach))
            reach = more
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for n, new in reversed(steps):
        if new >> total & 1:
            out.append(n)
            total -= n
    return sorted(out, reverse=True)


def packing_plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Rows (length, first, per_bin, bin, at): pieces of a length from rank first on, per_bin to each bin from bin on, placed from at."""
    left, rows, bins = {n: c for n, c in counts.items() if c}, [], 0
    taken: Counter = Counter()
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = Counter([longest, *fullest(capacity - longest, left)])
        left[longest] += 1
        times = min(left[n] // c for n, c in combination.items())
        at = 0
        for n, c in combination.items():
            rows.append((n, taken[n], c, bins, at))
            at += n * c
            taken[n] += c * times
            left[n] -= c * times
            if not left[n]:
                del left[n]
        bins += times
    return pd.DataFrame(rows, columns=["length", "first", "per_bin", "bin", "at"]).sort_values(["length", "first"], ignore_index=True)


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (a written table of token_pieces) with sequence_id and offset."""
    counts = pieces.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most capacity rows
    plan = packing_plan(total, capacity)
    lengths, first = plan["length"].to_numpy(), plan["first"].to_numpy()
    per_bin, bins, at = (plan[c].to_numpy() for c in ("per_bin", "bin", "at"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        low, high = np.searchsorted(lengths, n, "left"), np.searchsorted(lengths, n, "right")
        while (low + 1 < high).any():  # the last row of the length whose first is not above the rank
            mid = (low + high) // 2
            above = first[np.minimum(mid, len(first) - 1)] > r
            open_ = low + 1 < high
            high, low = np.where(open_ & above, mid, high), np.where(open_ & ~above, mid, low)
        k = r - first[low]
        return pd.DataFrame({"sequence_id": bins[low] + k // per_bin[low], "offset": at[low] + k % per_bin[low] * n})

    placed = pieces.join(bases, ["part", "length"]).withColumn("place", place("length", F.col("base") + F.col("rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids, ids_crc32, sequence_id and offset."""
    with arrow_rows(docs.sparkSession, 500):
        pieces = written(token_pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    return pack_pieces(pieces, capacity)
