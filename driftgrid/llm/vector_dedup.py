"""Embedding near-dedup: all pairs of vectors with a cosine of threshold or more, from products of int8 tiles.

A vector x of length 1 is held as scale * q, with q of int8, and the length e of what that leaves out. By the triangle and the
Cauchy-Schwarz inequality the cosine of x and y is at most scale_x * scale_y * (q_x . q_y) + e_x + e_y + e_x * e_y, for any
vectors; only pairs for which that bound (with room for rounding) reaches the threshold are computed again, from the components as
given and in double precision. So no link is lost and none below the threshold is made.

Equal vectors form a class, which is compared once, whatever its size. Classes are dealt at random into blocks, and a task takes the
tile of two blocks. Within a tile, vectors are ordered by the nearest of a few of them, in parts, and a pair of parts is left out if the
angles between their middles and their edges prove that all of it is below the threshold. A tile returns for each vector its number
of links and the smallest one that it hangs together with in the tile, not pairs: links of a group of m near copies cost m^2 products,
but no rows. A block has at most block vectors, so a task's memory is bounded; tiles and their reads grow with the square of the
number of blocks, as an exact join of vectors without structure must.

Products of int8 parts are made with float32 matrices that hold whole numbers below 2^24, which is exact, in runs of 1,024 components.

Null vectors, empty ones, zero vectors and those with a null or non-finite component link with nothing: n_links 0, own component.
Vectors of different lengths aren't compared. Equal rows, and rows that share a vec_id, are vectors of their own: each goes with its
vector. A row without a vec_id links with nothing and isn't kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written
from .jaccard_join import connected

THRESHOLD = 0.9
#: Classes in a block at most, on average.
BLOCK = 16_384
#: Vectors of a part, and how many parts a product takes at a time.
PART = 256
#: Room for rounding in bounds, far above what doubles of 10^5 components lose.
ROOM = 1e-9
#: Pairs computed again at a time.
AGAIN = 1 << 16

SIGNED = "vec_id bigint, fp binary, dim int, vec binary"
FOUND = "v bigint, fp binary, root bigint, root_fp binary, n_links bigint"


def _signed(batches):
    """Each row with a fingerprint of its vector, and the vector as doubles, scaled by a power of two; both null if it links with nothing."""
    for batch in batches:
        ids, fps, dims, vecs = batch.column(0), [], [], []
        column = batch.column(1)
        for k in range(batch.num_rows):
            own = column[k].values if column[k].is_valid and ids[k].is_valid else None
            v = None if own is None or own.null_count or not len(own) else own.to_numpy(zero_copy_only=False).astype(np.float64)
            most = 0.0 if v is None else np.abs(v).max()
            if v is None or not np.isfinite(v).all() or most == 0:
                fps.append(None), dims.append(None), vecs.append(None)
                continue
            raw = np.ldexp(v, -int(np.frexp(most)[1])).astype("<f8") + 0.0  # no over- or underflow; -0 is 0
            fps.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest())
            dims.append(len(raw))
            vecs.append(raw.tobytes())
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(fps, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], names=["vec_id", "fp", "dim", "vec"])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error lengths (rounded up) of rows of length 1."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(axis=1))
    return codes, scale, error + ROOM


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact whole-number products of rows of int8 codes, as doubles or floats."""
    total = None
    for k in range(0, a.shape[1], 1024):
        part = a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b in root, which names the smallest member of each one's component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(root, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while not np.array_equal(up := root[root], root):
            root[:] = up


class Block:
    """Vectors in parts around a few of their own, quantised."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.length = np.sqrt((rows * rows).sum(axis=1))
        unit = rows / self.length[:, None]
        n = len(rows)
        middles = unit[:: max(1, -(-n // max(1, n // PART)))]
        nearest = np.concatenate([(unit[s : s + 4096] @ middles.T).argmax(axis=1) for s in range(0, n, 4096)])
        self.order = np.argsort(nearest, kind="stable")
        self.cuts = self._cut(np.bincount(nearest, minlength=len(middles)))
        self.codes, self.scale, self.error = quantised(unit[self.order])
        own = unit[self.order]
        centre = np.stack([own[s:e].sum(axis=0) for s, e in self.cuts])
        size = np.sqrt((centre * centre).sum(axis=1))
        self.centre = centre / np.where(size > 0, size, 1)[:, None]
        least = np.array([(own[s:e] @ c).min() for (s, e), c in zip(self.cuts, self.centre, strict=True)])
        self.radius = np.where(size > 1e-6, np.arccos(np.clip(least, -1, 1)), math.pi) + 1e-6

    @staticmethod
    def _cut(counts: np.ndarray) -> list[tuple[int, int]]:
        """Runs of at most PART rows; a run has rows of one middle only."""
        out, begin = [], 0
        for m in counts.tolist():
            out += [(begin + s, begin + min(s + PART, m)) for s in range(0, m, PART)]
            begin += m
        return out


def linked(x: Block, y: Block, same: bool, threshold: float):
    """Yields (a, b), rows of the blocks with a cosine of threshold or more; each pair once if the blocks are the same."""
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    scale = y.scale
    for i, (s, e) in enumerate(x.cuts):
        apart = np.arccos(np.clip(y.centre @ x.centre[i], -1, 1))
        near = np.flatnonzero(apart - 1e-6 <= x.radius[i] + y.radius + reach)
        near = near[near >= i] if same else near
        if not len(near):
            continue
        at = np.concatenate([np.arange(*y.cuts[j]) for j in near])
        for t in range(0, len(at), 16 * PART):
            cols = at[t : t + 16 * PART]
            dots = products(x.codes[s:e], y.codes[cols])
            # a bound for the whole row first, then one for each pair
            least = (threshold - ROOM - x.error[s:e] - (1 + x.error[s:e]) * y.error[cols].max()) / x.scale[s:e]
            rows = np.where(least > 0, least / scale[cols].max(), least / scale[cols].min())
            a, b = np.nonzero(dots >= (rows * (1 - 1e-6) - 1e-3)[:, None].astype(dots.dtype))
            bound = x.scale[s + a] * scale[cols[b]] * dots[a, b] + x.error[s + a] + (1 + x.error[s + a]) * y.error[cols[b]] + ROOM
            a, b = (s + a)[bound >= threshold], cols[b][bound >= threshold]
            if same:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), AGAIN):
                p, q = x.order[a[k : k + AGAIN]], y.order[b[k : k + AGAIN]]
                cosine = np.einsum("ij,ij->i", x.rows[p], y.rows[q]) / (x.length[p] * y.length[q])
                yield p[cosine >= threshold], q[cosine >= threshold]


def _tile(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = key
        rows = rows.sort_values(["v", "fp"])  # so that the first of what hangs together is the smallest
        ids, fps, sizes = rows["v"].to_numpy(np.int64), rows["fp"].to_numpy(), rows["n"].to_numpy(np.int64)
        side = rows["block"].to_numpy()
        vectors = np.frombuffer(b"".join(rows["vec"]), "<f8").reshape(-1, dim)
        places = [np.flatnonzero(side == i)] + ([] if i == j else [np.flatnonzero(side == j)])
        if not all(len(p) for p in places):
            return pd.DataFrame({"v": [], "fp": [], "root": [], "root_fp": [], "n_links": []})
        blocks = [Block(vectors[p]) for p in places]
        root, counts = np.arange(len(ids)), np.zeros(len(ids))
        for a, b in linked(blocks[0], blocks[-1], i == j, threshold):
            a, b = places[0][a], places[-1][b]
            counts += np.bincount(a, sizes[b], len(ids)) + np.bincount(b, sizes[a], len(ids))
            united(root, a, b)
        found = np.flatnonzero(counts)
        first = root[found]
        return pd.DataFrame({"v": ids[found], "fp": fps[found], "root": ids[first], "root_fp": fps[first], "n_links": counts[found].astype(np.int64)})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold in (0, 1]")
    spark = vectors.sparkSession
    with scratch(spark):
        own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        signed = written(own.mapInArrow(_signed, SIGNED), "vectors")
        valid = signed.where("fp is not null")
        sizes = valid.groupBy("fp").agg(F.min("vec_id").alias("v"), F.count("*").alias("n"))
        classes = written(sizes.join(valid.select("fp", F.col("vec_id").alias("v"), "dim", "vec"), ["fp", "v"]).dropDuplicates(["fp"]), "vector-classes")
        blocks = max(math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)), math.ceil(classes.count() / block))
        dealt = classes.withColumn("block", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int"))
        tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
        work = dealt.select("dim", "v", "n", "fp", "vec", "block", F.explode(tiles).alias("tile")).select("*", "tile.*").drop("tile")
        found = written(work.groupBy("dim", "i", "j").applyInPandas(_tile(threshold), FOUND), "vector-links")
        links = found.groupBy("fp").agg(F.sum("n_links").alias("n_links"))
        vertex = F.struct("v", "fp")
        labels = connected(found.select(vertex.alias("v"), F.struct(F.col("root").alias("v"), F.col("root_fp").alias("fp")).alias("w")))
        labels = labels.select("v.fp", F.col("label.v").alias("label"))
        per_class = sizes.join(links, "fp", "left").join(labels, "fp", "left")
        per_class = written(per_class.select("fp", "n", F.coalesce("n_links", F.lit(0)).alias("others"), F.coalesce("label", "v").alias("label")), "linked-classes")
        rows = signed.select("vec_id", "fp").join(per_class, "fp", "left")
        component = F.when(F.col("vec_id").isNotNull(), F.coalesce("label", "vec_id"))
        rows = rows.select("vec_id", F.coalesce(F.col("others") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        return written(rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "vector-components", lasting=True)


#: All pairs by their definition, for DuckDB.
VECTOR_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM e WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.9),
reach(v, w) AS (SELECT vec_id, vec_id FROM e UNION SELECT v, b FROM reach JOIN links ON a = w)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM e
  LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id JOIN (SELECT v, min(w) AS c FROM reach GROUP BY v) c ON c.v = e.vec_id
"""
