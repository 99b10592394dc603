"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its five-word shingles. Documents with equal sets are one class; its id is that of its first document (by
doc_id, then the text's hash). Classes are joined. Each class has a label of ``depth`` MinHash values in each of ``trees`` prefix tries.
The descent starts at the full depth: classes that share a whole label are verified. Then matched prefixes are shortened, to the depth at
which the links found so far say that the target recall is reached; a pair is verified in the first round in which some tree has a common
prefix of it, in the first such tree, on the shingles of whole texts, and only there, so links are counted once and no list of pairs is made. A
node whose members were together in the round before has no new pairs and isn't visited.

The estimate is made by size of class (its number of shingles, to a power of two): a link of similarity s that was found at depth d stands for
1 / p(s, d) links, where p is the chance to meet by then, and one unseen link at the threshold itself is added, so that nothing found is no
evidence. Sizes whose estimate reaches the target are done, and nodes of such classes alone aren't visited any more. Shortening ends in any case at
``least_depth``, where pairs at the threshold meet with the target chance. A target that no depth reaches is an error.

Nodes of many classes, or long ones, are cut into blocks of bounded bytes, each pair of blocks a group of its own; a node with the same
members as one of an earlier tree has no work left.

Documents of fewer than five words have no shingles: they are a class with those of the same words and have no links. Null texts count
as empty. Rows that repeat a doc_id with another text are documents of their own; rows that repeat both are one. Rows with a null
doc_id take no part and have null results. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, scratch, written
from .shingles import gram_codes, mixed, seeds, signature, text_codes

WORDS, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 25, 8, 0.9999
#: Classes and shingles of a block; two blocks are held in a task together.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Similarities of links are counted in so many steps between 0 and 1.
STEPS = 100
#: Bits of a text's hash in a document's key.
KEY_BITS = 60

SIGNED = "doc_id bigint, text_hash bigint, fp1 bigint, fp2 bigint, n int, nodes array<bigint>"
SETS = "v decimal(38,0), n int, shingles array<bigint>, prefixes array<bigint>"
LINKS = "v decimal(38,0), root decimal(38,0), n int, n_links bigint, steps array<int>"


def meets(similarity, depth: int, trees: int):
    """The chance that two classes share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which pairs at the threshold meet with the wanted chance."""
    for d in range(depth, 0, -1):
        if meets(threshold, d, trees) >= recall:
            return d
    raise ValueError(f"{trees} trees don't reach a recall of {recall} at a similarity of {threshold}; take more trees")


def estimated_recall(steps: dict[int, int], threshold: float, found_at: int, depth: int, trees: int) -> float:
    """The share of links that is found at a depth, by those found at the depth ``found_at`` or longer ones, counted by similarity (in STEPS).

    One unseen link at the threshold is added.
    """
    stood_for = {max(k / STEPS, threshold): c / meets(max(k / STEPS, threshold), found_at, trees) for k, c in steps.items()}
    found = sum(c * meets(s, depth, trees) for s, c in stood_for.items())
    return (found + meets(threshold, depth, trees)) / (sum(stood_for.values()) + 1)


def next_depth(counted: dict[int, dict[int, int]], strata: list[int], threshold: float, found_at: int, trees: int, least: int, recall: float) -> int:
    """The longest prefixes that reach the target in all of these strata, by what was found at the depth ``found_at``."""
    return max([d for d in range(least + 1, found_at) if all(estimated_recall(counted.get(s, {}), threshold, found_at, d, trees) >= recall for s in strata)], default=least)


def document_key(doc_id: Column, text_hash: Column) -> Column:
    """One number for (doc_id, text_hash), in their order."""
    return (doc_id.cast("decimal(19,0)") * F.lit(1 << KEY_BITS).cast("decimal(19,0)") + F.pmod(text_hash, F.lit(1 << KEY_BITS))).cast("decimal(38,0)")


def _id_of(key: Column) -> Column:
    """The doc_id of a key."""
    room = F.lit(1 << KEY_BITS).cast("decimal(38,0)")
    return F.call_function("div", key - F.pmod(key, room), room).cast("long")


def _shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    codes = text_codes(text)[0]
    return np.unique(gram_codes(codes, WORDS)), codes


def _prefixes(signatures: list[np.ndarray], depth: int, trees: int, least: int) -> np.ndarray:
    """Per signature and tree, the nodes at the depths from least to depth: the tree in the first 8 bits, then a hash of the prefix."""
    sig = np.array(signatures, np.uint64).reshape(len(signatures), depth, trees)
    tree = np.arange(trees, dtype=np.uint64)
    h, out = tree + np.uint64(1), np.empty((len(signatures), trees, depth - least + 1), np.uint64)
    for k in range(depth):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
        if k + 1 >= least:
            out[:, :, k + 1 - least] = (tree << np.uint64(56)) | (h >> np.uint64(8))
    return out.view(np.int64)


def _signed(trees: int, least: int):
    hashes = seeds(least * trees)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, prints, signatures = [], [], []
            for text in texts:
                held, codes = _shingles(text)
                sizes.append(len(held))
                if len(held):
                    signatures.append(signature(held, *hashes))
                else:
                    held = gram_codes(codes, 1) + np.arange(1, len(codes) + 1, dtype=np.uint64)
                prints.append((mixed(held).sum(dtype=np.uint64), mixed(held ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
            short = np.array(sizes) == 0
            fp = np.array(prints, np.uint64).reshape(-1, 2)
            # the kind enters, so that short and long documents are never one class
            fp[:, 1] = fp[:, 1] * np.uint64(2) + short
            at = np.cumsum(np.concatenate([[0], np.where(short, 0, trees)]))
            found = pa.array(_prefixes(signatures, least, trees, least).ravel(), pa.int64())
            nodes = pa.ListArray.from_arrays(pa.array(at, pa.int32()), found, mask=pa.array(short))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(fp[:, k].view(np.int64)) for k in (0, 1)], pa.array(sizes, pa.int32()), nodes], names=["doc_id", "text_hash", "fp1", "fp2", "n", "nodes"])

    return run


def _sets(depth: int, trees: int, least: int):
    """(v, text) as v, n, its shingles, and its nodes in all trees at all depths."""
    hashes = seeds(depth * trees)

    def run(batches):
        for batch in batches:
            sets = [_shingles(t)[0] for t in batch.column(1).to_pylist()]
            prefixes = _prefixes([signature(s, *hashes) for s in sets], depth, trees, least).reshape(len(sets), -1)
            lists = [pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64())) for xs in (sets, prefixes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), *lists], names=["v", "n", "shingles", "prefixes"])

    return run


def _overlaps(sets: list[np.ndarray], width: int = 1 << 12) -> np.ndarray:
    """The sizes of all pairwise intersections, through bit rows over the shingles that two sets share, so many at a time."""
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    total = int((counts > 1).sum())
    out = np.zeros((len(sets), len(sets)), np.int32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[at] > 1
    row, col = row[shared], column[at[shared]]
    for start in range(0, total, width):
        part = (col >= start) & (col < start + width)
        bits = np.zeros((len(sets), min(total - start, width)), bool)
        bits[row[part], col[part] - start] = True
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        for k in range(len(sets)):
            out[k] += np.bitwise_count(packed[k] & packed).sum(axis=1, dtype=np.int32)
    return out


def _verified(level: int, before: int | None, levels: int, trees: int, threshold: float):
    """For a group (node, block i, block j): per class its links that meet here first, and the smallest class it hangs together with.

    Levels are depths counted from the least one, of which there are ``levels``; ``before`` is that of the round before.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tree, i, j = int(group["node"].iloc[0]) >> 56, int(group["i"].iloc[0]), int(group["j"].iloc[0])
        ids, block = group["v"].to_list(), group["block"].to_numpy()
        sets = [np.asarray(s, np.int64) for s in group["shingles"]]
        prefixes = np.stack([np.asarray(p, np.int64) for p in group["prefixes"]]).reshape(len(ids), trees, levels)
        sizes = np.array([len(s) for s in sets], np.int64)
        common = _overlaps(sets)
        order = sorted(range(len(ids)), key=ids.__getitem__)
        root = np.empty(len(ids), np.int64)
        root[order] = np.arange(len(ids))
        n_links, steps, ends = np.zeros(len(ids), np.int64), [], []
        for k in range(len(ids)):
            both = common[k].astype(np.int64)
            union = sizes[k] + sizes - both
            linked = both >= threshold * union - 1e-9
            linked[k] = False
            if i != j:
                linked &= block != block[k]
            other = np.flatnonzero(linked)
            if len(other):
                here = (prefixes[other, :, level] == prefixes[k, :, level]).argmax(axis=1) == tree  # no earlier tree has this prefix of both
                if before is not None:
                    here &= ~(prefixes[other, :, before] == prefixes[k, :, before]).any(axis=1)  # and none had the one of the round before
                other = other[here]
            n_links[k] = len(other)
            ends.append(other)
            steps.append(np.bincount((both[other] / union[other] * STEPS + 1e-9).astype(np.int64), minlength=STEPS + 1).tolist() if len(other) else None)
        found = np.flatnonzero(n_links)
        changed = True
        while changed:  # the smallest rank that each can reach
            changed = False
            for k in found.tolist():
                least = min(root[k], root[ends[k]].min())
                if least < root[k]:
                    root[k], changed = least, True
        lists = {"v": [ids[k] for k in found], "root": [ids[order[r]] for r in root[found]], "steps": [steps[k] for k in found]}
        lists = {k: pd.Series(x, dtype=object) for k, x in lists.items()}
        return pd.DataFrame(lists | {"n": sizes[found], "n_links": n_links[found]})[["v", "root", "n", "n_links", "steps"]]

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex of the component of every vertex of edges(v, w), by least labels and pointer jumps.

    Each round is written to the shared folder; it ends when no label falls. Both sides of the joins are shuffled for them alone,
    so that Spark can split the partition of a label that many vertices share.
    """
    both = written(edges.select("v", "w").unionByName(edges.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "edges")
    labels = written(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label")), "labels")
    while True:
        named = labels.select(F.col("v").alias("w"), F.col("label").alias("near"))
        least = both.join(named, "w").groupBy("v").agg(F.min("near").alias("near"))
        lower = written(labels.join(least, "v").select("v", "label", F.least("label", "near").alias("new")), "lower")
        jump = lower.select(F.col("v").alias("new"), F.col("new").alias("far"))
        after = written(lower.join(jump, "new", "left").select("v", F.col("label").alias("old"), F.coalesce(F.least("new", "far"), F.col("new")).alias("label")), "labels")
        labels = after.select("v", "label")
        if after.where("old <> label").isEmpty():
            return labels


def _links(sets: DataFrame, threshold: float, trees: int, depth: int, least: int, recall: float, block: int) -> list[DataFrame]:
    """The links of each round, from the longest prefixes down; sets is a written table."""
    levels, out, counted = depth - least + 1, [], {}
    stratum = F.floor(F.log2("n")).cast("int")
    at, before, open_ = depth, None, None  # all are open
    while True:
        level, last = at - least, levels - 1 if before is None else before - least
        of = F.expr(f"transform(sequence(0, {trees - 1}), t -> struct(prefixes[t * {levels} + {level}] AS node, prefixes[t * {levels} + {last}] AS child))")
        is_open = F.lit(True) if open_ is None else stratum.isin(open_)
        members = sets.select("v", "n", is_open.alias("open"), F.explode(of).alias("p")).select("v", "n", "open", "p.*")
        # the checksum tells nodes with the same members
        nodes = members.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("bytes"), F.sum(F.xxhash64("v").cast("decimal(20,0)")).alias("check"), F.min("child").alias("low"), F.max("child").alias("high"), F.max("open").alias("open"))
        nodes = nodes.where("size > 1 and open" + ("" if before is None else " and low < high")).select("node", "size", "bytes", "check")
        shared = members.select("v", "node").join(nodes, "node")
        first = shared.groupBy("v", "size", "check").agg(F.min("node").alias("node"), F.max("bytes").alias("bytes"))
        blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("bytes") / BLOCK_SHINGLES)).cast("int")
        placed = first.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("v", "node"), F.col("blocks")).cast("int"))
        tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
        placed = placed.select("v", "node", "block", F.explode(tiles).alias("at")).select("v", "node", "block", "at.*")
        work = placed.join(sets.select("v", "shingles", "prefixes"), "v")
        verified = _verified(level, None if before is None else last, levels, trees, threshold)
        found = written(work.groupBy("node", "i", "j").applyInPandas(verified, LINKS), f"links-{at}")
        out.append(found.withColumn("depth", F.lit(at)))
        if at == least:
            return out
        steps = found.select(stratum.alias("stratum"), F.posexplode("steps").alias("step", "c")).where("c > 0").groupBy("stratum", "step").agg(F.sum("c").alias("c"))
        for r in steps.collect():  # a few numbers for each power of two
            own = counted.setdefault(r["stratum"], {})
            own[r["step"]] = own.get(r["step"], 0) + r["c"]
        # a text has fewer than 2^31 shingles
        open_ = [s for s in range(31) if estimated_recall(counted.get(s, {}), threshold, at, at, trees) < recall]
        present = [r[0] for r in sets.select(stratum.alias("s")).distinct().collect()]  # a row for each power of two
        open_ = [s for s in open_ if s in present]
        if not open_:
            return out
        before, at = at, next_depth(counted, open_, threshold, at, trees, least, recall)


def _joined(docs: DataFrame, threshold: float, trees: int, depth: int, recall: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs with the fingerprints of their sets; per class its links and group; links by depth."""
    spark = docs.sparkSession
    if not 1 <= trees <= 127:
        raise ValueError("1 to 127 trees")
    least = least_depth(threshold, trees, depth, recall)
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    key = document_key(F.col("doc_id"), F.col("text_hash"))
    with arrow_rows(spark, 500):
        signed = written(own.mapInArrow(_signed(trees, least), SIGNED), "signed", lasting=True)
        known = signed.where("doc_id is not null").select(key.alias("v"), "fp1", "fp2", "nodes")
        classes = written(known.groupBy("fp1", "fp2").agg(F.min(F.struct("v", "nodes")).alias("c")).select("fp1", "fp2", "c.*"), "classes")
        members = classes.where("nodes is not null").select("v", F.explode("nodes").alias("node"))
        near = members.join(members.groupBy("node").count().where("count > 1").select("node"), "node", "left_semi").select("v").distinct()
        # texts of classes that meet another at the least depth: they are cut into shingles once
        texts = own.where("doc_id is not null").select(key.alias("v"), "text").join(written(near, "near").hint("merge"), "v", "left_semi").dropDuplicates(["v"])
        sets = written(texts.mapInArrow(_sets(depth, trees, least), SETS), "sets")
    links = _links(sets, threshold, trees, depth, least, recall, block)
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    counts = found.groupBy("v").agg(F.sum("n_links").alias("n_links"))
    labels = connected(found.select("v", F.col("root").alias("w")))
    per_class = classes.select("fp1", "fp2", "v").join(counts, "v", "left").join(labels, "v", "left")
    per_class = per_class.select("fp1", "fp2", "v", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "v").alias("label"))
    return signed, written(per_class, "per-class", lasting=True), found


def links_by_depth(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """depth and links: how many links were found at prefixes of each length."""
    _, _, found = _joined(docs, threshold, trees, depth, recall, block)
    return found.groupBy("depth").agg((F.sum("n_links") / 2).cast("long").alias("links"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, class_id, n_links (other classes linked to its own), group_id (smallest doc_id of what hangs together)."""
    with scratch(docs.sparkSession):
        signed, per_class, _ = _joined(docs, threshold, trees, depth, recall, block)
    named = per_class.select("fp1", "fp2", _id_of(F.col("v")).alias("class_id"), "n_links", _id_of(F.col("label")).alias("group_id"))
    rows = signed.select("doc_id", "fp1", "fp2").join(named, ["fp1", "fp2"], "left")
    return rows.select("doc_id", *[F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("class_id", "n_links", "group_id")])


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs with one document of each group: its first, once; rows without a doc_id stay."""
    spark = docs.sparkSession
    with scratch(spark):
        _, per_class, _ = _joined(docs, threshold, trees, depth, recall, block)
        firsts = written(per_class.where("v = label").select("v"), "firsts", lasting=True)
    # the row goes in a struct, so that names of its columns don't matter
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), document_key(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("v"), F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]).alias("h"))
    one = keyed.join(firsts, "v", "left_semi").groupBy("v").agg(F.min_by("row", "h").alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))
