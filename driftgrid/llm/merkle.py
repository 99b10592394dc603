"""Merkle dataset manifest: a hash tree over the rows of documents, a proof for each row, and its verification.

A row's leaf is the hash of its columns. Leaves of a language ascend by doc_id; the hashes of each run of fan nodes, joined, hash to
their parent, until one node remains: the subroot of the language. Subroots, in the order of their languages, grow to the root likewise.

Every level is a table made by sibling-shift self-joins: nodes equijoin the nodes of their computed sibling places (place XOR 1 for a
fan of 2, shifted slots otherwise), which gives each node its siblings; the rows of slot zero emit the parents. The levels have
fan / (fan - 1) times the rows of the leaves in all. Proofs are put together from the top down in blocks of fan^tier leaves, so that a
leaf's siblings meet it in a shuffle of the nodes, once, and not once a level.

Places come from one range shuffle and a sum over its partitions; no language is numbered in a single task. Ties of doc_id go by leaf,
equal rows are leaves beside each other. Null doc_ids come first; null columns hash as `-`; a null language is a language of its own,
before all others. An empty table has no rows in its manifest. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

FAN = 2
#: Levels of one block of proofs.
TIER = 8


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that values can't run into each other."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df with idx, the place of a row (from 0) within its group (a column without nulls), and n, the rows of the group.

    One range shuffle by group and order; rows that tie in all of order get places by their place in the input. Then a sum over the
    partitions, of which there is a row for each group and partition.
    """
    order = [F.col(group).asc(), *order, F.col("tie").asc()]
    spread = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = written(spread.drop("tie").withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.expr("shiftright(at, 33)"))
    starts = sorted_.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    all_of = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(all_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(all_of).alias("n"))
    return sorted_.join(starts, [group, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def sibling(idx: Column, d: int, fan: int) -> Column:
    """The place of the d-th other node of a run, going round from a node's own slot."""
    if fan == 2:
        return idx.bitwiseXOR(F.lit(1))
    return idx - idx % fan + (idx % fan + d) % fan


def joined_level(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes(g, n, idx, h, ...) with sibs, the slots and hashes of the other nodes of each one's run, left to right."""
    with_sibs, found = nodes, []
    for d in range(1, fan):
        other = nodes.select(F.col("g").alias("g_d"), F.col("idx").alias("idx_d"), F.col("h").alias(f"h_{d}"))
        with_sibs = with_sibs.join(other, (F.col("g") == F.col("g_d")) & (sibling(F.col("idx"), d, fan) == F.col("idx_d")), "left").drop("g_d", "idx_d")
        slot = ((F.col("idx") % fan + d) % fan).cast("int")
        found.append(F.struct(slot.alias("slot"), F.col(f"h_{d}").alias("h")))
    sibs = F.array_sort(F.filter(F.array(*found), lambda s: s["h"].isNotNull()))
    return with_sibs.withColumn("sibs", sibs).drop(*[f"h_{d}" for d in range(1, fan)])


def parents(level: DataFrame, fan: int) -> DataFrame:
    """What the rows of slot zero emit; a group of one node is done, and keeps it."""
    joined = digest("h", F.array_join(F.transform("sibs", lambda s: s["h"]), ""))
    return level.where(F.col("idx") % fan == 0).select(
        "g", F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.expr(f"idx div {fan}").alias("idx"), F.when(F.col("n") > 1, joined).otherwise(F.col("h")).alias("h")
    )


def grown(nodes: DataFrame, fan: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of all levels, from the leaves up, and the one node (g, h) that remains of each group."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    levels = []
    while True:
        levels.append(written(joined_level(nodes, fan), f"{name}-{len(levels)}"))
        nodes = parents(levels[-1], fan)
        most = -(-most // fan)
        if most == 1:
            return levels, nodes.select("g", "h")


def proven(levels: list[DataFrame], top: DataFrame, fan: int, tier: int) -> DataFrame:
    """g, idx, h, own of the leaves with path: the steps to the root, each with the node's slot and its siblings.

    top(g, blk = 0, path, ...) has the steps above each group's last node; its other columns go down to the leaves.
    """
    for first in range((len(levels) - 1) // tier * tier, -1, -tier):
        here = levels[first : first + tier]
        parts = []
        for k, level in enumerate(here):
            step = F.struct("idx", "n", (F.col("idx") % fan).cast("int").alias("slot"), "sibs", "h", *(["own"] if first + k == 0 else []))
            parts.append(level.select("g", F.expr(f"idx div {fan ** (tier - k)}").alias("blk"), *[(step if j == k else F.lit(None)).alias(f"s{j}") for j in range(len(here))]))
        nodes = parts[0]
        for p in parts[1:]:
            nodes = nodes.unionByName(p)
        blocks = nodes.groupBy("g", "blk").agg(*[F.array_sort(F.collect_list(f"s{j}"), lambda x, y: (x["idx"] - y["idx"]).cast("int")).alias(f"s{j}") for j in range(len(here))])
        rows = blocks.join(top, ["g", "blk"])
        rest = [c for c in top.columns if c not in ("g", "blk", "path")]
        leaf = rows.select("g", "blk", "path", *rest, *[f"s{j}" for j in range(1, len(here))], F.explode("s0").alias("leaf"))
        steps = [F.col("leaf")] + [F.get(f"s{j}", F.expr(f"cast(leaf.idx div {fan ** j} - blk * {fan ** (tier - j)} as int)")) for j in range(1, len(here))]
        steps = F.filter(F.array(*[F.struct(s["n"].alias("n"), s["slot"].alias("slot"), s["sibs"].alias("sibs")) for s in steps]), lambda s: s["n"] > 1)
        path = F.concat(steps, F.col("path"))
        top = leaf.select("g", F.col("leaf.idx").alias("blk"), path.alias("path"), *rest, *(["leaf.h", "leaf.own"] if first == 0 else []))
    return top


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hash and its path give."""

    def step(own: Column, s: Column) -> Column:
        left = F.transform(F.filter(s["sibs"], lambda x: x["slot"] < s["slot"]), lambda x: x["h"])
        right = F.transform(F.filter(s["sibs"], lambda x: x["slot"] > s["slot"]), lambda x: x["h"])
        return F.sha2(F.array_join(F.concat(left, F.array(own), right), ""), 256)

    return F.aggregate(path, start, step)


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.transform(s["sibs"], lambda x: x["h"]))), ""), 256)


def manifest(docs: DataFrame, fan: int = FAN, tier: int = TIER) -> DataFrame:
    """Per row of docs(doc_id, source, lang, n_chars, text): doc_id, leaf, changed, subroot, root and path.

    changed is the leaf after tampering (n_chars + 1 where 7 divides the CRC-32 of doc_id as decimal; a null stays), null elsewhere.
    """
    spark = docs.sparkSession
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")]
    fields = dict(zip(("doc_id", "source", "lang", "n_chars", "text"), map(field, columns), strict=True))
    leaf, changed = digest(*fields.values()), digest(*(fields | {"n_chars": field(F.col("n_chars") + 1)}).values())
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # keeps the order of bytes, null first
    leaves = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("h"), F.when(tampered, changed).alias("changed"))
    with scratch(spark):
        placed = numbered(leaves, "g", [F.col("doc_id").asc_nulls_first(), F.col("h").asc()], "leaves")
        levels, subroots = grown(placed.select("g", "n", "idx", "h", F.struct("doc_id", "changed").alias("own")), fan, "level")
        subroots = written(subroots, "subroots")
        ranked = numbered(subroots.select(F.lit("").alias("all"), F.col("g").alias("lang_key"), "h"), "all", [F.col("lang_key").asc()], "ranked")
        ranked = ranked.select(F.col("all").alias("g"), "n", "idx", "h", F.struct("lang_key").alias("own"))
        tops, root = grown(ranked, fan, "top")
        none = F.array().cast("array<struct<n:bigint,slot:int,sibs:array<struct<slot:int,h:string>>>>")
        root = written(root.select("g", F.lit(0).cast("long").alias("blk"), none.alias("path"), F.col("h").alias("root")), "root")
        above = proven(tops, root, fan, tier)
        above = written(above.select(F.col("own.lang_key").alias("g"), F.lit(0).cast("long").alias("blk"), "path", F.col("h").alias("subroot"), "root"), "above")
        rows = proven(levels, above, fan, tier)
        return written(rows.select("own.doc_id", F.col("h").alias("leaf"), "own.changed", "subroot", "root", "path"), "manifest", lasting=True)


def verified(rows: DataFrame) -> DataFrame:
    """What each proof gives for its leaf, tampered with or not, against the root."""
    root = folded(F.coalesce("changed", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, nodes: str, folds: str, levels: int, keep: str) -> str:
    """Unrolled levels: the tree over nodes(g, idx, h), and what the rows of folds(g, idx, cur, proof, and the columns to keep) come to."""
    out = [
        f"{name}n0 AS MATERIALIZED (SELECT g, idx, h, count(*) OVER (PARTITION BY g) AS n FROM {nodes})",
        f"{name}f0 AS MATERIALIZED (SELECT g, idx AS k, cur, proof, {keep} FROM {folds})",
    ]
    for k in range(levels):
        out.append(f"""{name}n{k + 1} AS MATERIALIZED (SELECT g, idx // 2 AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h,
  (any_value(n) + 1) // 2 AS n FROM {name}n{k} GROUP BY g, idx // 2)""")
        out.append(f"""{name}f{k + 1} AS MATERIALIZED (SELECT f.g, k // 2 AS k,
  CASE WHEN m.n = 1 THEN cur WHEN s.h IS NULL THEN sha256(cur) WHEN k % 2 = 0 THEN sha256(cur || s.h) ELSE sha256(s.h || cur) END AS cur, proof || coalesce(s.h, '') AS proof, {keep}
  FROM {name}f{k} f JOIN {name}n{k} m ON m.g = f.g AND m.idx = f.k LEFT JOIN {name}n{k} s ON s.g = f.g AND s.idx = xor(f.k, 1))""")
    return ",\n".join(out)


def manifest_sql(levels: int = 17, top: int = 5) -> str:
    """The manifest with a fan of 2 for DuckDB, its levels unrolled: up to 2^levels rows of a language and 2^top languages."""
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({n} AS VARCHAR)", "text"]
    fields = " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)
    own, changed = fields.replace("{n}", "n_chars"), fields.replace("{n}", "n_chars + 1")
    return f"""
WITH RECURSIVE t(k, i, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(0, 256) r(i) UNION ALL SELECT k, i + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM t WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS v FROM t WHERE i = 8),
l AS (SELECT coalesce('=' || lang, '') AS g, doc_id, sha256({own}) AS leaf, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, y: xor(a >> 8, v[CAST(xor(a, y) & 255 AS BIGINT) + 1])), 4294967295) % 7 = 0 THEN sha256({changed}) END AS changed FROM documents, crc),
x AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h, coalesce(changed, leaf) AS cur, '' AS proof, doc_id, leaf FROM l),
{_levels_sql("a", "x", "x", levels, "doc_id, leaf")},
y AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, h, g AS lang_key FROM an{levels}),
z AS (SELECT y.g, y.idx, f.cur, f.proof, f.doc_id, f.leaf, y.h AS subroot FROM y JOIN af{levels} f ON f.g = y.lang_key),
{_levels_sql("b", "y", "z", top, "doc_id, leaf, subroot")}
SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = n.h AS verified FROM bf{top}, bn{top} n
"""
