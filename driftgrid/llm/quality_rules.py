"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, all in DataFrame functions.

Every document is scored by ln(p(gram | trusted) / p(gram | raw)) over its word n-grams of one and two words, hashed into
buckets. Both multinomials are counted over whole tables: raw over all documents, trusted over those named as such. Weights are whole
millionths, so a document's score is an exact sum, and whether it reaches ``threshold`` a gram doesn't depend on the order of addition.

Null or empty texts have no words and fail. Repeated rows are judged alike. A null doc_id is never trusted. With no trusted
document all weights are 0 and only the base rules decide. Extra columns of the input are ignored.

``fitted_rules`` also derives a threshold from all trusted documents: they are dealt into parts, each is scored with weights counted without
its own part, and the threshold is the mean ratio that ``KEPT_SHARE`` of those that pass the base rules reach. Documents that took no part in
the counts score lower than those that did, so a threshold from the latter would reject clean text, most on small tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, settled, sieve, words, written

BUCKETS = 1 << 14
#: Words of a window of the repetition rule.
WINDOW = 8
#: Mean log-likelihood ratio, in millionths of a nat, that a document must reach.
THRESHOLD = -80_000
#: Share of trusted documents that a derived threshold keeps.
KEPT_SHARE = 0.99
#: Parts of the trusted documents; each is scored without its own counts.
PARTS = 5


def _grams(w: Column, buckets: int) -> Column:
    """Buckets of the word and word-pair grams."""
    code = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(buckets)).cast("int")
    pairs = F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: code(F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(w, code), pairs)


def _flags(trusted: DataFrame) -> DataFrame:
    return trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()


def _all_weights(docs: DataFrame, flags: DataFrame, buckets: int, parts: int) -> list[list[int]]:
    """The weights over all of flags(trusted_id, part), then those without each of the parts 1 to ``parts``; all in one pass."""
    own = docs.select("doc_id", "text").join(flags.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = own.select((F.coalesce("part", F.lit(0)) * buckets).cast("int").alias("first"), words(F.col("text")).alias("w")).select("first", F.explode(_grams(F.col("w"), buckets)).alias("bucket"))
    held = dict(grams.groupBy((F.col("first") + F.col("bucket")).alias("place")).count().collect())  # a row for each part and bucket, at most
    counts = [[held.get(k * buckets + b, 0) for b in range(buckets)] for k in range(max(parts, 1) + 1)]
    raw, good = [sum(x) for x in zip(*counts, strict=True)], [sum(x) for x in zip(*counts[1:], strict=True)]
    columns = [good, *[[g - x for g, x in zip(good, counts[k], strict=True)] for k in range(1, parts + 1)]]
    names = [f"good{k}" for k in range(len(columns))]
    rows = docs.sparkSession.createDataFrame(list(zip(range(buckets), raw, *columns, strict=True)), ", ".join(["bucket int", "raw bigint", *[f"{n} bigint" for n in names]]))
    ratio = lambda c, n: F.log((F.col(c) + 1) / (n + buckets)) - F.log((F.col("raw") + 1) / (sum(raw) + buckets)) if n else F.lit(0.0)
    found = rows.select("bucket", *[F.round(ratio(c, sum(x)) * 1e6).cast("long").alias(c) for c, x in zip(names, columns, strict=True)]).orderBy("bucket").collect()
    return [[r[c] for r in found] for c in names]


def gram_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Millionths of ln(p(bucket | trusted) / p(bucket | raw)), with one added to every count.

    docs(doc_id, text); trusted(doc_id). The counts are summed before they are shuffled; the result has ``buckets`` numbers.
    """
    return _all_weights(docs, _flags(trusted).withColumn("part", F.lit(1)), buckets, 0)[0]


def fitted_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """The weights over all trusted documents, and the derived threshold; THRESHOLD where none can be scored without its own counts."""
    flags = _flags(trusted).withColumn("part", (F.pmod(F.xxhash64("trusted_id", F.lit(23)), F.lit(PARTS)) + 1).cast("int"))
    weights, *without = _all_weights(docs, flags, buckets, PARTS)
    usable = [k for k, w in enumerate(without, 1) if any(w)]
    if not usable:
        return weights, THRESHOLD
    held = docs.select("doc_id", "text").join(flags.where(F.col("part").isin(usable)).hint("merge"), F.col("doc_id") == F.col("trusted_id"))
    own = held.select(F.struct("doc_id", "part").alias("doc_id"), "text")
    scored = settled(_judged(own, sum(without, []), 0, buckets, (F.col("doc_id.part") - 1) * buckets)).where("not base_failed")
    with scratch(docs.sparkSession):
        found = reached_by(written(scored.select(F.floor(F.col("llr_millionths") / F.col("n_grams")).alias("value")), "quality-held"), KEPT_SHARE)
    return weights, THRESHOLD if found is None else found


def reached_by(values: DataFrame, share: float) -> int | None:
    """The largest whole number of values(value) that this share of them reaches; None without values.

    Values are counted in ranges of 4,096, then one by one in the range that holds the number.
    """
    counted = lambda rows, c: sorted(rows.groupBy(c.alias("c")).count().collect())
    span = F.shiftright("value", 12)
    ranges = counted(values, span)
    total = sum(n for _, n in ranges)
    below = total - math.ceil(share * total)  # as many may be left out
    for k, n in ranges:
        if below < n:
            break
        below -= n
    else:
        return None
    for value, n in counted(values.where(span == k), F.col("value")):
        if below < n:
            return value
        below -= n
    return None


def base_rules(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text) with grams (buckets of words, then of pairs) and the counts of the base rules.

    Windows are hashed only where they may recur: one that recurs has ``WINDOW - 3`` runs of four words that were there before, so the
    buckets of the two pairs of each such run were there before too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = "[^\\x20\\x09-\\x0D]"
    n, w, h = F.size("w"), F.col("w"), F.col("h")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(blank))
    runs = lambda k: F.slice("grams", n + k, F.greatest(n - 3, F.lit(0)))
    fours = F.zip_with(runs(1), runs(3), lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long")))
    doubtful = F.size("fours") - F.size(F.array_distinct("fours")) >= WINDOW - 3
    hashes = F.when(doubtful, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    # starts of windows found twice or more, in order: neighbours in order of the hash are compared
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    s = F.col("s")
    twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")))["n"]
    return (
        docs.select("doc_id", text.alias("text"))
        .select("*", words(F.col("text")).alias("w"), lines.alias("lines"))
        .select("*", _grams(w, buckets).alias("grams"))
        .select("*", fours.alias("fours"))
        .select("*", hashes.alias("h"))
        .select("*", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs).alias("s"))
        .select(
            "doc_id", "grams", n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(s.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        )
    )


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: int = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Per row of docs: doc_id, the counts, n_grams and llr_millionths (the sum), base_failed and kept."""
    return settled(_judged(docs, gram_weights(docs, trusted, buckets), threshold, buckets))


def _judged(docs: DataFrame, weights: list[int], threshold: int, buckets: int, first: Column | None = None) -> DataFrame:
    """first is the place of a document's own weights, where there are several tables of them in one list."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    score = F.aggregate("grams", F.lit(0).cast("long"), lambda a, b: a + F.get(table, b if first is None else first + b))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return (
        base_rules(docs, buckets)
        .select("doc_id", *counts, F.size("grams").cast("long").alias("n_grams"), score.alias("llr_millionths"), failed.alias("base_failed"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr_millionths") >= threshold * F.col("n_grams")))
    )


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: int | None = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; texts are not shuffled for it. Without a threshold it is derived."""
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc_id"), "text")
    if threshold is None:
        weights, threshold = fitted_rules(docs, trusted, buckets)
    else:
        weights = gram_weights(docs, trusted, buckets)
    return sieve(_judged(own, weights, threshold, buckets), F.col("kept")).select("doc_id.*")
