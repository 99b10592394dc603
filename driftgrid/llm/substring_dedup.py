"""Substring dedup by repeated-phrase automata: words of passages that an earlier document has are removed.

A window is ``width`` consecutive words. Two equal windows have the same anchor (the gram of ``gram`` words in it with the smallest
hash), so only anchors, about a sixth as many as words, are counted over the corpus, and windows whose anchor is found in one
document alone are never moved. Around each recurring anchor a document has a fragment: the words of its neighbouring windows
with that anchor. Equal fragments are merged, which leaves few of a hot passage.

Merged fragments are dealt by anchor into shards of about an eighth of ``shard``. Equal windows meet there, so each shard confirms, word for word,
those that start in two documents or more, compiles them into an Aho-Corasick automaton with their first document, and streams
its fragments through it to locate every occurrence.

An anchor of more than ``shard`` fragments is hot and goes another way. Its windows are confirmed by counts over the corpus, summed before
the shuffle, and dealt to as many automata as they need; its fragments are streamed by several tasks, each with the automaton, and
places meet fragments under as many salts as there are multiples of ``shard``. Either way, places go back to the documents,
which are read once more. Fragments are known by two 64-bit hashes of their words with different seeds.

Windows are judged on the input. Null texts have no words. Rows with a null doc_id are neither earlier nor later than
others and lose nothing; of rows that repeat a doc_id none is earlier. Extra columns are ignored.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, scratch, written
from .shingles import gram_codes, text_codes, word_list

WIDTH, GRAM = 13, 4
#: Windows or fragments of a shard, about.
SHARD = 8_000

FRAGMENTS = "doc_id bigint, text_hash bigint, pos int, anchor bigint, fragment string"


def _anchors(codes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The anchor of each window of words with these hashes."""
    grams = gram_codes(codes, gram).view(np.int64)
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for k in range(1, width - gram + 1):
        np.minimum(least, grams[k : n + k], out=least)
    return least


def _anchor_rows(width: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _anchors(text_codes(text)[0], width, gram)
                own = own[np.flatnonzero(np.diff(own, prepend=own[:1] ^ 1))]  # one for each run
                found.append(own)
                ids.append(np.full(len(own), doc_id, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], names=["anchor", "doc_id"])

    return run


def _fragment_rows(width: int, gram: int):
    """Fragments of (doc_id, text_hash, text, anchors) rows at the given anchors."""

    def run(batches):
        for batch in batches:
            parts: list[tuple] = []
            words: list[bytes] = []
            bounds = batch.column(3).offsets.to_numpy()
            values = batch.column(3).values.to_numpy(zero_copy_only=False)
            for k, text in enumerate(batch.column(2).to_pylist()):
                codes, raw, _, _ = text_codes(text)
                own = _anchors(codes, width, gram)
                changes = np.flatnonzero(np.diff(own, prepend=own[:1] ^ 1))
                wanted = np.isin(own[changes], values[bounds[k] : bounds[k + 1]])
                starts, ends = changes[wanted], np.append(changes[1:], len(own))[wanted]
                # a run longer than the places of one gram repeats it; it is cut, so that fragments stay short
                cuts = -(-(ends - starts) // (2 * width))
                at = np.repeat(starts, cuts) + 2 * width * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
                until = np.minimum(at + 2 * width, np.repeat(ends, cuts)) + width - 1
                parts.append((np.full(len(at), k), at, own[at]))
                split = raw.split()
                words += [b" ".join(split[p:q]) for p, q in zip(at.tolist(), until.tolist(), strict=True)]
            row, pos, anchor = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
            own_rows = pa.array(row.astype(np.int64))
            columns = [batch.column(0).take(own_rows), batch.column(1).take(own_rows), pa.array(pos.astype(np.int32)), pa.array(anchor.astype(np.int64)), pa.array(words, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("anchor", pa.int64()), ("fragment", pa.string())])
    return run


def _window_rows(width: int):
    """The windows of merged fragments (anchor, fragment, low, high), as words with one space between."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("anchor", "window", "low", "high")}
            for anchor, fragment, low, high in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = fragment.split(" ")
                seen = list(dict.fromkeys(" ".join(words[p : p + width]) for p in range(len(words) - width + 1)))
                for k, v in zip(out.values(), ([anchor] * len(seen), seen, [low] * len(seen), [high] * len(seen)), strict=True):
                    k += v
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("anchor", pa.int64()), ("window", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
    return run


#: What a fragment is known by, and the places of windows in it.
KEY = ["fragment_hash", "fragment_check"]
LOCATED = "anchor bigint, fragment_hash bigint, fragment_check bigint, places array<int>, firsts array<bigint>"


class _Letters(dict):
    """A letter for each word, so that windows are strings; ValueError where there are more words than code points."""

    def __missing__(self, word: str) -> str:
        self[word] = letter = chr(len(self) + 1)
        return letter


class _Numbers(dict):
    """A tuple of one number for each word."""

    def __missing__(self, word: str) -> tuple[int]:
        self[word] = number = (len(self) + 1,)
        return number


def _coded(fragments: pd.Series) -> list:
    """Fragments as strings with a letter for each word, or as tuples of numbers where letters run out."""
    try:
        letters = _Letters()
        return ["".join(map(letters.__getitem__, fragment.split(" "))) for fragment in fragments]
    except ValueError:
        numbers = _Numbers()
        return [sum(map(numbers.__getitem__, fragment.split(" ")), ()) for fragment in fragments]


def _places(fragments: pd.DataFrame, streams: list, windows: dict) -> pd.DataFrame:
    """Rows of LOCATED for fragments, coded as streams, in which the automaton of windows finds some that begin before their last document."""
    sequences = isinstance(next(iter(windows), ""), tuple)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE if sequences else ahocorasick.KEY_STRING)
    width = 1
    for window, first in windows.items():
        automaton.add_word(window, first)
        width = len(window)
    hits = [[]] * len(streams)
    if windows:
        automaton.make_automaton()
        hits = [[h for h in automaton.iter(stream) if h[1] < high] for stream, high in zip(streams, fragments["high"].tolist(), strict=True)]
    lists = {"places": [[end - width + 1 for end, _ in h] for h in hits], "firsts": [[first for _, first in h] for h in hits]}
    return fragments[["anchor", *KEY]].assign(**{k: pd.Series(v, fragments.index, dtype=object) for k, v in lists.items()})[[bool(h) for h in hits]]


def _confirmed_and_located(width: int):
    """For the merged fragments of a shard, which has all fragments of its anchors: the places of windows that recur."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        streams = _coded(group["fragment"])
        first: dict = {}
        last: dict = {}
        for stream, low, high in zip(streams, group["low"].tolist(), group["high"].tolist(), strict=True):
            for p in range(len(stream) - width + 1):
                window = stream[p : p + width]
                if first.setdefault(window, low) > low:
                    first[window] = low
                if last.setdefault(window, high) < high:
                    last[window] = high
        return _places(group, streams, {window: low for window, low in first.items() if low < last[window]})

    return run


def _located(width: int):
    """For a task's confirmed windows (window, first) and merged fragments: places of windows in each, and their first documents."""

    def run(windows: pd.DataFrame, fragments: pd.DataFrame) -> pd.DataFrame:
        coded = _coded(pd.concat([windows["window"], fragments["fragment"]]))
        return _places(fragments, coded[len(windows) :], dict(zip(coded[: len(windows)], windows["first"].tolist(), strict=True)))

    return run


def _kept_rows(width: int):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc_id, text, starts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = word_list(text)
                n = len(words)
                if starts:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.unique(np.array(starts))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                for k, v in zip(out.values(), (doc_id, n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")), strict=True):
                    k.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    return run


def _merged(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("anchor", *KEY, "fragment").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


def _locate_hot(merged: DataFrame, width: int, shard: int) -> DataFrame:
    """Rows of LOCATED for anchors with more fragments than a task takes; merged is a written table."""
    spark = merged.sparkSession
    with arrow_rows(spark, 2000):
        windows = merged.select("anchor", "fragment", "low", "high").mapInArrow(_window_rows(width), "anchor bigint, window string, low bigint, high bigint")
        confirmed = windows.groupBy("window").agg(F.min("anchor").alias("anchor"), F.min("low").alias("first"), F.max("high").alias("last")).where("first < last")
        confirmed = written(confirmed.select("anchor", "window", "first"), "windows")
    sizes = confirmed.groupBy("anchor").agg(F.count("*").alias("n_windows")).join(merged.groupBy("anchor").agg(F.count("*").alias("n_fragments")), "anchor")
    parts = sizes.select("anchor", F.ceil(F.col("n_windows") / shard).cast("int").alias("automata"), F.ceil(F.col("n_fragments") / shard).cast("int").alias("streams"))
    parts = written(parts, "parts")
    task = F.xxhash64("anchor", "automaton", "stream").alias("task")
    all_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda value, name: F.pmod(F.xxhash64(value), F.col(name)).cast("int")
    left = confirmed.join(parts, "anchor").withColumn("automaton", own("window", "automata")).withColumn("stream", all_of("streams")).select(task, "window", "first")
    right = merged.join(parts, "anchor").withColumn("stream", own("fragment", "streams")).withColumn("automaton", all_of("automata")).select(task, "anchor", *KEY, "fragment", "high")
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(_located(width), LOCATED)


def _locate(fragments: DataFrame, width: int, shard: int) -> DataFrame:
    """doc_id, text_hash, pos, places, firsts for fragments(FRAGMENTS, KEY), a written table, in which windows recur."""
    rows = fragments.select("doc_id", "text_hash", "pos", "anchor", *KEY)
    hot = fragments.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("anchor", F.ceil(F.col("n") / shard).cast("int").alias("salts"))
    hot = written(hot, "hot")
    some_hot = not hot.isEmpty()
    # small shards: the children of an automaton's root are searched in turn, and are as many as the first words of its windows
    shards = max(1, math.ceil(fragments.count() / max(1, shard // 8)))
    cold = fragments.join(hot, "anchor", "left_anti") if some_hot else fragments
    by_shard = _merged(cold).groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    found = rows.join(written(by_shard.applyInPandas(_confirmed_and_located(width), LOCATED), "located").drop("anchor"), KEY)
    if some_hot:
        located = written(_locate_hot(written(_merged(fragments.join(hot, "anchor", "left_semi")), "merged"), width, shard), "located-hot")
        salted = located.join(hot, "anchor").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        places = rows.join(hot, "anchor").withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.col("salts")).cast("int"))
        found = found.select("doc_id", "text_hash", "pos", "places", "firsts").unionByName(places.drop("anchor", "salts").join(salted.drop("anchor", "salts"), [*KEY, "salt"]).select("doc_id", "text_hash", "pos", "places", "firsts"))
    return found


def remove_repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_text (the kept words, one space between)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    known = own.where("doc_id is not null")
    with scratch(spark), arrow_rows(spark, 500):
        anchors = written(known.select("doc_id", "text").mapInArrow(_anchor_rows(width, gram), "anchor bigint, doc_id bigint"), "anchors")
        recurring = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
        per_doc = anchors.join(recurring, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
        fragments = known.join(per_doc, "doc_id").select("doc_id", "text_hash", "text", "anchors").mapInArrow(_fragment_rows(width, gram), FRAGMENTS)
        hashes = {"fragment_hash": F.xxhash64("fragment"), "fragment_check": F.xxhash64(F.lit(1), "fragment")}
        hits = _locate(written(fragments.withColumns(hashes), "fragments"), width, shard)
        earlier = F.filter(F.zip_with("places", "firsts", lambda p, f: F.when(f < F.col("doc_id"), p + F.col("pos"))), lambda x: x.isNotNull())
        starts = hits.select("doc_id", "text_hash", earlier.alias("starts")).where(F.size("starts") > 0)
        # the starts of one document: no more than it has words
        starts = starts.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("starts")).alias("starts"))
        starts = written(starts, "starts", lasting=True)
    return own.join(starts, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts").mapInArrow(_kept_rows(width), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
