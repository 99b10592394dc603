"""Benchmark decontamination by template canonicalisation.

A text is taken as tokens (runs of letters, numbers). Numbers, units after numbers, and names (capitalised words within a
sentence; a run of them is one name) become typed placeholders, other words lose their case. Windows of ``width`` template tokens of documents and
benchmark items are hash-joined; windows with fewer than ``literal`` plain words are too general and not used. Hits of a document
on an item along one diagonal (the same shift) are held together. Numbers and units may take any value at each place. A name
has the value that most of its places show, its own in a tie, and windows that show another are not counted; where a name has
no such value, the names are a chance mixture and only windows with the item's own values count, as they always do. A
document is contaminated by an item when the tokens of its counted windows number ``long_run`` or ``share`` of the item's.

Items without a usable window (short ones, or made mostly of numbers and names) match where their whole sequence of tokens stands,
without case: anywhere in a document, or, with fewer than ``literal`` tokens, as the whole document. Null texts count as empty; items
without tokens never match. Repeated rows, null ids and ties are kept apart by row; extra columns pass through
``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, written

_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:]")
# Units that follow numbers.
UNITS = frozenset("mm cm m km g kg mg lb oz l ml s min h hr hours hour minutes minute seconds second days day weeks week months month years year miles mile inches inch feet foot meters meter metres metre kilometers kilometres grams gram kilograms liters litres dollars dollar euros euro cents percent degrees celsius fahrenheit watts volts hz khz mhz ghz kb mb gb tb mph kmh".split())
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
#: Windows of a benchmark beyond this many are not sent to the tasks; all windows of documents are then joined, with the same result.
SENT_WINDOWS = 2_000_000

HITS = "doc_id bigint, text_hash bigint, pos int, window bigint, slots array<string>"


def _code(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


_PLACEHOLDERS = (NUMBER, UNIT, NAME)
_NUMBER, _UNIT, _NAME = map(_code, _PLACEHOLDERS)
_MARK, _DIGITS, _UNITS, _CAPITAL, _PLAIN = range(5)
#: What is known of a token: its kind and the hash of its lower case. Emptied when full.
_KNOWN: dict[str, tuple[int, int]] = {}


def _learn(t: str) -> tuple[int, int]:
    low = t.lower()
    kind = _MARK if t in ".!?:" else _DIGITS if t[0].isdigit() else _UNITS if low in UNITS else _CAPITAL if len(t) > 1 and t[0].isupper() and t[1:].islower() else _PLAIN
    if len(_KNOWN) >= 100_000:
        _KNOWN.clear()
    _KNOWN[t] = kind, _code(low)
    return _KNOWN[t]


def template(text: str | None) -> tuple[np.ndarray, list[str]]:
    """The hashes of a text's template tokens, and the tokens that they stand for.

    A unit counts as one after a number, a capitalised word as a name within a sentence; names that follow each other are one.
    """
    codes: list[int] = []
    shown: list[str] = []
    opens, last, known = True, 0, _KNOWN.get
    for t in _TOKEN.findall(text or ""):
        kind, code = known(t) or _learn(t)
        if kind == _MARK:
            opens, last = True, 0
            continue
        if kind != _PLAIN:
            if kind == _DIGITS:
                code = _NUMBER
            elif kind == _UNITS:
                code = _UNIT if last == _NUMBER else _NAME if not opens and len(t) > 1 and t[0].isupper() and t[1:].islower() else code
            elif not opens:
                code = _NAME
        opens = False
        if code == last == _NAME:
            shown[-1] += " " + t
            continue
        last = code
        codes.append(code)
        shown.append(t)
    return np.array(codes, np.uint64), shown


def template_codes(text: str | None) -> np.ndarray:
    return template(text)[0]


def windows(codes: np.ndarray, width: int, literal: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows that have enough plain words."""
    n = len(codes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = (codes == _NUMBER) | (codes == _UNIT) | (codes == _NAME)
    plain = np.concatenate([np.zeros(1, np.int64), np.cumsum(~held)])
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    h ^= h >> np.uint64(29)
    pos = np.flatnonzero(plain[width:] - plain[:-width] >= literal)
    return pos, h[pos].view(np.int64)


def _spans(text: str | None, n: int) -> np.ndarray:
    """Hashes of the runs of n tokens of a text, without case."""
    codes = np.array([(_KNOWN.get(t) or _learn(t))[1] for t in _TOKEN.findall(text or "") if t not in ".!?:"], np.uint64)
    m = len(codes) - n + 1
    h = np.full(max(m, 0), n, np.uint64)
    for k in range(n if m > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : m + k]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _whole(width: int, literal: int):
    """A UDF: the number of tokens and the hash of an item without a usable window; null for other items and those without tokens."""

    def run(text):
        n = len([t for t in _TOKEN.findall(text or "") if t not in ".!?:"])
        if not n or len(windows(template_codes(text), width, literal)[0]):
            return None
        return n, int(_spans(text, n)[0])

    return F.udf(run, "n int, window bigint")


def _judge(width: int):
    """A UDF: the counted tokens of a diagonal's hits (item_pos, item_slots, slots), and whether all of them have the item's values."""

    def tokens(places) -> int:
        return len({p + k for p in places for k in range(width)})

    def run(hits):
        names: dict[str, dict[int, str]] = {}
        for h in hits:
            for k, (a, b) in enumerate(zip(h["item_slots"], h["slots"], strict=True)):
                if a is not None and a.startswith("@"):
                    names.setdefault(a, {})[h["item_pos"] + k] = b
        chosen = {}
        for a, places in names.items():
            counts = Counter(places.values())
            most = max(counts.values())
            best = [b for b, n in counts.items() if n == most]
            chosen[a] = a if a in best else best[0] if len(best) == 1 else None
        verbatim = tokens(h["item_pos"] for h in hits if h["item_slots"] == h["slots"])
        if None in chosen.values():
            return verbatim, True
        counted = tokens(h["item_pos"] for h in hits if all(chosen.get(a, b) == b for a, b in zip(h["item_slots"], h["slots"], strict=True)))
        return max(counted, verbatim), counted <= verbatim

    return F.udf(run, "matched int, exact boolean")


def _hits(sent: np.ndarray | None, width: int, literal: int, wholes: dict[int, np.ndarray] | None = None):
    """A mapInArrow function: windows of (doc_id, text_hash, text) rows, only those in ``sent`` (sorted) where it is given.

    Names among the slots have a mark before them. Runs of tokens in ``wholes`` (their number: sorted hashes) have null slots.
    """

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "text_hash", "pos", "window", "slots")}
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, tokens = template(text)
                for n, known in (wholes or {}).items():
                    runs = _spans(text, n)
                    if not len(runs) or (n < literal and len(runs) > 1):
                        continue
                    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
                    for p in np.flatnonzero(known[at] == runs).tolist():
                        for name, x in zip(out, (doc_id, text_hash, p, int(runs[p]), None), strict=True):
                            out[name].append(x)
                pos, h = windows(codes, width, literal)
                if sent is not None and len(h):
                    at = np.searchsorted(sent, h)
                    hit = (at < len(sent)) & (sent[np.minimum(at, len(sent) - 1)] == h) if len(sent) else np.zeros(len(h), bool)
                    pos, h = pos[hit], h[hit]
                if not len(pos):
                    continue
                held = np.isin(codes, np.array([_NUMBER, _UNIT, _NAME], np.uint64))
                shown = [f"@{t.lower()}" if c == _NAME else t.lower() for t, c in zip(tokens, codes.tolist(), strict=True)]
                for p, x in zip(pos.tolist(), h.tolist(), strict=True):
                    out["doc_id"].append(doc_id)
                    out["text_hash"].append(text_hash)
                    out["pos"].append(p)
                    out["window"].append(x)
                    out["slots"].append([shown[k] if held[k] else None for k in range(p, p + width)])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("window", pa.int64()), ("slots", pa.list_(pa.string()))])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 8, literal: int = 4, share: float = 0.5, long_run: int = 13) -> DataFrame:
    """doc_id, text_hash, item_id, shift, matched (tokens), item_tokens, exact: one row for each contaminating (document, item), its best shift.

    docs(doc_id, text), benchmark(item_id, text). text_hash is xxhash64 of the document's text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").distinct()
    with arrow_rows(spark, 500):
        item_windows = items.mapInArrow(_hits(None, width, literal), HITS)
        # tokens of an item, for its share
        lengths = F.udf(lambda t: len(template_codes(t)), "int")
        sizes = items.select(F.col("doc_id").alias("item_id"), F.col("text_hash").alias("item_hash"), lengths("text").alias("item_tokens"))
        item_windows = written(item_windows.select(F.col("doc_id").alias("item_id"), F.col("text_hash").alias("item_hash"), F.col("pos").alias("item_pos"), "window", F.col("slots").alias("item_slots")).join(sizes, ["item_id", "item_hash"]), "items")
        few = item_windows.count() <= SENT_WINDOWS  # rows, so that what is broadcast is bounded
        sent = np.sort(np.array([r[0] for r in item_windows.select("window").distinct().collect()], np.int64)) if few else None
        whole = items.select(F.col("doc_id").alias("item_id"), F.col("text_hash").alias("item_hash"), _whole(width, literal)("text").alias("w")).where("w is not null")
        whole = written(whole.select("item_id", "item_hash", "w.window", F.col("w.n").alias("item_tokens")), "whole-items")
        wholes: dict[int, list[int]] = {}
        for r in whole.select("item_tokens", "window").distinct().collect():
            wholes.setdefault(r["item_tokens"], []).append(r["window"])
        own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
        found = written(own.mapInArrow(_hits(sent, width, literal, {n: np.sort(np.array(v, np.int64)) for n, v in wholes.items()}), HITS), "hits")
    stands = found.where("slots is null").join(whole, "window")
    found = found.where("slots is not null")
    joined = found.join(F.broadcast(item_windows) if few else item_windows, "window")
    keys = ["doc_id", "text_hash", "item_id", "item_hash", "shift"]
    hit = F.struct("item_pos", "item_slots", "slots")
    # per diagonal: at most one hit for each window of the item, so a group is bounded by the item's length
    diagonals = joined.withColumn("shift", F.col("pos") - F.col("item_pos")).groupBy(*keys).agg(F.collect_set(hit).alias("hits"), F.first("item_tokens").alias("item_tokens"))
    judged = (
        diagonals.withColumn("judged", _judge(width)("hits"))
        .select(*keys, "judged.matched", "item_tokens", "judged.exact")
        .where((F.col("matched") >= long_run) | (F.col("matched") >= F.col("item_tokens") * share))
    )
    judged = judged.unionByName(stands.select("doc_id", "text_hash", "item_id", "item_hash", F.col("pos").alias("shift"), F.col("item_tokens").alias("matched"), "item_tokens", F.lit(True).alias("exact")))
    best = F.max_by(F.struct("shift", "matched", "item_tokens", "exact"), F.struct("matched", "exact", -F.col("shift")))
    return judged.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select("doc_id", "text_hash", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones."""
    bad = written(contamination(docs, benchmark, **options).select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_bad_hash")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_hash"]), "left_anti")
