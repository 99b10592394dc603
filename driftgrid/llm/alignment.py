"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Each side is a token-byte incidence matrix in CSR form. Gustavson's row-wise product A * B^T gives the overlap links (a pair of tokens
and the bytes that they share). Overlap links whose tokens end together cut both sides into groups; the product of the token-group
incidence matrices gives the shared-group links. How often a pair of ids is linked in the whole corpus is counted over blocks of
documents: a block holds its distinct pairs once, so a pair has a row for each block, not for each document, in the shuffles.

The text is encoded as space + text by a byte-level vocabulary (A) and as text by a sentencepiece model that puts a space before it
(B); strings of special tokens in it are plain text. Null and empty texts, and those whose joined bytes on a side aren't space + text
(such as texts with U+2581, which B reads as a space), have no tokens: zeros, and an empty hash. Repeated rows are separate documents
and count as such; a null doc_id stays. Extra columns are ignored. A long text is a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, read_rows, scratch, written
from .tokens import _BYTES

#: Tokens of side A after which a block of documents ends.
BLOCK_TOKENS = 1 << 17
#: Bytes of blocks after which a row group ends; a reader holds one whole.
ROW_GROUP = 1 << 24
#: Nonzeros that one step of a product expands.
STEP = 1 << 20

BLOCKS = "block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, keys binary, counts binary, at binary"
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
TOKENS = "doc_id bigint, a_ids array<int>, b_ids array<int>, overlap_a array<int>, overlap_b array<int>, overlap_bytes array<int>, group_a array<int>, group_b array<int>, n_group_links bigint"


def row_product(a_ptr, a_idx, b_ptr, b_idx, n_cols: int, step: int = STEP):
    """C = A * B for 0/1 matrices in CSR form, by rows: row i of C is the sum of the rows of B that row i of A names.

    Yields (rows, columns, values) of blocks of rows whose expansion has about step nonzeros; a single row can have more.
    """
    per_entry = b_ptr[a_idx + 1] - b_ptr[a_idx]
    done = np.concatenate([[0], np.cumsum(per_entry)])[a_ptr]  # of the expansion, before each row
    first, n_rows = 0, len(a_ptr) - 1
    while first < n_rows:
        last = max(first + 1, int(np.searchsorted(done, done[first] + step, "right")) - 1)
        entries = slice(a_ptr[first], a_ptr[last])
        lens, named = per_entry[entries], a_idx[entries]
        rows = np.repeat(np.repeat(np.arange(first, last), np.diff(a_ptr[first : last + 1])), lens)
        starts = np.cumsum(lens) - lens
        cols = b_idx[np.arange(lens.sum()) - np.repeat(starts - b_ptr[named], lens)]
        key = rows * n_cols + cols
        if len(key) and (np.diff(key) < 0).any():
            key = np.sort(key)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        yield key[new] // n_cols, key[new] % n_cols, np.diff(np.append(new, len(key)))
        first = last


def overlap_links(len_a: np.ndarray, len_b: np.ndarray, step: int = STEP):
    """The product of the token-byte incidences of two runs of tokens over the same bytes: (a, b, shared bytes), in blocks."""
    ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
    first = 0
    while first < len(len_a):  # so that the incidences, too, are held for some bytes at a time
        begin = ends_a[first] - len_a[first]
        last = max(first + 1, int(np.searchsorted(ends_a, begin + step, "right")))
        stop = ends_a[last - 1]
        b0, b1 = int(np.searchsorted(ends_b, begin, "right")), int(np.searchsorted(ends_b, stop, "left")) + 1
        a_ptr = np.concatenate([[0], ends_a[first:last] - begin])
        owner = np.repeat(np.arange(b0, b1), np.minimum(ends_b[b0:b1], stop) - np.maximum(ends_b[b0:b1] - len_b[b0:b1], begin))
        for a, b, shared in row_product(a_ptr, np.arange(stop - begin), np.arange(stop - begin + 1), owner, len(len_b), step):
            yield a + first, b, shared
        first = last


def group_incidence(ends: np.ndarray) -> np.ndarray:
    """Of each token the one group that its row of the incidence matrix names, where ends tells which tokens end a group."""
    return np.cumsum(ends) - ends


def shared_group_links(group_a: np.ndarray, group_b: np.ndarray, step: int = STEP):
    """The product of the token-group incidences: (a, b, 1) for all tokens in one group, in blocks of rows."""
    n = int(max(group_a[-1], group_b[-1])) + 1 if len(group_a) and len(group_b) else 0
    b_ptr = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))]).astype(np.int64)
    return row_product(np.arange(len(group_a) + 1), group_a, b_ptr, np.arange(len(group_b)), max(1, len(group_b)), step)


#: How a byte-level vocabulary cuts texts before it merges bytes.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts go to the tokenizers library, whose cutting needs no stack for long runs of white space.
_LONG = 1 << 20


class PairEncoder:
    """Ids of whole texts on both sides, and the bytes of every id.

    A's vocabulary is read by the tokenizers library. If its merges make their ids in order, with no more before them than cutting by
    the usual pattern, tiktoken gives the same ids from the same entries in a quarter of the time.
    """

    def __init__(self, tokenizer: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(tokenizer)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte = {chr(c): bytes([b]) for b, c in _BYTES.items()} | {chr(b): bytes([b]) for b in range(256) if b not in _BYTES}
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"".join(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.fast = self._fast(json.loads(self.a.to_str()))

    def _fast(self, kept: dict):
        """The same vocabulary for tiktoken, if it means the same."""
        import tiktoken

        model, special = kept["model"], {t["id"] for t in kept["added_tokens"]}
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in kept["model"].get("merges", [])]
        in_order = all(model["vocab"].get(x) == 256 + k for k, x in enumerate(joined)) and len(joined) + 256 == len(model["vocab"]) - len(special & set(model["vocab"].values()))
        usual = kept["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if model["type"] != "BPE" or kept["normalizer"] or not usual or not in_order or model.get("dropout"):
            return None
        ranks = {x: i for i, x in enumerate(self.bytes_a) if i not in special}
        return tiktoken.Encoding("pair", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of each text; none for texts that a side doesn't give back."""
        held = [t if t and "▁" not in t else "" for t in texts]
        out = []
        for text, b in zip(held, self.b.encode(held, num_threads=1), strict=True):
            whole = " " + text
            a = self.fast.encode_ordinary(whole) if self.fast and len(text) < _LONG else self.a.encode(whole, add_special_tokens=False).ids
            raw = whole.encode("utf-8", "surrogatepass")
            if not text or b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                a, b = (), ()
            out.append((np.array(a, np.int32), np.array(b, np.int32)))
        return out


@lru_cache(maxsize=2)
def pair_encoder(tokenizer: str, pieces: str) -> PairEncoder:
    """One for each Python worker."""
    return PairEncoder(tokenizer, pieces)


class Alignment:
    """Two runs of ids over the same bytes: their links that end together and their groups, from the overlap links."""

    def __init__(self, enc: PairEncoder, a: np.ndarray, b: np.ndarray):
        self.a, self.b, self.n_a = a, b, len(enc.bytes_a)
        len_a, len_b = enc.len_a[a], enc.len_b[b]
        ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
        found = [(x[same], y[same]) for x, y, _ in overlap_links(len_a, len_b) for same in [ends_a[x] == ends_b[y]]]
        self.link_a, self.link_b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        at_a, at_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        at_a[self.link_a], at_b[self.link_b] = 1, 1
        self.group_a, self.group_b = group_incidence(at_a), group_incidence(at_b)

    def codes(self) -> np.ndarray:
        """Ids of both sides in the order of the groups, A before B: three times the id (B's ids come after all of A's), with what follows it: 0 `,`, 1 `|`, 2 `;`."""
        n = len(self.a) + len(self.b)
        groups = int(self.group_a[-1]) + 1 if len(self.a) else 0
        upto_a = np.cumsum(np.bincount(self.group_a, minlength=groups))
        before_b = np.concatenate([[0], np.cumsum(np.bincount(self.group_b, minlength=groups))])
        out = np.empty(n, np.int64)
        place_a = np.arange(len(self.a)) + before_b[self.group_a]
        place_b = np.arange(len(self.b)) + upto_a[self.group_b]
        out[place_a] = self.a.astype(np.int64) * 3
        out[place_b] = (self.b.astype(np.int64) + self.n_a) * 3
        out[upto_a + before_b[:-1] - 1] += 1
        out[upto_a + before_b[1:] - 1] += 2
        return out


@lru_cache(maxsize=1)
def _printed(n_a: int, n_b: int) -> list[bytes]:
    return [b"%d%s" % (i, s) for n in (n_a, n_b) for i in range(n) for s in (b",", b"|", b";")]


def _blocks(tokenizer: str, pieces: str, block_tokens: int):
    def run(batches):
        enc = pair_encoder(tokenizer, pieces)
        printed = _printed(len(enc.bytes_a), len(enc.bytes_b)).__getitem__
        part, n = TaskContext.get().partitionId(), 0
        ids, a, b, total = [], [], [], 0

        def row():
            both = Alignment(enc, np.concatenate(a), np.concatenate(b))
            ends = np.cumsum([len(x) for x in a])  # a text's end is a group's end on both sides
            links = np.searchsorted(both.link_a, ends)
            groups = np.concatenate([[0], both.group_a + 1])[ends]
            codes, shas, at = both.codes(), [], 0
            for x, y in zip(a, b, strict=True):
                own = codes[at : at + len(x) + len(y)].tolist()
                at += len(own)
                shas.append(hashlib.sha256(b"".join(map(printed, own))[:-1]).hexdigest() if own else "")
            keys, places, counts = np.unique(both.a[both.link_a].astype(np.int64) << 32 | both.b[both.link_b], return_inverse=True, return_counts=True)
            return pa.RecordBatch.from_pylist([{
                "block": part << 32 | n, "doc_ids": ids, "n_a": [len(x) for x in a], "n_b": [len(x) for x in b],
                "n_groups": np.diff(groups, prepend=0).tolist(), "n_links": np.diff(links, prepend=0).tolist(), "groups_sha256": shas,
                "keys": keys.astype("<i8").tobytes(), "counts": counts.astype("<i8").tobytes(), "at": places.astype("<u4").tobytes(),
            }], schema=schema)

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                a.append(own[0])
                b.append(own[1])
                total += len(own[0])
                if total >= block_tokens:
                    yield row()
                    ids, a, b, total, n = [], [], [], 0, n + 1
        if ids:
            yield row()

    lists = [(k, pa.list_(pa.int64())) for k in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
    schema = pa.schema([("block", pa.int64()), *lists, ("groups_sha256", pa.list_(pa.string())), ("keys", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())])
    return run


def _pairs(batches):
    """block, key and n of each distinct pair of ids of a block."""
    for batch in batches:
        for block, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            keys, counts = np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<i8")
            for s in range(0, len(keys), 1 << 16):
                own = keys[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own), pa.array(counts[s : s + (1 << 16)])], ["block", "key", "n"])


def _rated(batches):
    """Documents of a block with the sums over their links; totals and best stand in the order of the block's keys."""
    for batch in batches:
        for r in batch.to_pylist():
            total, best = (np.array([x[k] for x in r["rated"] or ()], np.int64) for k in ("total", "best"))
            at, ends = np.frombuffer(r["at"], "<u4"), np.cumsum(r["n_links"])
            sums = [np.concatenate([[0], np.cumsum(x[at])])[ends] for x in (best, total)]
            n_best, count_sum = (np.diff(x, prepend=0) for x in sums)
            columns = [r["doc_ids"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], n_best, count_sum]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], pa.array(r["groups_sha256"], pa.string())], names=[c.split()[0] for c in ALIGNED.split(", ")])


def align_documents(docs: DataFrame, tokenizer: str, pieces: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row of docs(doc_id, text): tokens on both sides, groups, links, and how common its links are in the whole corpus."""
    spark = docs.sparkSession
    with scratch(spark):
        with arrow_rows(spark, 100):
            blocks = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(tokenizer, pieces, block_tokens), BLOCKS), "aligned", **{"parquet.block.size": str(ROW_GROUP)})
        with arrow_rows(spark, 4), read_rows(spark, 32):  # a block is most of a megabyte, and a task has as many as its documents make
            pairs = blocks.select("block", "keys", "counts").mapInArrow(_pairs, "block bigint, key bigint, n bigint")
            totals = written(pairs.groupBy("key").agg(F.sum("n").alias("total")), "pair-totals")
            side = F.col("key").bitwiseAND(0xFFFFFFFF).alias("b")
            highest = totals.groupBy(side).agg(F.max("total").alias("highest"))
            rated = totals.select("key", "total", side).join(highest, "b").select("key", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
            own = pairs.select("block", "key").join(rated, "key").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "total", "best"))).alias("rated"))
            return written(blocks.drop("keys", "counts").join(own, "block", "left").mapInArrow(_rated, ALIGNED), "alignment", lasting=True)


def token_links(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """Per row of docs(doc_id, text) the ids of both sides, every overlap link with its bytes, and the group of each token."""

    def run(batches):
        enc = pair_encoder(tokenizer, pieces)
        for batch in batches:
            for doc_id, (a, b) in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                both = Alignment(enc, a, b)
                parts = list(overlap_links(enc.len_a[a], enc.len_b[b]))
                links = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
                groups = len(both.link_a)
                n = int(np.dot(np.bincount(both.group_a, minlength=groups), np.bincount(both.group_b, minlength=groups)))
                lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (a, b, *links, both.group_a, both.group_b)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *lists, pa.array([n], pa.int64())], names=[c.split()[0] for c in TOKENS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)
