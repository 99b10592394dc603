"""Tokens, blocks, packing, quality rules and substring dedup against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftgrid.llm import packing, quality_rules, substring_dedup, token_blocks
from driftgrid.llm.queries import TOKENIZER, op6_quality_rules
from driftgrid.llm.shingles import text_codes, word_list
from driftgrid.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0abé'.,!1日Ā"), st.characters(codec="utf-8")), max_size=40))
def test_encoder_is_the_library(text):
    assert Encoder_.encode(text).tolist() == ids_of(text)


Encoder_ = Encoder(TOKENIZER, memo=50)


@pytest.mark.parametrize("text", ["a\n\n\nb\u00a0c\u00a0d", "a \u00a0b", "a\n\u2003b c", "x <|endoftext|> y", "a<|endoftext|>b", "<|endoftext|>", "u\n<|endoftext|>\nv", "u  <|endoftext|> \nv"])
def test_encoder_is_the_plain_call(text):
    """Runs of white space offset by Unicode spaces, and special tokens, as the library with its defaults has them."""
    plain = Tokenizer.from_file(TOKENIZER)
    assert Encoder_.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids + [0]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50), st.data())
def test_bits_round_trip(bits, ids, data):
    ids = np.array(ids, np.uint64) % (1 << bits)
    payload = token_blocks.pack(ids.astype("<u4"), bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert token_blocks.unpack(payload, bits, a, b).tolist() == ids[a:b].tolist()


def test_pack_refuses_wide_ids():
    with pytest.raises(ValueError, match="bits"):
        token_blocks.pack(np.array([9]), 3)


def check_blocks(got, rows):
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = ids_of(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc(ids))
        start += len(ids)


def test_token_table(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_blocks(token_blocks.token_table_digest(docs, TOKENIZER).orderBy("start").collect(), sorted(texts.items()))


def test_token_table_odd_rows(spark, make_docs, odd_texts, tmp_path):
    docs = make_docs(odd_texts, [None, *range(1, len(odd_texts))], ("start", "shard", "ids"))
    path = str(tmp_path / "t")
    token_blocks.write_token_table(docs, TOKENIZER, path, block_ids=1000)
    got = token_blocks.read_token_table(spark, path).withColumn("ids_crc32", F.crc32("ids")).orderBy("start").collect()
    check_blocks(got, list(zip([None, *range(1, len(odd_texts))], odd_texts)))
    assert spark.read.parquet(f"{path}/blocks").where("n_ids > 1000 and size(doc_ids) > 1").where("element_at(ends, -2) >= 1000").count() == 0
    assert token_blocks.token_table_digest(docs.limit(0), TOKENIZER).count() == 0


def check_packing(rows, texts, capacity):
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for i, t in texts.items():
        ids, at = ids_of(t), 0
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        for k, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length])) and (k == 0 or r.length == capacity)
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(pieces) == 1)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), math.ceil(total / capacity)


def test_packing(spark, sf_dir, texts):
    n, least = check_packing(packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER).collect(), texts, 2048)
    assert n <= least + 2


def test_packing_odd_rows(make_docs, odd_texts):
    docs = make_docs(odd_texts, extra=("length", "piece", "part", "rank"))
    check_packing(packing.pack_documents(docs, TOKENIZER, 64).collect(), dict(enumerate(odd_texts)), 64)
    assert packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0
    twice = packing.pack_documents(make_docs(["x y z"] * 100, [3] * 50 + [None] * 50), TOKENIZER, 8).collect()
    assert len(twice) == 100 and len({(r.sequence_id, r.offset) for r in twice}) == 100


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=6), st.integers(1, 40))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    found = packing.fullest(room, counts)
    assert sum(found) == max(s for s in sums if s <= room)
    assert all(v <= counts[n] for n, v in Counter(found).items())


def test_plan_uses_every_piece():
    r = random.Random(4)
    counts = Counter(r.randrange(1, 200) for _ in range(5000))
    plan = packing.packing_plan(dict(counts), 200)
    assert len(plan) < 6 * 200
    bins = int((plan["bin"].max() + 1))
    assert bins <= math.ceil(sum(n * c for n, c in counts.items()) / 200) + 40


def base_row(text):
    words = WORD.findall(text or "")
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[k : k + 8]) for k in range(n - 7))
    covered = {k + d for k in range(n - 7) if seen[tuple(words[k : k + 8])] > 1 for d in range(8)}
    return n, chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def llr_brute(texts, trusted, buckets):
    grams = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        grams[i] = [zlib.crc32(g.encode()) % buckets for g in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
    raw, good = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            good.update(g)
    nr, ng = sum(raw.values()), sum(good.values())
    weight = [round((math.log((good[b] + 1) / (ng + buckets)) - math.log((raw[b] + 1) / (nr + buckets))) * 1e6) for b in range(buckets)] if ng else [0] * buckets
    return {i: (len(g), sum(weight[b] for b in g)) for i, g in grams.items()}


def test_quality_rules(spark, sf_dir, texts):
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    scores = llr_brute(texts, trusted, quality_rules.BUCKETS)
    for r in op6_quality_rules(spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_row(texts[r.doc_id])
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        n, score = scores[r.doc_id]
        assert r.base_failed == failed and r.n_grams == n and abs(r.llr_millionths - score) <= n
        assert r.kept == (not failed and r.llr_millionths >= quality_rules.THRESHOLD * n)


def test_whole_threshold(spark):
    """Values on both sides of ranges of 4,096, and negative ones."""
    values = [(k * 7919) % 20_011 - 10_000 for k in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "value long")
    for share in (0.99, 0.5, 1.0, 0.001):
        assert quality_rules.reached_by(df, share) == max(v for v in values if sum(x >= v for x in values) >= share * len(values))
    assert quality_rules.reached_by(df.limit(0), 0.99) is None


def test_threshold_is_of_all_trusted_documents(spark, sf_dir, texts, monkeypatch):
    """Every trusted document that passes the base rules is scored, by weights without its own part."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    part = {r.doc_id: r.p for r in trusted.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 23), {quality_rules.PARTS}) AS p").collect()}
    ratios = []
    for p in range(quality_rules.PARTS):
        scores = llr_brute(texts, {i for i, k in part.items() if k != p}, quality_rules.BUCKETS)
        for i in (i for i, k in part.items() if k == p and i in texts):
            n, *_, repeated = base_row(texts[i])
            if n >= 20 and 100 * repeated <= 30 * n:
                ratios.append(scores[i][1] / scores[i][0])
    seen = []
    whole = quality_rules.reached_by
    monkeypatch.setattr(quality_rules, "reached_by", lambda values, share: seen.append(values.count()) or whole(values, share))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, threshold = quality_rules.fitted_rules(docs, trusted)
    assert seen == [len(ratios)]
    want = sorted(ratios)[len(ratios) - math.ceil(quality_rules.KEPT_SHARE * len(ratios))]
    assert abs(threshold - want) <= 2


def test_quality_rules_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts, extra=("w", "h", "s", "grams", "kept", "trusted_id"))
    labels = spark.createDataFrame([(6,), (None,), (6,)], "doc_id long")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t in enumerate(odd_texts):
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == base_row(t)
    assert not rows[0].kept and rows[0].base_failed and rows[6].kept == rows[7].kept
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("llr_millionths <> 0").count() == 0


def kept_brute(rows):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = {k + d for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for d in range(13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(v for k, v in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.h) for r in df.withColumn("h", F.sha2("kept_text", 256)).collect()), key=str)


def test_substring_dedup(spark, sf_dir, texts):
    assert removed(substring_dedup.remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == kept_brute(texts.items())


def test_substring_dedup_odd_rows(make_docs, odd_texts):
    r = random.Random(3)
    shared = [f"w{k}" for k in range(40)]
    mixed = [" ".join(["x"] * r.randrange(5) + shared[a : a + 20] + [f"y{k}" for k in range(9)] + shared[b : b + 13]) for a, b in [(r.randrange(20), r.randrange(27)) for _ in range(12)]]
    rows = [*odd_texts, *mixed, " ".join(["same"] * 100), " ".join(["same"] * 30)]
    ids = [*range(len(rows) - 3), len(rows) - 4, None, 5]
    docs = make_docs(rows, ids, ("pos", "anchor", "starts", "shard"))
    assert removed(substring_dedup.remove_repeated(docs, shard=5)) == kept_brute(list(zip(ids, rows)))
    assert substring_dedup.remove_repeated(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \n\tabé日", max_size=200))
def test_words_and_codes_agree(text):
    codes, raw, starts, ends = text_codes(text)
    words = word_list(text)
    assert [raw[a:b] for a, b in zip(starts, ends)] == words == [w.encode() for w in WORD.findall(text)]
    known = dict(zip(words, codes.tolist()))
    assert [known[w] for w in words] == codes.tolist() and len(set(known.values())) == len(known)


def test_fragments_are_coded_alike_with_letters_and_numbers(monkeypatch):
    fragments = pd.Series(["a b c a", "b", "é a"])
    letters = substring_dedup._coded(fragments)
    assert [[ord(c) for c in s] for s in letters] == [[1, 2, 3, 1], [2], [4, 1]]

    def no_more(self, word):
        raise ValueError

    monkeypatch.setattr(substring_dedup._Letters, "__missing__", no_more)
    numbers = substring_dedup._coded(fragments)
    assert numbers == [(1, 2, 3, 1), (2,), (4, 1)]
    rows = pd.DataFrame({"anchor": [7, 8], "fragment_hash": [1, 2], "fragment_check": [3, 4], "high": [9, 5]})
    for streams in (letters, numbers):
        # the second window begins in no document before the last one of the fragment
        found = substring_dedup._places(rows, streams[:2], {streams[0][1:3]: 6, streams[0][2:4]: 9})
        assert found["anchor"].tolist() == [7] and found["places"].tolist() == [[1]] and found["firsts"].tolist() == [[6]]


def test_windows_are_hashed_only_where_they_may_recur(spark, make_docs):
    """Counts as by brute force about the bound of five known runs, also where buckets collide; only a text with such runs has its windows hashed."""
    rng = random.Random(11)
    fresh = [f"w{k}" for k in range(40)]
    texts = {k: " ".join(fresh[:k]) for k in range(13)}
    texts |= {100 + k: " ".join(fresh + fresh[3 : 3 + k]) for k in range(6, 11)} | {200 + k: " ".join(["a"] * k) for k in range(7, 12)} | {300 + k: " ".join(["a", "b", "c"] * k) for k in range(2, 5)}
    texts |= {400 + k: " ".join(rng.choice("abc") for _ in range(60)) for k in range(20)}
    docs = make_docs(list(texts.values()), list(texts))
    for buckets in (quality_rules.BUCKETS, 2):
        rows = {r.doc_id: r for r in quality_rules.base_rules(docs, buckets).collect()}
        for k, t in texts.items():
            w = t.split()
            windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
            assert rows[k].n_repeat_words == len({i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}), (k, buckets)
            assert len(rows[k].grams) == max(0, 2 * len(w) - 1)
    hashed = [line for line in quality_rules.base_rules(docs)._jdf.queryExecution().executedPlan().toString().splitlines() if "xxhash64" in line]
    assert len(hashed) == 1 and "array_distinct(fours" in hashed[0].split("xxhash64")[0]
