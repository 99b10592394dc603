"""Alignment, Merkle manifest and vector links against brute force."""

import hashlib
import zlib
from bisect import bisect

import numpy as np
import pytest
from pyspark.sql import types as T

from driftgrid.llm import alignment as al
from driftgrid.llm import merkle as mk
from driftgrid.llm import vector_dedup as vd
from driftgrid.llm.queries import PIECES, TOKENIZER, op11_token_alignment


def plain_alignment(texts):
    """Per text the result by its definition, with the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tok.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
    cut, links_of = [], []
    for t in texts:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        ba = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not t or not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            a = b = ba = bb = []
        ends_a, ends_b = np.cumsum([len(x) for x in ba], dtype=int).tolist(), np.cumsum([len(x) for x in bb], dtype=int).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        cuts = [tuple(bisect(ends, e) for ends in (ends_a, ends_b)) for e in [0, *both]]
        groups = [(a[i:k], b[j:m]) for (i, j), (k, m) in zip(cuts, cuts[1:])]
        cut.append((len(a), len(b), groups))
        links_of.append([(x[-1], y[-1]) for x, y in groups])
    counts, best = {}, {}
    for x in (x for links in links_of for x in links):
        counts[x] = counts.get(x, 0) + 1
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (n_a, n_b, groups), links in zip(cut, links_of):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return out


def test_alignment_of_odd_texts(make_docs, odd_texts):
    more = ["<|endoftext|> and </s>", "a▁b", "é ﬁ 日本語 🎉🎉 x", " lead", "trail ", "two  spaces", "l1\nl2 w\nl3", "\n", "x y z", "naïve café", "tab\there", "a\r\nb", "\x00 nul", "b c d", "１２ ３", "it's we'll 12345 don't"]
    texts = [*odd_texts, *more]
    rows = al.align_documents(make_docs(texts, extra=("n_a", "key", "block")), TOKENIZER, PIECES, block_tokens=50).collect()
    want = plain_alignment(texts)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == dict(enumerate(want))
    assert len(rows) == len(texts)


def test_alignment_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = plain_alignment([r.text for r in docs])
    got = op11_token_alignment(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == sorted((r.doc_id, *w) for r, w in zip(docs, want))


def test_alignment_keeps_nulls_and_repeats(spark, make_docs):
    assert al.align_documents(make_docs([]), TOKENIZER, PIECES).count() == 0
    rows = al.align_documents(make_docs(["same text", "same text", None], ids=[None, 4, 4]), TOKENIZER, PIECES).collect()
    assert sorted((r.doc_id is None, r.n_links, r.count_sum) for r in rows) == [(False, 0, 0), (False, 2, 4), (True, 2, 4)]


def test_products_equal_dense_ones():
    r = np.random.default_rng(3)
    for step in (1, 7, 1000):
        a, b = r.random((9, 6)) < 0.4, r.random((6, 8)) < 0.4
        ptr = lambda m: np.concatenate([[0], np.cumsum(m.sum(axis=1))])
        out = np.zeros((9, 8), int)
        for rows, cols, values in al.row_product(ptr(a), np.nonzero(a)[1], ptr(b), np.nonzero(b)[1], 8, step):
            out[rows, cols] = values
        assert (out == a.astype(int) @ b.astype(int)).all()
        len_a, len_b = np.array([3, 1, 4, 2]), np.array([2, 2, 6])
        shared = np.zeros((4, 3), int)
        for x, y, n in al.overlap_links(len_a, len_b, step):
            np.add.at(shared, (x, y), n)
        inc = lambda lens: np.repeat(np.eye(len(lens), dtype=int), lens, axis=1)
        assert (shared == inc(len_a) @ inc(len_b).T).all()
    ga, gb = np.array([0, 0, 1]), np.array([0, 1, 1])
    assert [(x, y) for r, c, _ in al.shared_group_links(ga, gb, 1) for x, y in zip(r.tolist(), c.tolist())] == [(0, 0), (1, 0), (2, 1), (2, 2)]


def test_token_links(make_docs):
    row = al.token_links(make_docs(["hello  unbelievable"]), TOKENIZER, PIECES).first()
    assert sum(row.overlap_bytes) == len(" hello  unbelievable")
    assert len(row.group_a) == len(row.a_ids) and row.group_a[-1] == row.group_b[-1]
    assert row.n_group_links == sum(x == y for x in row.group_a for y in row.group_b)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fan):
    """The root, and per leaf its steps: slot and the run."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[k : k + fan] for k in range(0, len(level), fan)]
        for p, k in zip(paths, at):
            p.append((k % fan, runs[k // fan]))
        level, at = [h(*r) for r in runs], [k // fan for k in at]
    return level[0], paths


def plain_manifest(rows, fan):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, add=0: h(*map(field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + add, r.text)))
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[lang] = (own, *plain_tree([leaf(r) for r in own], fan))
    root, tops = plain_tree([trees[x][1] for x in langs], fan)
    out = []
    for lang, top in zip(langs, tops):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths):
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            cur = leaf(r, 1) if bad else leaf(r)
            sibs = ""
            for slot, run in [*path, *top]:
                sibs += "".join(run[:slot] + run[slot + 1 :])
                cur = h(*run[:slot], cur, *run[slot + 1 :])
            out.append((r.doc_id, leaf(r), sub, root, h(sibs), cur, cur == root))
    return out


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize(("fan", "tier", "n"), [(2, 2, 37), (3, 2, 31), (2, 8, 9), (4, 1, 70), (2, 3, 1)])
def test_manifest(spark, make_docs, fan, tier, n):
    texts = [None, "", "é日本", *[f"text {k // 3}" for k in range(n)]][:n]
    docs = make_docs(texts, ids=[None if k == 5 else k // 2 for k in range(n)], extra=("g", "idx", "h"))
    docs = docs.union(docs.limit(1)) if n > 1 else docs
    got = mk.verified(mk.manifest(docs, fan, tier)).collect()
    want = plain_manifest(docs.collect(), fan)
    assert by_text(map(tuple, got)) == by_text(want)
    assert n == 1 or not all(r.verified for r in got)


def test_manifest_of_an_empty_table(make_docs):
    assert mk.verified(mk.manifest(make_docs([]))).collect() == []


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType())])


def plain_links(rows, threshold):
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a].append(b)
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a, bs in links.items():
            least = min([label[a], *[label[b] for b in bs]]) if bs else label[a]
            if least != label[a]:
                label[a], changed = least, True
    return sorted((i if i is not None else -1, len(links[k]), label[k] if i is not None else -1, i is not None and label[k] == i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("threshold", [0.9, 0.5, 0.99])
def test_vector_links(spark, threshold):
    r = np.random.default_rng(5)
    middles = r.normal(size=(12, 16))
    rows = [(100 + k, (middles[k % 12] + r.normal(size=16) * r.choice([0.05, 0.3, 0.5])).tolist()) for k in range(400)]
    rows += [(600 + k, rows[3][1]) for k in range(30)]  # copies
    rows += [(700, (np.array(rows[4][1]) * 7).tolist()), (701, None), (702, []), (703, [0.0] * 16), (704, [float("nan")] * 16), (705, [None, 1.0]), (706, [1.0, 0.0]), (707, [2.0, 0.1]), (None, rows[3][1]), (708, rows[3][1]), (708, rows[5][1]), (709, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, 5, 6) for i, v in rows], VECTORS)
    got = vd.link_vectors(df, threshold, block=60).collect()
    out = sorted((x.vec_id if x.vec_id is not None else -1, x.n_links, x.component_id if x.component_id is not None else -1, x.kept) for x in got)
    assert out == plain_links(rows, threshold)
    assert vd.link_vectors(df.limit(0)).count() == 0


def test_bounds_hold_for_odd_scales():
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(200, 40)), r.normal(size=(200, 40)) ** 9, np.eye(40), np.full((1, 40), 1e-3)])
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    codes, scale, error = vd.quantised(unit)
    true, dots = unit @ unit.T, vd.products(codes, codes)
    bound = scale[:, None] * scale[None] * dots + error[:, None] + (1 + error[:, None]) * error[None]
    assert (bound >= true).all() and (vd.products(codes, codes) == codes.astype(int) @ codes.astype(int).T).all()
    wide = r.integers(-127, 128, size=(3, 5000)).astype(np.int8)
    assert (vd.products(wide, wide) == wide.astype(int) @ wide.astype(int).T).all()
    block = vd.Block(x)
    found = {tuple(sorted(p)) for a, b in vd.linked(block, block, True, 0.9) for p in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] @ x[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= 0.9}


def test_scales_that_overflow(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame([(i, v, 5, 6) for i, v in rows], VECTORS)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vd.link_vectors(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]
