"""Halo blocks against plain loops, and the stream's tiles."""

import math

import pytest
from pyspark.sql import functions as F

from driftgrid.operators import blocks
from driftgrid.streaming import incremental


def plain_feather(cells, box, fl):
    valid = set(cells)
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    edges = {(i, j) for i, j in valid if any((i + a, j + b) not in valid and box[0] <= i + a < box[1] and box[2] <= j + b < box[3] for a, b in around)}
    out = {}
    for i, j in valid:
        f = [min(max(math.hypot(a, b), 0.5) / fl, 1.0) for a in range(-fl, fl + 1) for b in range(-fl, fl + 1) if (i + a, j + b) in edges]
        out[i, j] = min([*f, 1.0])
    return out


@pytest.mark.parametrize(("tile", "fl"), [(4, 1), (5, 3), (128, 3), (7, 4)])
def test_feather_does_not_depend_on_tiles(spark, tile, fl):
    want, rows = {}, []
    for k in (1, 2, None):
        box = (-6, 17, 3, 25) if k != 2 else (0, 9, -4, 12)
        cells = [(i, j) for i in range(box[0], box[1]) for j in range(box[2], box[3]) if (i * 7 + j * 3) % 19 and math.hypot(i - 8, j - 12) > 2]
        want |= {(k, *c): f for c, f in plain_feather(cells, box, fl).items()}
        rows += [(k, i, j, *box, float(i * j), "x") for i, j in cells]
    df = spark.createDataFrame(rows, "k int, i int, j int, i_min int, i_max int, j_min int, j_max int, v double, `odd name` string").repartition(6)
    got = blocks.feather(df, ["k"], fl, tile)
    assert got.columns == [*df.columns, "f"]
    held = {(r.k, r.i, r.j): r for r in got.collect()}
    assert {c: r.f for c, r in held.items()} == pytest.approx(want) and all(r.v == r.i * r.j for r in held.values())
    assert blocks.feather(df.limit(0), ["k"], fl, tile).count() == 0
    assert {r.f for r in blocks.feather(df, ["k"], 0).collect()} == {1.0}


@pytest.mark.parametrize("tile", [4, 9, 128])
def test_blocks_sample_as_one_plane(spark, tile):
    boxes = [(1, -3, 20, 0, 30, -0.4, 0.4, 1.5, 0.5), (2, 2, 9, 2, 9, 20.0, -2.0, 0.25, 1.0), (3, 5, 5, 0, 9, 0.0, 1.0, 0.0, 1.0)]
    node = lambda k, i, j: (i * 10 + j * k) * 0.5
    nodes = [(k, i, j, node(k, i, j)) for k in (1, 2, 3) for i in range(0, 12) for j in range(0, 21) if (i * 5 + j * 3 + k) % 17]
    gone = [(i, i + 3) for i in range(0, 15)]
    held = {(k, i, j): v for k, i, j, v in nodes}
    want = {}
    for k, i0, i1, j0, j1, u0, du, v0, dv in boxes:
        found = {}
        for i in range(i0, i1):
            for j in range(j0, j1):
                u, v = u0 + du * j, v0 + dv * i
                a, b = math.floor(v), math.floor(u)
                s, t = v - a, u - b
                corners = [((a, b), (1 - s) * (1 - t)), ((a, b + 1), (1 - s) * t), ((a + 1, b), s * (1 - t)), ((a + 1, b + 1), s * t)]
                corners = [(held.get((k, *c)), w) for c, w in corners if w > 0]
                if all(c is not None for c, _ in corners) and (i, j) not in gone:
                    found[i, j] = sum(c * w for c, w in corners)
        f = plain_feather(found, (i0, i1, j0, j1), 2)
        want |= {(k, *c): (v, f[c]) for c, v in found.items()}
    made = blocks.sample_feathered(
        spark.createDataFrame(boxes, "k int, i_min int, i_max int, j_min int, j_max int, u0 double, du double, v0 double, dv double"),
        spark.createDataFrame(nodes, "k int, i int, j int, z double"), ["k"], ["z"], 2, spark.createDataFrame(gone, "i int, j int"), tile,
    )
    got = {(r.k, r.i, r.j): (r.z, r.f) for r in made.collect()}
    assert set(got) == set(want) and len(got) > 100
    for c, (z, f) in want.items():
        assert got[c] == pytest.approx((z, f))


def test_batches_emit_what_they_touch_and_folders_stay_bounded(spark, tmp_path):
    state = str(tmp_path / "state")
    schema = "i int, j int, vx double, vy double, sx double, sy double"
    sent = [[(k, k % 5, float(k), 1.0, 1.0, 2.0) for k in range(b * 3, b * 3 + 6)] + [(700 + b, 3, 2.0, 2.0, 1.0, 1.0)] for b in range(6)]
    for number, rows in enumerate(sent):
        batch = spark.createDataFrame(rows, schema)
        cells = {(r.i, r.j): (r.vx, r.n) for r in incremental.add_batch(batch, number, state).collect()}
        so_far = [x for b in sent[: number + 1] for x in b]
        assert set(cells) == {(r[0], r[1]) for r in rows}
        for (i, j), (vx, n) in cells.items():
            own = [x for x in so_far if x[:2] == (i, j)]
            assert n == len(own) and vx == pytest.approx(sum(x[2] for x in own) / len(own))
        if number == 3:  # the same batch once more
            again = {(r.i, r.j): (r.vx, r.n) for r in incremental.add_batch(batch, number, state).collect()}
            assert again == cells
    assert all(len(b) <= 2 for b in incremental.versions(spark, state).values())
    everything = [x for b in sent for x in b]
    whole = {(r.i, r.j): r.n for r in incremental.current(spark, state).collect()}
    assert sum(whole.values()) == len(everything) and set(whole) == {x[:2] for x in everything}
    assert incremental.current(spark, state, [(2, 0)]).count() == 6
    assert incremental.add_batch(spark.createDataFrame([], schema), 9, state) is None
    assert incremental.current(spark, str(tmp_path / "none")).where(F.col("n") > 0).count() == 0
