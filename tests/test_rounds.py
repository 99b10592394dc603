"""Terrain rounds, planes by byte range and the pair index."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import geocode, grid, terrain
from driftgrid.plans.queries import _scenes
from driftgrid.sources import byte_ranges


def test_rounds_shrink_and_samples_without_ground_are_null(spark, sf_dir):
    scenes = _scenes(spark, sf_dir).where("scene_id = 1")
    samples = geocode.radar_grid(scenes, 500).where("azimuth = 2000")
    beyond = samples.limit(1).withColumns({"sample_id": F.lit(-1).cast("long"), "range": F.lit(-5e4)})  # nearer than the ground
    flat = geocode.locate(scenes, samples.withColumn("h", F.lit(0.0)))
    from driftgrid.functions.geo import ll_to_xy

    at = flat.withColumn("p", ll_to_xy(F.col("lat"), F.col("lon"), 45.0, 70.0)).agg(*[F.floor(f(f"p.{c}") / 2).alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))]).first()
    rows = [(i, j, 800.0 + 300 * math.sin(i / 3) * math.cos(j / 4)) for i in range(at.y0 - 9, at.y1 + 10) for j in range(at.x0 - 9, at.x1 + 10)]
    dem = spark.createDataFrame(rows, "i int, j int, z double")
    got = terrain.radar_grid_on_terrain(scenes, samples.unionByName(beyond), dem, 45.0, 70.0, (0.0, 0.0), 2.0, mask=dem.select("i", "j", F.lit(3).alias("code"))).collect()
    z = {(r[0], r[1]): r[2] for r in rows}
    by_round = {}
    for r in got:
        if r.sample_id == -1:
            assert r.lat is None and r.height is None and r["round"] is None
            continue
        by_round[r["round"]] = by_round.get(r["round"], 0) + 1
        p = spark.range(1).select(ll_to_xy(F.lit(r.lat), F.lit(r.lon), 45.0, 70.0).alias("p")).first().p
        u, v = p.x / 2, p.y / 2
        j, i = math.floor(u), math.floor(v)
        t, s = u - j, v - i
        height = z[i, j] * (1 - t) * (1 - s) + z[i, j + 1] * t * (1 - s) + z[i + 1, j] * (1 - t) * s + z[i + 1, j + 1] * t * s
        assert abs(height - r.height) < 0.15 and r.mask == 3
    assert sum(by_round.values()) == 12 and len(by_round) > 1 and max(by_round) < 40


def test_steep_slopes_are_layover_and_shadow(spark, sf_dir):
    scenes = _scenes(spark, sf_dir).where("scene_id = 1")
    samples = geocode.radar_grid(scenes, 40).where("azimuth = 2000")
    from driftgrid.functions.geo import ll_to_xy

    flat = geocode.locate(scenes, samples.withColumn("h", F.lit(0.0))).withColumn("p", ll_to_xy(F.col("lat"), F.col("lon"), 45.0, 70.0)).orderBy("sample_id").collect()
    x0, y0, x1, y1 = flat[0].p.x, flat[0].p.y, flat[-1].p.x, flat[-1].p.y
    length = math.hypot(x1 - x0, y1 - y0)

    def ridge(i, j):
        along = ((j * 0.5 - x0) * (x1 - x0) + (i * 0.5 - y0) * (y1 - y0)) / length
        return max(0.0, 6000 * (1 - abs(along - length / 2) / 2))  # km along the ground range: 3 in 1 on both sides

    i0, i1, j0, j1 = (math.floor(f(a, b) / 0.5) + d for f, a, b, d in ((min, y0, y1, -40), (max, y0, y1, 40), (min, x0, x1, -40), (max, x0, x1, 40)))
    dem = spark.createDataFrame([(i, j, float(ridge(i, j))) for i in range(i0, i1) for j in range(j0, j1)], "i int, j int, z double")
    got = terrain.radar_grid_on_terrain(scenes, samples, dem, 45.0, 70.0, (0.0, 0.0), 0.5).collect()
    assert sum(r.lat is not None for r in got) >= 0.9 * len(got)
    assert 0 < sum(r.layover for r in got if r.lat is not None) < 0.6 * len(got) and any(r.shadow for r in got if r.lat is not None)


def planes(tmp_path, rows=40, columns=30):
    out = {}
    for k, band in enumerate(("da", "dr")):
        p = (np.arange(rows * columns).reshape(rows, columns) * 0.5 + k).astype(">f4")
        p[3, 4] = p[10] = -2e9
        out[band] = p
        (tmp_path / f"a.{band}").write_bytes(p.tobytes())
    return out


@pytest.mark.parametrize("flip", [False, True])
def test_planes_by_byte_range(spark, tmp_path, flip):
    want = planes(tmp_path)
    grids = byte_ranges.grid_files(str(tmp_path), 30, ("da", "dr"))
    assert [g["rows"] for g in grids] == [40]
    box = {"i_min": 5, "i_max": 31, "j_min": 2, "j_max": 9}
    got = byte_ranges.read_plane_files(spark, grids, ("da", "dr"), box=box, flip=flip, split=30 * 4 * 2 * 7)
    assert got.rdd.getNumPartitions() == 4
    held = {(r.i, r.j): (r.da, r.dr) for r in got.collect()}
    source = {b: p[::-1] if flip else p for b, p in want.items()}
    assert held == {(i, j): (float(source["da"][i, j]), float(source["dr"][i, j])) for i in range(5, 31) for j in range(2, 9) if source["da"][i, j] > -1e9}
    assert byte_ranges.read_plane_files(spark, grids, ("da", "dr"), box={"i_min": 90, "i_max": 95}).count() == 0


def test_a_box_reads_its_bytes_only(spark, tmp_path, monkeypatch):
    planes(tmp_path)
    import json

    grids = byte_ranges.grid_files(str(tmp_path), 30, ("dr",))
    options = {"grids": json.dumps(grids), "names": '["dr"]', "kind": ">f4", "flip": "false", "no_data": "-1.9e9", "split": "1000", "box": json.dumps({"i_min": 5, "i_max": 31, "j_min": 2, "j_max": 9})}
    reader = byte_ranges.PlaneReader(options)
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def read_at(self, length, offset):
            read.append((offset, length))
            return self.f.read_at(length, offset)

        def close(self):
            self.f.close()

    class System:
        def open_input_file(self, name):
            assert name.endswith(".dr")  # the other band isn't opened
            return Counting(byte_ranges.fs_local().open_input_file(name))

    from pyarrow import fs

    monkeypatch.setattr(byte_ranges, "fs_local", fs.LocalFileSystem, raising=False)
    monkeypatch.setattr(byte_ranges, "file_system", lambda path: (System(), path))
    parts = reader.partitions()
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 26 * 7 - 7
    assert sum(n for _, n in read) == 26 * 7 * 4 and len(parts) > 1


def test_files_that_lack_rows_are_refused(tmp_path):
    planes(tmp_path)
    (tmp_path / "b.da").write_bytes(b"123")
    with pytest.raises(ValueError, match="whole rows"):
        byte_ranges.grid_files(str(tmp_path), 30, ("da", "dr"))


def test_phase_pairs_meet_in_their_tiles_only(spark):
    rows = [(k, k % 2, 2458849.5 + k % 500, 1, 1.0, 40 * (k // 10), 40 * (k // 10) + 30 + k % 20, 0, 70) for k in range(1000)]
    pairs = spark.createDataFrame(rows, "pair_id int, pass_type int, jd1 double, cross_flag int, weight double, i_min int, i_max int, j_min int, j_max int")
    got = {(r.a_pair_id, r.b_pair_id) for r in grid.crossing_pairs(pairs, 548.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and max(a[5], b[5]) < min(a[6], b[6])}
    assert got == want
    assert grid.crossing_candidates(pairs, 548.0, 0.05, 64).count() < 12 * len(want) < 1000 * 999 / 2
