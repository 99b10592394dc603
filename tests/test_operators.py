"""Border rules, round trips, planted coefficients, sources on small files, and the stream against the batch."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.functions import dates, geo, image
from driftgrid.operators import fit, geocode, grid, images, mosaic, sampling
from driftgrid.plans.queries import _scenes
from driftgrid.sources import rasters, sinks, text


def test_projection_round_trip_and_poles(spark):
    rows = [(float(lat), float(lon)) for lat in (60, 71.5, 85, 89.999) for lon in (0, 45, 123.4, 359)] + [(-75.0, 200.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    north = df.where("lat > 0").withColumn("p", geo.ll_to_xy(F.col("lat"), F.col("lon"), 45.0, 70.0))
    back = north.withColumn("b", geo.xy_to_ll(F.col("p.x"), F.col("p.y"), False, 45.0, 70.0)).collect()
    for r in back:
        if r.lat > 89.99:
            assert (r.p.x, r.p.y, r.b.lat) == (0.0, 0.0, 90.0)
        else:
            assert abs(r.lat - r.b.lat) < 1e-6 and abs((r.lon - r.b.lon + 180) % 360 - 180) < 1e-6
    s = df.where("lat < 0").withColumn("p", geo.ll_to_xy(F.col("lat"), F.col("lon"), 0.0, 71.0)).withColumn("b", geo.xy_to_ll(F.col("p.x"), F.col("p.y"), True, 0.0, 71.0)).first()
    assert abs(s.b.lat + 75) < 1e-6 and abs(s.b.lon - 200) < 1e-6


def test_cell_index_cuts_toward_zero(spark):
    r = spark.range(1).select(geo.xy_cell(F.lit(-0.5), F.lit(1.9), 0.0, 0.0, 1.0, 1.0).alias("c")).first().c
    assert (r.i, r.j) == (1, 0)


def test_date_weight_cases(spark):
    cases = [(10.0, 20.0, 0.0, 30.0, 1.0), (20.0, 40.0, 0.0, 30.0, 0.5), (-10.0, 10.0, 0.0, 30.0, 0.5), (100.0, 110.0, 0.0, 30.0, 0.0), (0.0, 100.0, 0.0, 30.0, 0.0), (5.0, 6.0, -1.0, 2.0e7, 1.0)]
    df = spark.createDataFrame([c[:4] for c in cases], "a double, b double, s double, e double")
    got = [r[0] for r in df.select(dates.date_weight(F.col("a"), F.col("b"), F.col("s"), F.col("e"))).collect()]
    assert got == pytest.approx([c[4] for c in cases])


def test_db_limits(spark):
    got = [r[0] for r in spark.createDataFrame([(1.0,), (0.0,), (1e-5,)], "v double").select(image.to_db(F.col("v"))).collect()]
    assert got == [0.0, -30.0, -29.91]


def test_bilinear_policies(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "i int, j int, z double")
    points = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, 0.5), (3, 1.0, 0.0), (4, 9.0, 9.0)], "k int, u double, v double")
    get = lambda policy: {r.k: r.z for r in sampling.sample_bilinear(points, cells, ["k"], ["z"], policy=policy).collect()}
    assert get("strict") == {1: 1.5, 2: None, 3: 2.0, 4: None}
    assert get("max")[2] == 3.0 and get("zero") == {1: 1.5, 2: 1.5, 3: 2.0, 4: 0.0}


def test_edges_and_feather(spark):
    box = (0, 6, 0, 6)
    cells = spark.createDataFrame([(1, i, j, *box) for i in range(6) for j in range(6) if (i, j) != (3, 3)], "k int, i int, j int, i_min int, i_max int, j_min int, j_max int")
    edges = {(r.i, r.j) for r in mosaic.edge_cells(cells, ["k"]).collect()}
    assert edges == {(i, j) for i in (2, 3, 4) for j in (2, 3, 4)} - {(3, 3)}
    f = {(r.i, r.j): r.f for r in mosaic.feather(cells, ["k"], 2).collect()}
    assert f[2, 2] == 0.25 and f[1, 1] == pytest.approx(math.sqrt(2) / 2) and f[0, 0] == 1.0
    assert all(r.f == 1.0 for r in mosaic.feather(cells, ["k"], 0).collect())


def test_mosaic_does_not_depend_on_order(spark):
    rows = [(k, 0, 0, float(k), -float(k), 1.0 + k, 2.0) for k in range(5)]
    schema = "pair_id int, i int, j int, vx double, vy double, sx double, sy double"
    a, b = (mosaic.finish(mosaic.mosaic_sums(spark.createDataFrame(r, schema))).first() for r in (rows, rows[::-1]))
    assert a.vx == pytest.approx(b.vx) and a.ex == pytest.approx(b.ex) and a.n == 5


def test_fit_finds_planted_coefficients(spark):
    rng = np.random.default_rng(1)
    theta, x = rng.uniform(-0.05, 0.05, 400), rng.uniform(-0.5, 0.5, 400)
    y = -12.5 * np.sin(theta) - 3 * x * np.cos(theta) + 2 * x * np.sin(theta) + 0.75
    ties = spark.createDataFrame([(1, float(a), float(b), 1.0, float(c)) for a, b, c in zip(theta, x, y)], "pair_id int, theta_d double, x double, weight double, y double")
    r = fit.fit_range_params(ties, "linear").first()
    assert r.params == pytest.approx([12.5, 3.0, -2.0, 0.75], abs=1e-6) and r.n == 400
    assert fit.fit_range_params(ties.limit(2), "linear").count() == 0


def test_fit_leaves_out_singular_keys(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 2.0), (2, 0.0, 1.0), (2, 1.0, 3.0)], "k int, x double, y double")
    got = fit.wls_fit(df, ["k"], F.col("y"), F.lit(1.0), [F.lit(1.0), F.col("x")]).collect()
    assert [r.k for r in got] == [2] and got[0].params == pytest.approx([1.0, 2.0])


def test_geocode_inverts_locate(spark, sf_dir):
    scenes = _scenes(spark, sf_dir).where("scene_id = 1")
    samples = spark.createDataFrame([(1, k, 1000.0 + 500 * k, 300.0 * k, 10.0 * k) for k in range(8)], "scene_id long, sample_id long, range double, azimuth double, h double")
    ground = geocode.locate(scenes, samples).join(samples.select("sample_id", "h"), "sample_id").withColumnRenamed("sample_id", "point_id")
    ground = ground.select("point_id", "lat", "lon", "h").persist()
    assert ground.where("lat is null").count() == 0
    wide = scenes.withColumns({"lat_min": F.lit(40.0), "lat_max": F.lit(89.0), "lon_min": F.lit(-180.0), "lon_max": F.lit(180.0)})
    got = {r.point_id: (r.range, r.azimuth) for r in geocode.geocode_points(ground, wide).collect()}
    assert len(got) == 8
    for k in range(8):
        assert got[k] == pytest.approx((1000 + 500 * k, 300 * k), abs=0.5)


def test_triangles_and_bounds(spark):
    tri = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 0.0, 4.0, 0.0, 4.0, 0.0, 0.0, 4.0, 0.0, 4.0)], "set_id int, tri_id int, x1 double, y1 double, vx1 double, vy1 double, x2 double, y2 double, vx2 double, vy2 double, x3 double, y3 double, vx3 double, vy3 double")
    got = {(r.i, r.j): (r.vx, r.vy) for r in grid.point_in_triangle(tri).collect()}
    assert len(got) == 15 and got[1, 2] == pytest.approx((2.0, 1.0))
    assert grid.point_in_triangle(tri, max_edge=5.0).count() == 0


def test_day_number_skips_leap_days(spark):
    days = ["2020-02-28", "2020-03-01", "2021-03-01"]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d string").select(images.day_number(F.col("d").cast("date"))).collect()]
    assert got[1] - got[0] == 1 and got[2] - got[1] == 365


def test_text_sources(spark, tmp_path):
    (tmp_path / "pairs").write_text("; list\n1 2 10 20 0.5 0.25\n2\np1 g1 b1 24\np2 g2 none 12 0.5 az azp None rp 0\n&\nignored x x 1\n")
    p = {r.phase_path: r for r in text.read_pair_list(spark, str(tmp_path / "pairs")).collect()}
    assert set(p) == {"p1", "p2"} and (p["p1"].weight, p["p1"].cross_flag, p["p2"].weight, p["p2"].cross_flag) == (1.0, 1, 0.5, 0)
    assert p["p2"].baseline_path is None and p["p2"].rg_offset_path is None
    g = text.read_grid_spec(spark, str(tmp_path / "pairs")).first()
    assert (g.origin_x, g.nx, g.dy) == (1000.0, 10, 250.0)
    (tmp_path / "images").write_text("i1 g1\ni2 g2 0.5 polyA\ni3 g3 1 other\n")
    assert [(r.weight, r.antenna_pattern) for r in text.read_image_list(spark, str(tmp_path / "images")).orderBy("input_seq").collect()] == [(1.0, None), (0.5, "polyA"), (1.0, None)]
    (tmp_path / "opt").write_text("m1 f1 k1 ; note\nm2\n& end\n")
    assert [(r.fit_path, r.mask_path) for r in text.read_optical_list(spark, str(tmp_path / "opt")).orderBy("input_seq").collect()] == [("f1", "k1"), ("m2.fit", None)]
    (tmp_path / "ties").write_text("; x\n70 -50 100 1 2 3\n71 -51 200 1 2 3 0.5\n&\n")
    assert sorted(r.weight for r in text.read_tie_points(spark, str(tmp_path / "ties"), "motion").collect()) == [0.5, 1.0]
    (tmp_path / "ll").write_text("70 -45 100\n71 -45 -5\n")
    assert [(r.z, r.valid) for r in text.read_ll_points(spark, str(tmp_path / "ll")).orderBy("point_id").collect()] == [(100.0, True), (None, False)]
    (tmp_path / "irr").write_text("70 -45 100 90\n")
    r = text.read_irregular_points(spark, str(tmp_path / "irr"), False, 45.0, 70.0).first()
    assert math.hypot(r.vx, r.vy) == pytest.approx(100)


def test_header_sources(spark, tmp_path):
    d = tmp_path / "off"
    d.mkdir()
    (d / "a.dat").write_text("1 2 10 20 3 4\ngeo.a /abs/geo.b\n")
    h = text.read_offset_headers(spark, str(d)).first()
    assert (h.pair_id, h.r0, h.na, h.delta_a, h.sigma_range, h.geo2) == ("a", 1, 20, 4.0, 0.0, "/abs/geo.b") and h.geo1.endswith("/off/geo.a")
    v = tmp_path / "vrt"
    v.mkdir()
    (v / "a.vrt").write_text('<VRTDataset rasterXSize="10" rasterYSize="20"><Metadata><MDI key="r0">5</MDI><MDI key="a0">6</MDI><MDI key="deltaR">3</MDI><MDI key="deltaA">4</MDI><MDI key="sigmaStreaks">0.1</MDI></Metadata></VRTDataset>')
    both = text.prefer(text.read_offset_vrts(spark, str(v)), text.read_offset_headers(spark, str(d)), "pair_id").collect()
    assert [(r.r0, r.nr, r.sigma_streaks) for r in both] == [(5, 10, 0.1)]
    m = tmp_path / "m"
    m.mkdir()
    (m / "x.dat").write_text("x0 = 100\ny0=200.5\nnx= 8\nEPSG = 3413\nIntervalBetweenImages = 16\n")
    r = text.read_optical_matches(spark, str(m)).first()
    assert (r.match_id, r.x0, r.y0, r.nx, r.epsg, r.delta_t, r.ny) == ("x", 100.0, 200.5, 8, 3413, 16.0, None)
    f = tmp_path / "f"
    f.mkdir()
    (f / "x.fit").write_text("Xfit = 1 2 3\nYfit = 4 5 6\nX_residual = 0 0 1.5\nY_residual = 0 0 2\n" + "\n".join(f"C{a}_{k} = {k} 0 0" for a in "XY" for k in (1, 2, 3)))
    r = text.read_optical_fits(spark, str(f)).first()
    assert r.px == [1, 2, 3] and r.sigma_y_res == 2.0 and r.cx == [1, 0, 0, 2, 0, 0, 3, 0, 0]
    (f / "y.fit").write_text("Xfit = 1 2 3\n")
    with pytest.raises(Exception, match="no covariance"):
        text.read_optical_fits(spark, str(f)).collect()


def test_fit_params_fall_back(spark, tmp_path):
    (tmp_path / "p1").write_text("; C_1 = 1 0\n; C_2 = 0 1\n; sigma*sqrt(X2/n)= 0.25\n1 2 3\n")
    (tmp_path / "p1.deltabp").write_text("; sigma*sqrt(X2/n)= 0.5\n4 5\n")
    (tmp_path / "p2").write_text("7 8 9\n")
    got = {r.pair_id: r for r in text.read_fit_params(spark, str(tmp_path), "range", "deltabp").collect()}
    assert (got["p1"].mode, got["p1"].params, got["p1"].sigma_res) == ("deltabp", [4, 5], 0.5)
    assert (got["p2"].mode, got["p2"].params, got["p2"].cov) == ("none", [7, 8, 9], None)
    assert text.read_fit_params(spark, str(tmp_path), "range").where("pair_id = 'p1'").first().cov == [1, 0, 0, 1]


def test_scenes_sidecars_and_baselines(spark, tmp_path):
    s = tmp_path / "s"
    s.mkdir()
    props = {"ImageName": "A", "Date": "2020-01-02", "MLCenterRange": "850000", "MLRangeSize": "101", "MLRangePixelSize": "10", "RangeErrorCorrection": "5", "NumberOfStateVectors": "1", "SV_t0": "0", "SV_dt": "10", "SV_Pos_1": "[1, 2, 3]", "SV_Vel_1": "[4, 5, 6]"}
    (s / "g.geojson").write_text(json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 70], [0, 71], [1, 71], [1, 70], [0, 70]]]}, "properties": props}))
    r = text.read_scenes_geojson(spark, str(s)).first()
    assert (r.rc, r.rn, r.rf) == (849995.0, 849495.0, 850495.0) and len(r.control_points) == 4 and r.states[0].vz == 6.0 and str(r.date) == "2020-01-02"
    t = tmp_path / "t"
    t.mkdir()
    (t / "geodat").write_text("Rcenter : 850.5\nName: x\n")
    assert text.read_scenes_text(spark, str(t)).select(text.metadata_number("Rcenter")).first()[0] == 850.5
    assert text.read_sar_par(spark, str(t)).first().lines[0] == [850.5]
    side = tmp_path / "side"
    for name, files in {"a": {"tide.correction": "0.3", "betaNought": "237"}, "b": {"tide.difference": "grid", "betaNought": "5"}}.items():
        (side / name).mkdir(parents=True)
        for n, c in files.items():
            (side / name / n).write_text(c)
    got = {r.scene_id: r for r in text.read_sidecars(spark, str(side / "*")).collect()}
    assert (got["a"].tide_correction, got["a"].beta_nought) == (0.3, 237.0) and (got["b"].tide_correction, got["b"].has_tide_difference, got["b"].beta_nought) == (0.0, True, None)
    base = tmp_path / "base"
    (base / "p").mkdir(parents=True)
    (base / "p" / "b1").write_text("; x\n1 2 3 4\n")
    (base / "p" / "b2").write_text("1 1 1 1 5 6\n")
    r = text.read_flattening_baselines(spark, str(base / "*")).first()
    assert (r.pair_id, r.bn, r.dbp, r.dbpq) == ("p", 2.0, 5.0, 6.0)


def test_planes_and_tiles(spark, tmp_path):
    values = np.arange(12, dtype=">f4").reshape(3, 4)
    values[1, 2] = -2e9
    for band in ("dx", "dy", "sx", "sy"):
        (tmp_path / f"m.{band}").write_bytes(values.tobytes())
    cells = rasters.read_optical_cells(spark, str(tmp_path), 4)
    got = {(r.i, r.j): r.dx for r in cells.collect()}
    assert len(got) == 11 and got[2, 3] == 11.0 and (1, 2) not in got
    mask = spark.createDataFrame([("m", 0, 0, 0), ("m", 0, 1, 1)], "match_id string, i int, j int, value int")
    assert rasters.read_optical_cells(spark, str(tmp_path), 4, mask).count() == 10
    flipped = {(r.i, r.j): r.value for r in rasters.read_planes(spark, str(tmp_path / "m.dx"), 4, flip=True).collect()}
    assert flipped[0, 3] == 11.0
    out = str(tmp_path / "tiles")
    big = spark.range(1000).select(F.col("id").cast("int").alias("i"), (F.col("id") % 7).cast("int").alias("j"), F.rand(1).alias("vx"))
    sinks.write_tiles(big, out)
    part = rasters.crop(spark.read.parquet(out), 300, 310, 0, 7)
    assert part.count() == 10
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ti" in plan


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 1.0, 2.0, 4.0, 9.0, 0.5, None, 3), (0, 1, None, None, None, None, None, None, 0)], "i int, j int, vx double, vy double, ex double, ey double, dt double, vz double, n int")
    rows = {r.j: r for r in sinks.velocity_layers(m).collect()}
    assert (rows[0].ex, rows[0].ey, rows[1].vx, rows[1].ex) == (2.0, 3.0, -2e9, -2e9)
    sinks.write_velocity_mosaic(m, str(tmp_path / "m"), "2020-01-01", "2020-02-01", 3413)
    assert spark.read.json(str(tmp_path / "m/metadata")).first().epsg == 3413
    ties = spark.createDataFrame([(70.0, -45.0, 10.0, 1.0, 2.0, 3.0)], "lat double, lon double, z double, vx double, vy double, vz double")
    sinks.write_tie_points(ties, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["&", "70.000000 -45.000000 10.00 1.000 2.000 3.000"]


def test_stream_equals_batch_and_repeats_nothing(spark, sf_dir, tmp_path):
    from driftgrid.streaming import incremental

    src = tmp_path / "in"
    rows = spark.range(400).select((F.col("id") % 5).cast("int").alias("i"), (F.col("id") % 3).cast("int").alias("j"), F.col("id").cast("double").alias("vx"), F.lit(1.0).alias("vy"), F.lit(2.0).alias("sx"), F.lit(2.0).alias("sy"))
    rows.where("vx < 200").write.parquet(str(src / "a"))
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "cp")
    run = lambda: incremental.start(spark.readStream.schema(rows.schema).parquet(str(src / "*")), state, checkpoint).awaitTermination()
    run()
    rows.where("vx >= 200").write.parquet(str(src / "b"))
    run()
    run()
    got = {(r.i, r.j): (r.vx, r.n) for r in incremental.current(spark, state).collect()}
    want = {(r.i, r.j): (r.vx, r.n) for r in mosaic.finish(mosaic.mosaic_sums(rows)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_rtc_gathers_along_x_and_stops_at_shadow(spark):
    rows = [(10, 10, 5.0, 5.0, 1.0, 4.0, 0.0, 0.5), (10, 13, 5.0, 5.0, 100.0, 1.0, -9.0, 0.5), (13, 10, 5.0, 5.0, 10000.0, 1.0, -9.0, 0.5), (30, 30, 5.0, 5.0, 1.0, 4.0, 0.0, -0.5), (30, 31, 5.0, 5.0, 7.0, 1.0, -9.0, 0.5)]
    got = {(r.i, r.j): r for r in images.rtc_area_sum(spark.createDataFrame(rows, "i int, j int, r double, a double, ab double, ag double, db double, shadow double")).collect()}
    assert got[10, 10].ab_sum == 101.0 and got[10, 10].ratio == 101.0 / 5.0
    assert got[30, 30].ratio == -1.0 and got[30, 30].ab_sum == 1.0 and got[13, 10].ab_sum == 10000.0


def test_calibration_plan_end_to_end(spark, sf_dir):
    from driftgrid.operators import geocode
    from driftgrid.plans import velocity as plans

    scenes = _scenes(spark, sf_dir).where("scene_id = 1")
    samples = geocode.radar_grid(scenes, 400).withColumn("h", F.lit(0.0))
    ties = geocode.locate(scenes, samples).select(F.lit(7).alias("pair_id"), F.col("sample_id").alias("tie_id"), "lat", "lon", *[F.lit(v).alias(n) for n, v in (("z", 0.0), ("vx", 0.0), ("vy", 0.0), ("vz", 0.0), ("weight", 1.0), ("x", 1.0), ("y", 2.0))], F.lit(0).alias("code"))
    pairs = spark.createDataFrame([(7, 1, 12.0, 0.0, 0.0, 100.0, 100.0, 2.5, 0.4, 0.0, 9.0, 120.0, 45.0)], "pair_id int, scene_id long, n_days double, r0 double, a0 double, delta_r double, delta_a double, range_pixel double, theta_c double, tide_difference double, weight double, bn double, bp double")
    offsets = spark.range(0, 90 * 90).select(F.lit(7).alias("pair_id"), (F.col("id") % 90).cast("int").alias("i"), (F.col("id") / 90).cast("int").alias("j"), F.lit(5.0).alias("dr"))
    ready = plans.calibration_ties(ties, pairs, scenes, offsets)
    rows = ready.collect()
    assert len(rows) > 20 and all(r.y == pytest.approx(12.5) for r in rows)
    got = plans.calibration_fit(ties, pairs, scenes, offsets, "const").first()
    way = [(r.slant**2 - 2 * r.slant * (120 * math.sin(r.theta_d) + 45 * math.cos(r.theta_d)) + 120**2 + 45**2) ** 0.5 - r.slant for r in rows]
    assert got.const == pytest.approx(12.5 - sum(way) / len(way), abs=1e-4) and got.bn == 120.0 and got.n == len(rows) and got.n_given >= got.n


def test_mixed_round_takes_its_range_from_phase(spark, sf_dir):
    from driftgrid.functions import velocity
    from driftgrid.plans import velocity as plans
    from driftgrid.plans.fixtures import fixture

    own = fixture(spark, sf_dir, "radar_fx").where("pair_id < 4")
    geometry = {"slant": 850000.0, "radius": 6371000.0, "orbit": 7071000.0, "flat_orbit": 7071000.0, "theta_c": 0.4, "flat_theta_c": 0.4, "bn": 20.0, "bp": 5.0, "two_k": 222.0}
    rows = own.withColumns({n: F.lit(v) for n, v in geometry.items()})
    c = F.col
    topo = velocity.topo_phase(c("slant"), c("z"), c("radius"), c("orbit"), c("flat_orbit"), c("theta_c"), c("flat_theta_c"), c("bn"), c("bp"), c("two_k"))
    phased = rows.withColumn("phase", F.when(c("i") % 5 != 0, c("dr") * c("two_k") + topo).otherwise(-2e9))
    got = {(r.i, r.j): r for r in plans.phase_azimuth_sums(phased.drop("dr", "sr"), 0).collect()}
    ready = plans.phase_samples(phased.drop("dr", "sr")).select("pair_id", "i", "j", c("sr").alias("phase_sr"))
    want = {(r.i, r.j): r for r in plans.speckle_sums(own.join(ready, ["pair_id", "i", "j"]).withColumn("sr", c("phase_sr")), 0).collect()}
    assert got.keys() == want.keys() and got and not any(i % 5 == 0 for i, _ in got)
    for k, r in want.items():
        assert got[k].vx_sum == pytest.approx(r.vx_sum, rel=1e-6, abs=1e-9) and got[k].x_scale == pytest.approx(r.x_scale, rel=1e-9)
