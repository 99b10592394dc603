"""Typed scenes from files, and what they feed."""

import pytest
from pyspark.sql import functions as F

from driftgrid.operators import geocode
from driftgrid.plans.queries import _scenes
from driftgrid.sources import scenes


def lines(s, looks=(1, 1)):
    out = ["Image name :  orbit one", "Image date : 05 MAR 2021", ";", f"{s.n_range} {s.n_azimuth} {looks[0]} {looks[1]}", f"6378.137 6356.752 {(s.near + (s.n_range - 1) * s.pixel / 2) / 1000!r} 70 700"]
    out += ["60 1", "60 2", "; a corner", "80 1", "80 2", "70 1.5", f"{s.pixel} 4", "Ascending", "RIGHT", "state", "0 0 50", f"{s.prf}", "0.056", f"{len(s.states)}", f"{s.t0}", f"{s.step}"]
    for v in s.states:
        out += [f"{v.x!r} {v.y!r} {v.z!r}", f"{v.vx!r} {v.vy!r} {v.vz!r}"]
    return out


def test_text_scene_feeds_the_kernels(spark, sf_dir, tmp_path):
    own = _scenes(spark, sf_dir).where("scene_id = 1")
    s = own.first()
    (tmp_path / "one.geodat").write_text("\n".join(lines(s)) + "\n")
    (tmp_path / "cut.geodat").write_text("\n".join(lines(s)[:9]))
    (tmp_path / "empty.geodat").write_text("x")
    found = scenes.text_scenes(spark, str(tmp_path))
    rows = {r.scene_id: r for r in found.collect()}
    assert rows["one"].problem is None and str(rows["one"].image_date) == "2021-03-05" and rows["one"].rn == pytest.approx(s.near) and rows["one"].jd == pytest.approx(2459279 + 50 / 86400)
    assert "states" in rows["cut"].problem and "control_points" in rows["cut"].problem and "prf" in rows["empty"].problem
    ready = scenes.radar_scenes(found)
    samples = spark.createDataFrame([(k, 1000.0 * k, 500.0 * k, 10.0 * k) for k in range(5)], "sample_id long, range double, azimuth double, h double")
    got = geocode.locate(ready, samples.withColumn("scene_id", F.lit("one"))).orderBy("sample_id").collect()
    want = geocode.locate(own, samples.withColumn("scene_id", F.lit(1).cast("long"))).orderBy("sample_id").collect()
    for a, b in zip(got, want, strict=True):
        assert (a.lat, a.lon) == pytest.approx((b.lat, b.lon), abs=1e-7)


def test_layouts_in_order_of_precedence(spark, sf_dir, tmp_path):
    s = _scenes(spark, sf_dir).where("scene_id = 1").first()
    for d in ("t", "p"):
        (tmp_path / d).mkdir()
    (tmp_path / "t" / "a.geodat").write_text("\n".join(lines(s)))
    par = ["old one", "7 JUN 2001", "10 20 30.5", "VV", "70 20", "190", "785000.5 m", *["x"] * 4, "1679.9", "0 0 0 0"]
    for n in ("a", "b"):
        (tmp_path / "p" / f"{n}.par").write_text("\n".join(par))
    rows = {r.scene_id: r for r in scenes.all_scenes(scenes.text_scenes(spark, str(tmp_path / "t")), scenes.par_scenes(spark, str(tmp_path / "p"))).collect()}
    assert rows["a"].source == "text" and rows["b"].source == "par"
    assert (str(rows["b"].image_date), rows["b"].seconds, rows["b"].altitude, rows["b"].prf) == ("2001-06-07", 37230.5, 785000.5, 1679.9) and "states" in rows["b"].problem
