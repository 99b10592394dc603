"""Rows and plans that the small tables don't have."""

import comparing
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from driftgrid.operators import geocode, sampling
from driftgrid.plans.queries import ORACLE_SQL, QUERIES, _scenes


def test_places_on_the_edge_of_a_box_count(spark, tmp_path):
    """Places 20.5 degrees from an orbit whose longitude isn't the same when it comes back from radians."""
    pq.write_table(pa.table({"s_suppkey": [336, 1173, 1748, 1923, 4278]}), tmp_path / "supplier.parquet")
    pq.write_table(pa.table({"c_custkey": [16150, 18950, 26950, 30650, 53150, 88150], "c_acctbal": [0.0] * 6}), tmp_path / "customer.parquet")
    con = comparing.duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    comparing.assert_same(QUERIES["J8_geocode_places"](spark, str(tmp_path)), con, ORACLE_SQL["J8_geocode_places"])
    assert {r.lon_min % 1 for r in _scenes(spark, str(tmp_path)).collect()} == {0.0}


def shuffled(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    gateway, store = spark.sparkContext._gateway, spark._jsc.sc().statusStore()
    none = gateway.jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_of_points_and_scenes_are_not_shuffled(spark, sf_dir):
    """All points are in the boxes of all scenes: their pairs are 9,000, many times the rows of both sides."""
    scenes = _scenes(spark, sf_dir).withColumns({"lon_min": F.lit(0.0), "lon_max": F.lit(9.0), "lat_min": F.lit(70.6), "lat_max": F.lit(79.4)})
    points = spark.range(900).selectExpr("id AS point_id", "71 + id % 80 / 10D AS lat", "id % 9 + 0.5D AS lon", "0D AS h")
    before = shuffled(spark)
    assert geocode.geocode_points(points, scenes).count() == 9000
    assert shuffled(spark) - before < 4500


def test_blocks_geocode_as_the_kernel_does(spark, sf_dir, monkeypatch):
    """Scenes of 9 to 12 vectors with wavering orbits, in many parts, against the kernel on every pair in a box."""
    monkeypatch.setattr(geocode, "BLOCK_SCENES", 3)
    monkeypatch.setattr(geocode, "BLOCK_POINTS", 100)
    waver = lambda s: F.struct(*[(s[c] + (F.sin(s["z"]) * 30 if c in "xyz" else F.cos(s["z"]) / 2)).alias(c) for c in geocode.STATE])
    some = _scenes(spark, sf_dir).withColumns({"states": F.slice(F.transform("states", waver), 1, (12 - F.col("scene_id") % 4).cast("int")), "lon_min": F.col("lon_min") - 30, "lon_max": F.col("lon_max") + 30, "n_azimuth": (1000 + F.col("scene_id") * 4000).cast("int")}).persist()
    points = spark.range(3000).selectExpr("id AS point_id", "60 + id * 7 % 2400 / 100D AS lat", "CASE WHEN id <> 5 THEN id * 37 % 3600 / 10D END AS lon", "CASE WHEN id % 50 <> 0 THEN id % 9 * 300D END AS h", "'p' || id AS name").persist()
    got = {(r.scene_id, r.point_id): (r.name, r.range, r.azimuth) for r in geocode.geocode_points(points, some, keep=("name",)).collect()}
    want = {}
    rows = [r for r in points.collect() if r.lon is not None]
    for s in some.collect():
        own = [r for r in rows if s.lat_min - 0.5 <= r.lat <= s.lat_max + 0.5 and s.lon_min - 0.5 <= r.lon <= s.lon_max + 0.5]
        n = len(own)
        scene = {c: np.full(n, s[c]) for c in geocode.SCENE if c != "flat"} | {"vectors": np.repeat(np.array([[list(v) for v in s.states]]), n, axis=0)}
        r, a, _, _, good = geocode._image_place(*[np.array([x[c] if x[c] is not None else np.nan for x in own]) for c in ("lat", "lon", "h")], scene)
        want |= {(s.scene_id, x.point_id): (x.name, float(r[k]) if good[k] else None, float(a[k]) if good[k] else None) for k, x in enumerate(own)}
    assert got == want
    found = sum(v[1] is not None for v in want.values())
    assert 100 < found < len(want) / 2


def broadcast(spark, after: int = -1) -> tuple[int, int]:
    """The last query that ran, and how many tables those after the given one have sent to all tasks."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    ids = [i for i in (runs.apply(k).executionId() for k in range(runs.size())) if i > after]
    graphs = [store.planGraph(i).allNodes() for i in ids]
    return max([after, *ids]), sum(g.apply(k).name() == "BroadcastExchange" for g in graphs for k in range(g.size()))


def test_rounds_on_terrain_broadcast_nothing(spark, sf_dir):
    """Scenes with their states, and samples, which Spark takes to be as small as the table of suppliers."""
    before, _ = broadcast(spark)
    assert QUERIES["J11_terrain"](spark, sf_dir).where("on_dem and on_sphere").count() == 300
    assert broadcast(spark, before)[1] == 0


def test_squares_sample_as_corners_do(spark):
    """Holes, nulls, places on nodes and on lines of nodes, off the grid, and a grid that isn't there."""
    cells = spark.range(180).selectExpr("CAST(id % 2 AS INT) AS g", "CAST(id div 2 % 9 AS INT) - 2 AS i", "CAST(id div 18 AS INT) AS j", "CASE WHEN id % 31 <> 7 THEN sin(id) END AS a", "id * 1.5D AS b").where("(i * 5 + j + g) % 13 <> 0")
    points = spark.range(900).selectExpr("id AS k", "CAST(id % 3 AS INT) AS g", "id * 7 % 45 / 4D - 0.5 AS u", "CASE WHEN id <> 8 THEN id * 11 % 48 / 4D - 3 END AS v", "'p' || id AS name")
    want = {r.k: r for r in sampling.sample_bilinear(points, cells, ["k"], ["a", "b"], ["g"]).dropna().collect()}
    got = sampling.sample_squares(points, cells, ["g"], ["a", "b"]).collect()
    assert 100 < len(got) < 600 and {r.k for r in got} == set(want) and len(got) == len(want)
    assert all(r.name == f"p{r.k}" and abs(r.a - want[r.k].a) < 1e-12 and abs(r.b - want[r.k].b) < 1e-9 for r in got)


def test_cells_are_not_multiplied_on_their_way_to_samples(spark, sf_dir):
    """Ten pairs of 289 cells, of which four corners each went through two shuffles."""
    before = shuffled(spark)
    assert QUERIES["radar_samples"](spark, sf_dir).count() > 1000
    assert shuffled(spark) - before < 25000
