"""What large tables need: no join that compares all rows, and none that sends tables whole to every task without knowing how large they are."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from driftgrid.operators import calibrate, fit
from driftgrid.operators.blocks import edge_distance, feather
from driftgrid.operators.images import orbit_coverage
from driftgrid.plans.fixtures import fixture
from driftgrid.plans.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["obs_fx", "radar_fx"])
def test_bands_are_joined_on_their_rows(spark, sf_dir, name):
    found = plan(fixture(spark, sf_dir, name))
    assert "NestedLoop" not in found and "Cartesian" not in found


@pytest.mark.parametrize("name", ["obs_fx", "radar_fx"])
def test_bands_are_not_broadcast(spark, sf_dir, name):
    """Nine rows for each pair, which Spark takes to be as small as the pairs' own table."""
    assert "Broadcast" not in plan(fixture(spark, sf_dir, name))


def test_facets_are_projected_once_a_batch(spark, sf_dir):
    found = plan(QUERIES["F28_plane_areas"](spark, sf_dir))
    assert "lambda" not in found and found.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["J12_sample_ties", "J8_geocode_points", "radar_samples", "speckle_from_offsets", "image_mosaic", "image_mosaic_nearest"])
def test_exploded_tables_are_not_broadcast(spark, sf_dir, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, sf_dir))


def test_valid_cells_beyond_the_box_count_as_neighbours():
    """A grid of 6 x 3 cells, of which the box has the first three rows: only the cell beside a hole whose places in the box aren't made up for is an edge."""
    valid = np.pad(np.ones((6, 3), bool), 1)
    inside = np.pad(np.ones((3, 3), bool), ((1, 4), (1, 1)))
    valid[3, 1] = False
    f = edge_distance(valid, inside, 2)
    # the box's second row lacks a cell; its last row and the one after it have more cells around than the box has there
    assert f[2, 1] == f[2, 2] == 0.25
    assert f[3, 2] == 0.5
    assert f[4, 1] == f[4, 2] == f[5, 2] == 1


def test_orbit_coverage_takes_the_first_and_the_last_vector(spark):
    scenes = spark.createDataFrame([(1, 50.0, 1000, 4, 500.0, [(119.0,), (110.0,)])], "scene_id long, start double, n_azimuth int, azimuth_looks int, prf double, states array<struct<t:double>>")
    assert [tuple(r) for r in orbit_coverage(scenes).collect()] == [(1, 69.0, -52.0)]


def test_each_pass_of_a_fit_reads_the_ties_once(spark):
    """A pass is a checkpoint, so passes before it aren't done again; pairs are solved in batches, not in a Python call each."""
    ties = spark.range(40).selectExpr("id % 2 AS pair_id", "(id - 20) / 200 AS theta_d", "(id % 7 - 3) / 5 AS x", "8.5e5D AS slant", "0.75D AS y")
    found = plan(calibrate.range_params(ties, "bpdbp"))
    assert "MapInPandas" not in found and "Join" not in found
    one = plan(fit.qr_fit(ties, ["pair_id"], F.col("y"), F.lit(1.0), [F.lit(1.0)]))
    assert "FlatMapGroups" not in one


def test_a_fit_makes_its_formulas_once(spark):
    """Rows without a number are dropped in the task: as a filter, Spark makes every formula a second time for it."""
    ties = spark.range(60).selectExpr("id % 2 AS pair_id", "CASE WHEN id < 58 THEN (id - 20) / 200 END AS theta_d", "CASE WHEN id = 57 THEN double('NaN') ELSE 2.0D END AS slope")
    found = fit.qr_fit(ties, ["pair_id"], F.col("slope") * F.sin("theta_d"), F.lit(1.0), [F.sin("theta_d")])
    assert not [line for line in plan(found).splitlines() if "Filter" in line and "SIN" in line.upper()]
    assert {r["pair_id"]: (r["n"], round(r["params"][0], 9)) for r in found.collect()} == {0: (29, 2.0), 1: (28, 2.0)}


def test_blocks_are_feathered_many_in_a_call(spark):
    """Small blocks and large, sparse ones, more than a plane holds, against each key by itself; a null is a key too."""
    rng = np.random.default_rng(5)
    boxes = {k: (k % 5 * 40, k % 5 * 40 + 12, 120, 134) for k in range(60)} | {k: (0, 128, 0, 128) for k in range(60, 420)}
    cells = {k: {(int(i), int(j)) for i, j in zip(rng.integers(b[0], b[1], 90), rng.integers(b[2], b[3], 90), strict=True)} if k < 60 else {(0, 0), (k % 128, 127)} for k, b in boxes.items()}
    rows = [(k or None, i, j, *boxes[k], f"{k} {i} {j}") for k in cells for i, j in cells[k]]
    made = feather(spark.createDataFrame(rows, "k long, i int, j int, i_min int, i_max int, j_min int, j_max int, name string"), ["k"], 3)
    assert "FlatMapGroups" not in plan(made)
    want = {}
    for k, own in cells.items():
        valid, inside = np.zeros((190, 150), bool), np.zeros((190, 150), bool)
        b = boxes[k]
        inside[b[0] + 4 : b[1] + 4, b[2] + 4 : b[3] + 4] = True
        at = np.array(sorted(own)) + 4
        valid[at[:, 0], at[:, 1]] = True
        f = edge_distance(valid, inside, 3)
        want |= {(k or None, i, j, f"{k} {i} {j}"): f[i + 4, j + 4] for i, j in own}
    got = made.collect()
    assert len(got) == len(want) and {(r["k"], r["i"], r["j"], r["name"]): r["f"] for r in got} == want


def test_geocoded_places_are_not_joined_again(spark, sf_dir):
    """The points' table stays small on disk for long, so that Spark would broadcast it whole."""
    assert "Broadcast" not in plan(QUERIES["J8_geocode_places"](spark, sf_dir))


@pytest.mark.parametrize("name", ["radar_samples", "speckle_from_offsets", "image_mosaic"])
def test_geometry_is_made_once(spark, sf_dir, name):
    found = plan(QUERIES[name](spark, sf_dir))
    assert found.count("orbit#") and len([line for line in found.splitlines() if "MapInArrow" in line and "heading" in line]) == 1
