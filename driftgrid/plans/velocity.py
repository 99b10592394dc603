"""Plans: whole mosaics and fits out of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.functions import geo, image, velocity
from driftgrid.functions.dates import date_weight
from driftgrid.functions.velocity import YEAR, optical_variance, optical_velocity
from driftgrid.operators import calibrate, geocode, images
from driftgrid.operators.blocks import sample_feathered
from driftgrid.operators.grid import cells_for_pairs, crossing_pairs, point_in_triangle, sorted_in
from driftgrid.operators.mosaic import clip_to_reference, feather, finish, mask_policy, merge_rounds, mosaic_sums, valid_sample, within_max_dt
from driftgrid.operators.sampling import attach_layers, sample_bilinear, sample_squares, sample_ties

BOX = ("i_min", "i_max", "j_min", "j_max")


def optical_observations(matches: DataFrame, cells: DataFrame, jd1: float, jd2: float, cell: float = 100.0, fl: int = 3, mask: DataFrame | None = None, origin: tuple[float, float] = (0.0, 0.0), south: bool = False, rot: float = 45.0, std_lat: int = 70) -> DataFrame:
    """Feathered velocities of matches on output cells of so many m, those well inside the window.

    matches has a row for each match with its node grid, fitted plane, its covariances cx, cy (flat 3 x 3) and errors; cells(match_id, i, j, dx, dy, sx, sy) are its
    nodes. Cells that the mask(i, j, code) marks as without solution are left out. origin is the place of cell (0, 0) on the projection in m. A pair is filtered by
    its date before any of its cells is read.
    """
    m = matches.withColumn("weight", date_weight(F.col("jd_early"), F.col("jd_late"), F.lit(jd1), F.lit(jd2))).where("weight > 0.05 and weight >= 0.5")
    bound = lambda o, d, n, s: (F.ceil(F.col(o) / cell).cast("int"), (F.floor((F.col(o) + (F.col(n) - 2) * F.col(d) * F.col(s)) / cell) + 1).cast("int"))
    (j0, j1), (i0, i1) = bound("x0", "dx", "nx", "step_x"), bound("y0", "dy", "ny", "step_y")
    m = m.withColumns({"i_min": F.greatest(i0, F.lit(0)), "i_max": i1, "j_min": F.greatest(j0, F.lit(0)), "j_max": j1})
    to_node = {f"{n}0": -F.col(f"{a}0") / (F.col(f"d{a}") * F.col(f"step_{a}")) for n, a in (("u", "x"), ("v", "y"))} | {f"d{n}": cell / (F.col(f"d{a}") * F.col(f"step_{a}")) for n, a in (("u", "x"), ("v", "y"))}
    boxes = m.select("match_id", *BOX, *[c.alias(n) for n, c in to_node.items()])
    gone = None if mask is None else mask.where("code = 5")
    offsets = sample_feathered(boxes, cells, ["match_id"], ["dx", "dy", "sx", "sy"], fl, gone).withColumnsRenamed({"dx": "ox", "dy": "oy", "sx": "px", "sy": "py"})
    rows = offsets.join(m, "match_id")
    middle = lambda a: F.col(f"{a}0") + 0.5 * F.col(f"n{a}") * F.col(f"step_{a}") * F.col(f"d{a}")
    ux, uy = F.col("j") * cell - middle("x"), F.col("i") * cell - middle("y")
    days = F.col("jd_late") - F.col("jd_early")
    lat = geo.xy_to_ll((origin[0] + F.col("j") * cell) / 1000, (origin[1] + F.col("i") * cell) / 1000, south, rot, std_lat)["lat"]
    rows = rows.withColumn("scale", geo.ps_scale(lat, std_lat))
    out = {}
    for a in ("x", "y"):
        plane = F.col(f"p{a}0") + F.col(f"p{a}1") * ux + F.col(f"p{a}2") * uy
        fit_variance = geo.quad_form(F.col(f"c{a}"), F.array(F.lit(1.0), ux, uy)) if f"c{a}" in matches.columns else F.lit(0.0)
        out[f"v{a}"] = optical_velocity(F.col(f"o{a}"), plane, F.col(f"d{a}"), days, F.col("scale"))
        out[f"s{a}"] = F.sqrt(optical_variance(F.col(f"p{a}"), F.col(f"sigma_{a}_res"), F.col(f"mean_sigma_{a}"), fit_variance, F.col(f"d{a}"), days))
    dt = 0.5 * (F.col("jd_early") + F.col("jd_late")) - 0.5 * (jd1 + jd2)
    return rows.select("match_id", "i", "j", *BOX, "weight", dt.alias("dt"), *[c.alias(n) for n, c in out.items()], "f")


def optical_mosaic(matches: DataFrame, cells: DataFrame, jd1: float, jd2: float, **options) -> DataFrame:
    """The optical round end to end: A1-A4 and P9 over optical_observations."""
    return within_max_dt(finish(mosaic_sums(optical_observations(matches, cells, jd1, jd2, **options))), jd1, jd2)


def _along(name: str) -> Column:
    """A baseline at the normalised azimuth."""
    return geo.baseline_poly(F.col(name), F.col(f"d{name}"), F.col(f"d{name}q"), F.col("x_az"))


def radar_samples(pairs: DataFrame, scenes: DataFrame, offsets: DataFrame, layers: dict[str, DataFrame], cell: float = 1000.0, origin: tuple[float, float] = (0.0, 0.0), south: bool = False, rot: float = 45.0, std_lat: float = 70.0) -> DataFrame:
    """The calibrated offsets of pairs on their output cells, with the geometry there.

    pairs has pair_id, scene_id, the box, n_days, weight, the offset grid (r0, a0, delta_r, delta_a), range_pixel and azimuth_pixel in m, theta_c, sigma_streaks, sigma_range and
    the range and azimuth parameters bn.. dbpq, const, c1, dbc, dbh, doffdx with covariances range_cov (36) and azimuth_cov (16). layers are cell tables: z, code and
    the slopes dzdx, dzdy. Cells off the image, or without offsets, have no row. Where pairs have dt, tide_rate or submergence, samples do too.
    """
    at = cells_for_pairs(pairs.select("pair_id", "scene_id", *BOX)).drop(*BOX)
    at = attach_layers(at, **layers).where("z is not null")
    p = geo.xy_to_ll((origin[0] + F.col("j") * cell) / 1000, (origin[1] + F.col("i") * cell) / 1000, south, rot, std_lat)
    own = [c for c in at.columns if c != "scene_id"]
    at = at.withColumn("p", p).select("scene_id", *own, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.col("z").alias("h"))
    # cells go along with all that they have, from here to the end: each join back would shuffle them again
    place = geocode.radar_geometry(at, scenes, [*own, "lat", "lon"]).where("range is not null and heading is not null").drop("scene_id")
    header = pairs.select("pair_id", "r0", "a0", "delta_r", "delta_a")
    place = place.join(sorted_in(header), "pair_id").select(*place.columns, ((F.col("range") - F.col("r0")) / F.col("delta_r")).alias("u"), ((F.col("azimuth") - F.col("a0")) / F.col("delta_a")).alias("v"))
    found = sample_squares(place, offsets, ["pair_id"], ["da", "dr", "sa", "sr"])
    # the pairs' covariances come last, with what is needed of their scenes, and aren't shuffled with the cells
    known = pairs.join(sorted_in(scenes.select("scene_id", "n_azimuth", "look_left")), "scene_id")
    rows = found.join(sorted_in(known), "pair_id")
    ground = geo.earth_radius(F.radians("lat")) * 1000 + F.col("z")
    rows = rows.withColumn("look", geo.look_geometry(F.col("slant"), ground, F.col("orbit"))).withColumns({"theta": F.col("look.theta"), "psi": F.col("look.psi")}).drop("look")
    rows = rows.withColumn("theta_d", F.col("theta") - F.col("theta_c")).withColumn("x_az", geo.norm_azimuth(F.col("azimuth"), F.col("n_azimuth")))
    rows = rows.withColumns({"bn_x": _along("bn"), "bp_x": _along("bp")})
    s, c, x = F.sin("theta_d"), F.cos("theta_d"), F.col("x_az")
    range_v = F.array(-s, -x * s, -x * c, -x * x * s, -x * x * c, F.lit(1.0))
    azimuth_v = F.array(F.lit(1.0), F.col("slant") * F.sin("theta"), -F.col("slant") * F.cos("theta"), x)
    dem = velocity.dem_error(F.col("bn_x"), F.col("slant"), F.col("theta"))
    sr = velocity.range_sigma(F.col("sr"), F.col("sigma_range"), F.col("range_pixel"))
    sa = velocity.azimuth_sigma(F.col("sa"), F.col("sigma_streaks"), F.col("azimuth_pixel"))
    made = {
        "dr": velocity.calibrate_range(F.col("dr"), F.col("range_pixel"), F.col("slant"), F.col("theta_d"), F.col("bn_x"), F.col("bp_x"), F.col("const")),
        "da": velocity.calibrate_azimuth(F.col("da"), F.col("azimuth_pixel"), F.col("look_left"), F.col("slant"), F.col("theta"), F.col("c1"), F.col("dbc"), F.col("dbh"), x * F.col("doffdx")),
        "sr": F.sqrt(sr * sr + dem * dem + geo.quad_form(F.col("range_cov"), range_v)),
        "sa": F.sqrt(sa * sa + geo.quad_form(F.col("azimuth_cov"), azimuth_v)),
        "xy": geo.xy_angle((origin[0] + F.col("j") * cell) / 1000, (origin[1] + F.col("i") * cell) / 1000, south),
    }
    more = [c for c in ("dt", "tide_rate", "submergence") if c in pairs.columns]
    return rows.select("pair_id", "i", "j", "lat", "lon", "z", "code", "dzdx", "dzdy", "psi", "theta", "heading", "n_days", "weight", *more, *[k.alias(n) for n, k in made.items()], *BOX)


def _corrected(samples: DataFrame) -> DataFrame:
    """Valid samples with the tide and the submergence taken out of dr; tide_rate and submergence are m a year, 0 where missing."""
    rate = lambda c: F.col(c) if c in samples.columns else F.lit(0.0)
    rows = mask_policy(valid_sample(samples))
    tide = velocity.tide_correction(F.col("code"), rate("tide_rate"), F.col("psi"), F.col("n_days"))
    sunk = -rate("submergence") * F.cos("psi") * F.col("n_days") / YEAR
    return rows.withColumns({"dr": F.col("dr") - tide - sunk, "sr": velocity.tide_sigma(F.col("code"), F.col("sr"), F.col("psi"))})


def speckle_solutions(samples: DataFrame, mode: str = "default", phase_too: bool = False) -> DataFrame:
    """velocities on the grid, with their errors, of samples(pair_id, i, j, dr, da, sr, sa, psi, heading, xy, z, dzdx, dzdy, code, n_days, ...)."""
    rows = _corrected(samples)
    slopes = geo.slope_limits(F.col("dzdx"), F.col("dzdy"), F.col("z"))
    rows = rows.withColumn("g", slopes).withColumn("s", geo.rotate_xy_to_ra(F.col("g.dzdx"), F.col("g.dzdy"), F.col("xy"), F.col("heading")))
    v = velocity.radar_velocity(F.col("dr"), F.col("da"), F.col("psi"), F.col("n_days"), F.col("s.r"), F.col("s.a"), F.col("code"))
    rows = rows.withColumn("ra", v).withColumn("v", geo.rotate_ra_to_xy(F.col("ra.vr"), F.col("ra.va"), F.col("xy"), F.col("heading")))
    er = F.col("sr") * YEAR / F.col("n_days") / F.sin("psi")
    rows = rows.withColumn("e", geo.errors_to_xy(er, velocity.azimuth_error(F.col("sa"), F.col("n_days"), F.lit(phase_too)), F.col("xy"), F.col("heading")))
    vz = velocity.vertical_velocity(mode, F.col("v.x"), F.col("v.y"), F.col("g.dzdx"), F.col("g.dzdy"), F.col("dr"), F.col("psi"), F.col("n_days"))
    out = [F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), F.sqrt("e.x").alias("sx"), F.sqrt("e.y").alias("sy"), vz.alias("vz")]
    return rows.select("pair_id", "i", "j", *BOX, "weight", *[c for c in ("dt",) if c in samples.columns], *out)


def speckle_sums(samples: DataFrame, fl: int = 3, reference: DataFrame | None = None, threshold: float = 200.0, **options) -> DataFrame:
    """The sums of the speckle round; observations far from a reference map(i, j, vx, vy) are left out where either is slow."""
    obs = speckle_solutions(samples, **options)
    if reference is not None:
        obs = clip_to_reference(obs, reference, threshold)
    return mosaic_sums(feather(obs, ["pair_id"], fl))


def pairs_in_window(pairs: DataFrame, jd1: float, jd2: float, overlap: bool = True) -> DataFrame:
    """pairs(jd1, n_days, weight) that share time with the window, their weights times that share, or with overlap False those within it; dt is from the window's middle."""
    share = date_weight(F.col("jd1"), F.col("jd1") + F.col("n_days"), F.lit(jd1), F.lit(jd2))
    kept = pairs.withColumn("_share", share).where("_share > 0" if overlap else "_share > 0.99999")
    return kept.withColumns({"weight": F.col("weight") * F.col("_share"), "dt": F.col("jd1") + F.col("n_days") / 2 - 0.5 * (jd1 + jd2)}).drop("_share")


def speckle_round(pairs: DataFrame, scenes: DataFrame, offsets: DataFrame, layers: dict[str, DataFrame], jd1: float, jd2: float, overlap: bool = True, fl: int = 3, **grid) -> DataFrame:
    """P1, then the sums of the speckle round from raw offsets: inputs as for radar_samples, pairs with jd1 too. Pairs out of the window go before a cell is made."""
    return speckle_sums(radar_samples(pairs_in_window(pairs, jd1, jd2, overlap), scenes, offsets, layers, **grid), fl)


def speckle_mosaic(samples: DataFrame, **options) -> DataFrame:
    """The speckle round by itself."""
    return finish(speckle_sums(samples, **options))


def crossing_solutions(samples: DataFrame, pairs: DataFrame, days: float = 12.0, any_pass: bool = False) -> DataFrame:
    """Velocities of two pairs that cross, on the cells that both have; vz from the slopes.

    samples as for the speckle round (range only); pairs as for crossing_pairs. The two samples of a cell meet through equi-joins on pair and cell.
    """
    rows = _corrected(samples).withColumn("p", F.col("dr") * YEAR / F.col("n_days") / F.sin("psi")).withColumn("e", F.col("sr") * YEAR / F.col("n_days") / F.sin("psi"))
    both = crossing_pairs(pairs, days, any_pass=any_pass).select("a_pair_id", "b_pair_id", F.col("weight").alias("pair_weight"), *BOX)
    side = lambda s, *more: rows.select(F.col("pair_id").alias(f"{s}_pair_id"), "i", "j", *more, *[F.col(c).alias(f"{s}_{c}") for c in ("p", "e", "psi", "heading", *(["dt"] if "dt" in samples.columns else []))])
    met = side("a", "xy", "z", "dzdx", "dzdy").join(both, "a_pair_id").join(side("b"), ["b_pair_id", "i", "j"])
    met = met.where("i >= i_min and i < i_max and j >= j_min and j < j_max")
    met = met.withColumn("m", velocity.crossing_matrix(F.col("a_heading") - F.col("b_heading"), F.col("xy") - F.col("a_heading"))).where("m is not null")
    met = met.withColumn("g", geo.slope_limits(F.col("dzdx"), F.col("dzdy"), F.col("z"), most=0.1, low_ground=False))
    v = velocity.crossing_velocity(F.col("m"), F.col("g.dzdx"), F.col("g.dzdy"), F.col("a_psi"), F.col("b_psi"), F.col("a_p"), F.col("b_p"), F.col("a_e"), F.col("b_e"))
    met = met.withColumn("v", v).where("v is not null")
    dt = [(0.5 * (F.col("a_dt") + F.col("b_dt"))).alias("dt")] if "dt" in samples.columns else []
    return met.select("a_pair_id", "b_pair_id", "i", "j", *BOX, F.col("pair_weight").alias("weight"), "v.vx", "v.vy", F.sqrt("v.ex").alias("sx"), F.sqrt("v.ey").alias("sy"), (F.col("v.vx") * F.col("g.dzdx") + F.col("v.vy") * F.col("g.dzdy")).alias("vz"), *dt)


def crossing_sums(samples: DataFrame, pairs: DataFrame, fl: int = 3, **options) -> DataFrame:
    """The sums of the crossing round."""
    return mosaic_sums(feather(crossing_solutions(samples, pairs, **options), ["a_pair_id", "b_pair_id"], fl))


def crossing_mosaic(samples: DataFrame, pairs: DataFrame, **options) -> DataFrame:
    """The crossing round of offsets by itself."""
    return finish(crossing_sums(samples, pairs, **options))


def phase_samples(samples: DataFrame) -> DataFrame:
    """F16: samples of unwrapped phase with a range displacement dr in m and its error sr, for the crossing and mixed rounds.

    samples has phase, slant, z, radius, orbit, flat_orbit, theta_c, flat_theta_c, bn, bp, two_k and, with a fitted baseline, baseline_variance and residual.
    """
    c = F.col
    rest = c("phase") - velocity.topo_phase(c("slant"), c("z"), c("radius"), c("orbit"), c("flat_orbit"), c("theta_c"), c("flat_theta_c"), c("bn"), c("bp"), c("two_k"))
    angle = F.acos((c("slant") * c("slant") + c("orbit") * c("orbit") - F.pow(c("radius") + c("z"), 2)) / (2 * c("orbit") * c("slant")))
    fitted = "baseline_variance" in samples.columns
    error = velocity.phase_error(c("baseline_variance"), c("residual")) if fitted else velocity.phase_error_dem(c("bn"), c("slant"), angle, c("two_k"))
    return samples.where("phase > -2e7").withColumns({"dr": rest / c("two_k"), "sr": error / c("two_k")})


def phase_azimuth_sums(samples: DataFrame, fl: int = 3, **options) -> DataFrame:
    """The sums of the mixed round: range from unwrapped phase, azimuth from offsets.

    samples has what phase_samples needs beside da, sa and the geometry of the speckle round. A sample without phase, or off by more than
    2e7, takes no part; the error of the phase goes through the same propagation as that of offsets.
    """
    return speckle_sums(phase_samples(samples), fl, **options)


def irregular_sums(triangles: DataFrame, box: tuple[int, int, int, int], fl: int = 3, sigma: float = 200.0, max_edge: float = 15.0, max_area: float = 75.0) -> DataFrame:
    """The sums of the irregular round: planes through the good triangles(set_id, tri_id, x1, y1, vx1, vy1, x2 ...), in cells.

    A cell on the edge of several triangles of a set takes the first one. Velocities have one error, sigma, and take part in feathering and sums as
    all others do. box is the grid's.
    """
    cells = point_in_triangle(triangles, max_edge, max_area).where(f"i >= {box[0]} and i < {box[1]} and j >= {box[2]} and j < {box[3]}")
    one = cells.groupBy("set_id", "i", "j").agg(F.min_by(F.struct("vx", "vy"), "tri_id").alias("v")).select("set_id", "i", "j", "v.*")
    obs = one.withColumns({n: F.lit(b) for n, b in zip(BOX, box, strict=True)} | {"sx": F.lit(sigma), "sy": F.lit(sigma)})
    return mosaic_sums(feather(obs, ["set_id"], fl))


def velocity_mosaic(rounds: list[DataFrame], fl: int, box: tuple[int, int, int, int], seed: DataFrame | None = None) -> DataFrame:
    """The fold. rounds are sums in the order optical, crossing phase, crossing offsets, phase with azimuth offsets, speckle, irregular."""
    return finish(merge_rounds(rounds, fl, box, seed))


def image_samples(scenes: DataFrame, pixels: DataFrame, layers: dict[str, DataFrame], sensor: str, cell: float = 1000.0, origin: tuple[float, float] = (0.0, 0.0), south: bool = False, rot: float = 45.0, std_lat: float = 70.0, beta_nought: float = 220.0, fl: int = 0) -> DataFrame:
    """Calibrated image values of scenes on output cells.

    scenes has scene_id as image_id's column too, the box, image_date, pass_type and weight, and what the kernels need; pixels(scene_id, i, j, power) are the images by
    azimuth i and range j; layers are cell tables with z.
    """
    at = attach_layers(cells_for_pairs(scenes.select("scene_id", *BOX)), **layers).where("z is not null")
    p = geo.xy_to_ll((origin[0] + F.col("j") * cell) / 1000, (origin[1] + F.col("i") * cell) / 1000, south, rot, std_lat)
    at = at.withColumn("p", p).select("scene_id", "i", "j", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.col("z").alias("h"))
    place = geocode.radar_geometry(at, scenes.drop(*BOX), ["i", "j"]).where("range is not null")
    points = place.select("scene_id", F.col("i").alias("pi"), F.col("j").alias("pj"), "slant", "orbit", F.col("range").alias("u"), F.col("azimuth").alias("v"))  # with the geometry, or it would be made twice
    power = sample_bilinear(points, pixels, ["scene_id", "pi", "pj", "slant", "orbit"], ["power"], ["scene_id"]).dropna().select("scene_id", F.col("pi").alias("i"), F.col("pj").alias("j"), "slant", "orbit", "power")
    rows = power.join(sorted_in(at), ["scene_id", "i", "j"]).join(sorted_in(scenes.select("scene_id", *BOX, "image_date", "pass_type", "weight")), "scene_id")
    look = geo.look_geometry(F.col("slant"), geo.earth_radius(F.radians("lat")) * 1000 + F.col("h"), F.col("orbit"))
    rows = rows.withColumn("look", look)
    value = image.sensor_calibration(F.col("power"), F.lit(sensor), F.degrees("look.theta"), F.col("look.psi"), F.lit(beta_nought), F.lit(1.0))
    rows = rows.withColumn("value", value).where("value > 0").select(F.col("scene_id").alias("image_id"), "i", "j", *BOX, "value", "weight", "image_date", "pass_type", F.degrees("look.psi").alias("incidence"))
    return feather(rows, ["image_id"], fl)


def image_mosaic(samples: DataFrame, how: str = "average", date: str | None = None, preferred: int = 1, heights: DataFrame | None = None, z_threshold: int = 0) -> DataFrame:
    """An image mosaic of image_samples by average, nearest_date, orbit_priority or hybrid, with sigma nought in dB."""
    made = {
        "average": lambda: images.image_mosaic_average(samples),
        "nearest_date": lambda: images.nearest_date_mosaic(samples, date),
        "orbit_priority": lambda: images.orbit_priority_mosaic(samples, preferred),
        "hybrid": lambda: images.hybrid_mosaic(samples, heights, z_threshold, date),
    }[how]()
    return made.select("i", "j", "value", image.to_db(F.col("value")).alias("sigma0"))


def calibration_ties(ties: DataFrame, pairs: DataFrame, scenes: DataFrame, offsets: DataFrame, south: bool = False) -> DataFrame:
    """ties(pair_id, tie_id, lat, lon, z, vx, vy, vz, weight, code, x, y) as measures of the fits: pair_id, tie_id, theta_d, theta, x, slant, weight, y.

    pairs has pair_id, scene_id, n_days, the offset grid, range_pixel, theta_c and tide_difference. Ties off the image or without offsets take no part.
    """
    keys = ["pair_id", "tie_id"]
    at = ties.join(pairs.select("pair_id", "scene_id"), "pair_id").select(*keys, "scene_id", "lat", "lon", F.col("z").alias("h"))
    place = geocode.radar_geometry(at, scenes, keys).where("range is not null and heading is not null").drop("scene_id")
    found = sample_ties(place.select(*keys, F.col("range").alias("r"), F.col("azimuth").alias("a")), pairs.select("pair_id", "r0", "a0", "delta_r", "delta_a"), offsets, ["dr"]).dropna().select(*keys, "dr")
    own = pairs.select("pair_id", "scene_id", "n_days", "range_pixel", "theta_c", "tide_difference")
    rows = ties.join(sorted_in(place), keys).join(sorted_in(found), keys).join(sorted_in(own), "pair_id").join(sorted_in(scenes.select("scene_id", "n_azimuth")), "scene_id")
    look = geo.look_geometry(F.col("slant"), geo.earth_radius(F.radians("lat")) * 1000 + F.col("z"), F.col("orbit"))
    rows = rows.withColumn("look", look).withColumn("vz", velocity.tie_tide(F.col("code"), F.col("vz"), F.col("tide_difference"), F.col("n_days")))
    rows = rows.withColumn("ra", geo.rotate_xy_to_ra(F.col("vx"), F.col("vy"), geo.xy_angle(F.col("x"), F.col("y"), south), F.col("heading")))
    y = velocity.motion_correction(F.col("dr") * F.col("range_pixel"), "range", F.col("ra.r"), F.col("ra.a"), F.col("vz"), F.col("look.psi"), F.col("n_days"))
    return rows.select(*keys, (F.col("look.theta") - F.col("theta_c")).alias("theta_d"), F.col("look.theta").alias("theta"), geo.norm_azimuth(F.col("azimuth"), F.col("n_azimuth")).alias("x"), "slant", "weight", y.alias("y"))


def calibration_fit(ties: DataFrame, pairs: DataFrame, scenes: DataFrame, offsets: DataFrame, variant: str = "linear", south: bool = False, passes: int = 3) -> DataFrame:
    """Range parameters of all pairs at once from calibration_ties, each fit starting from the baseline that pairs have (bn .. dbpq, const), which also
    holds for what isn't solved for; then K5 with n_given. The geocoded ties are written as a checkpoint, because each pass reads them."""
    measured = calibration_ties(ties, pairs, scenes, offsets, south).checkpoint()
    known = pairs.select("pair_id", *[c for c in (*calibrate.BASELINE, "const") if c in pairs.columns])
    given = ties.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_given"))
    return calibrate.range_params(measured, variant, known, passes).join(given, "pair_id")


def speckle_observations(samples: DataFrame) -> DataFrame:
    """F13-F15, F17, F18 for a table of calibrated samples: velocities along range and azimuth with their errors.

    samples has dr, da, sr, sa in m, psi, n_days, dzdr, dzda, code and tide_rate.
    """
    fixed = samples.withColumn("dr", F.col("dr") - velocity.tide_correction(F.col("code"), F.col("tide_rate"), F.col("psi"), F.col("n_days"))).withColumn("sr", velocity.tide_sigma(F.col("code"), F.col("sr"), F.col("psi")))
    v = velocity.radar_velocity(*[F.col(c) for c in ("dr", "da", "psi", "n_days", "dzdr", "dzda", "code")])
    return fixed.withColumn("v", v).select("*", "v.*", (F.col("sr") * YEAR / F.col("n_days") / F.sin("psi")).alias("er"), velocity.azimuth_error(F.col("sa"), F.col("n_days"), F.lit(False)).alias("ea")).drop("v")
