"""A12-A14 as iterations: each pass makes the measure anew from the baseline that the pass before has found.

The way difference of two orbits is sqrt(r^2 - 2 r (bn sin + bp cos) + bn^2 + bp^2) - r, which isn't linear in the baseline. A pass takes what
isn't linear out of the measure, with the state (the baseline of each pair so far), and all terms that aren't solved for, with their
known values; then one least-squares fit per pair gives the next state. The state has a row for each pair and is written as a checkpoint after
each pass: a pass names it twice, and would else do all passes before it twice. Ties meet it sorted by pair, so that those of a pair are
decomposed together (fit.qr_fit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fit import AZIMUTH_SCALE, PHASE_VARIANTS, RANGE_VARIANTS, azimuth_basis, baseline_terms, place_covariance, qr_fit
from .grid import sorted_in

BASELINE = ("bn", "bp", "dbn", "dbp", "dbnq", "dbpq")
#: Fewest ties by variant, where more are wanted than terms are solved for.
RANGE_LEAST = {"const": 2, "sv_const": 2}
#: The terms by variant and their places in the covariance of c1, dbc, dbh, doffdx.
AZIMUTH_VARIANTS = {"const": (["c1"], [0]), "linear": (["c1", "doffdx"], [0, 3]), "baseline_const": (["c1", "dbc"], [0, 1]), "baseline_linear": (["c1", "dbc", "doffdx"], [0, 1, 3])}


def _column(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def _started(ties: DataFrame, known: DataFrame | None, names: tuple[str, ...], sigma: float) -> tuple[DataFrame, DataFrame]:
    """Ties that are measures; the first state: their mean weight, known values (0 where there are none) and sigma."""
    good = ties.where("abs(y) < 1e6")  # others are no measures
    start = good.groupBy("pair_id").agg((F.sum(_column(ties, "weight", 1.0)) / F.count(F.lit(1))).alias("mean_weight"))
    if known is not None:
        start = start.join(known, "pair_id", "left")
    first = [_column(start, n, 0.0) for n in names]
    return good, start.select("pair_id", "mean_weight", *[c.alias(f"k_{n}") for c, n in zip(first, names, strict=True)], *[c.alias(f"s_{n}") for c, n in zip(first, names, strict=True)], F.lit(sigma).alias("s_sigma")).checkpoint()


def _pass(rows: DataFrame, state: DataFrame, names: tuple[str, ...], solved: list[str], y: Column, e: Column, basis: list[Column], least: int, scale: dict[str, float]) -> DataFrame:
    """One fit for each pair: state with the terms solved for, the spread of e as the next sigma, cov (of the terms solved for) and n."""
    state = state.drop("cov", "n")
    rel = F.greatest(_column(rows, "weight", 1.0) / F.col("mean_weight"), F.lit(0.1))
    fitted = qr_fit(rows.join(sorted_in(state), "pair_id"), ["pair_id"], y, rel, basis, least, e)
    both = state.join(fitted.select("pair_id", "params", F.col("cov").alias("unit_cov"), "spread", "n"), "pair_id")
    value = {n: F.get("params", F.lit(solved.index(n))) * scale.get(n, 1.0) if n in solved else F.col(f"k_{n}") for n in names}
    made = [value[n].alias(f"s_{n}") for n in names]
    # in a step of its own, so that it's the sigma that this pass began with
    both = both.withColumn("cov", F.transform("unit_cov", lambda c: c * F.col("s_sigma") * F.col("s_sigma")))
    return both.select("pair_id", "mean_weight", *[f"k_{n}" for n in names], *made, F.col("spread").alias("s_sigma"), "cov", "n").checkpoint()


def _result(state: DataFrame, names: tuple[str, ...], places: list[int], size: int, scale: list[float] | None = None) -> DataFrame:
    cov = place_covariance(F.col("cov"), places, size, scale).alias("cov")
    return state.select("pair_id", *[F.col(f"s_{n}").alias(n) for n in names], cov, F.col("s_sigma").alias("sigma_res"), "n")


def _along(x: Column, prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}") + F.col(f"{prefix}d{name}") * x + F.col(f"{prefix}d{name}q") * x * x


def range_params(ties: DataFrame, variant: str = "linear", known: DataFrame | None = None, passes: int = 3) -> DataFrame:
    """Per pair_id bn, bp, dbn, dbp, dbnq, dbpq and const, the covariance of all (flat 6 x 6), sigma_res and n.

    ties(pair_id, theta_d, x, slant, y, weight = 1) has way differences y in m; the "sv" variants correct a baseline from state vectors, which
    each tie has in bn_s and bp_s. known(pair_id, any of bn .. const) has what the fit starts from, and the values of terms not solved for.
    sigma_res is the spread of what the exact model leaves at the start of the last pass. Pairs with too few ties have no row.
    """
    solved, places = RANGE_VARIANTS[variant]
    names = (*BASELINE, "const")
    rows, state = _started(ties, known, names, 1.0)
    sv = variant.startswith("sv_")
    if sv:  # a correction starts from nothing
        state = state.withColumns({f"{p}_{n}": F.lit(0.0) for p in "ks" for n in BASELINE})
    x, r = F.col("x"), F.col("slant")
    s, c = F.sin("theta_d"), F.cos("theta_d")
    own = (_column(ties, "bn_s", 0.0), _column(ties, "bp_s", 0.0)) if sv else (F.lit(0.0), F.lit(0.0))
    bn, bp = _along(x, "s_", "bn") + own[0], _along(x, "s_", "bp") + own[1]
    square = bn * bn + bp * bp
    delta = -bn * s - bp * c + square / (2 * r)
    bent = (square - delta * delta) / (2 * r)
    terms = baseline_terms(F.col("theta_d"), x)
    fixed = sum((F.col(f"k_{n}") * terms[n] for n in names if n not in solved), -s * own[0] - c * own[1])
    e = F.col("y") - (F.sqrt(r * r - 2 * r * (bn * s + bp * c) + square) - r + F.col("s_const"))
    for _ in range(passes):
        state = _pass(rows, state, names, solved, F.col("y") - bent - fixed, e, [terms[n] for n in solved], max(len(solved), RANGE_LEAST.get(variant, 1)), {})
    return _result(state, names, places, 6)


def phase_baseline(ties: DataFrame, variant: str = "dbp", known: DataFrame | None = None, passes: int = 3) -> DataFrame:
    """Per pair_id the baseline and the ramp from unwrapped phases, with the covariance (flat 6 x 6), sigma_res and n; four ties at least.

    ties(pair_id, theta_d, x, slant, two_k, y) has phases y; delta, if there, is the way difference that flattening took, from which the first
    estimate of each pass goes on. All errors count alike. known as for range_params. The ramp is in m along the normalised azimuth.
    """
    solved, places = PHASE_VARIANTS[variant]
    solved = ["ramp" if n == "cos_ramp" else n for n in solved]
    names = (*BASELINE, "ramp")
    rows, state = _started(ties.drop("weight"), known, names, 10.0)
    x, r, k = F.col("x"), F.col("slant"), F.col("two_k")
    s, c = F.sin("theta_d"), F.cos("theta_d")
    bn, bp = _along(x, "s_", "bn"), _along(x, "s_", "bp")
    square = bn * bn + bp * bp
    near = -bn * s - bp * c + square / (2 * r)
    first = near - F.pow(_column(ties, "delta", 0.0) if "delta" in ties.columns else near, 2) / (2 * r)
    delta = near - first * first / (2 * r)
    terms = baseline_terms(F.col("theta_d"), x, k)
    terms["ramp"] = terms["cos_ramp"] if variant == "no_ramp" else terms["ramp"]
    y = F.col("y") - k * (square - delta * delta) / (2 * r)
    linear = sum((F.col(f"s_{n}") * terms[n] for n in names), F.lit(0.0))
    fixed = sum((F.col(f"k_{n}") * terms[n] for n in names if n not in solved), F.lit(0.0))
    for _ in range(passes):
        state = _pass(rows, state, names, solved, y - fixed, y - linear, [terms[n] for n in solved], max(4, len(solved)), {})
    return _result(state, names, places, 6)


def azimuth_params(ties: DataFrame, variant: str = "baseline_linear", known: DataFrame | None = None, passes: int = 3) -> DataFrame:
    """Per pair_id c1, dbc, dbh and doffdx with their covariance (flat 4 x 4), sigma_res and n.

    ties(pair_id, slant, theta, x, y, weight = 1) has offsets y along track in m; sv_offset, if there, is the surface of the orbits' own offsets,
    which is taken out. known(pair_id, dbc, dbh) has the rates of the baseline: dbh is never solved for, dbc in the "baseline" variants.
    """
    solved, places = AZIMUTH_VARIANTS[variant]
    names = ("c1", "dbc", "dbh", "doffdx")
    rows, state = _started(ties, known, names, 10.0)
    r, theta = F.col("slant"), F.col("theta")
    across = r * F.sin(theta)
    basis = azimuth_basis(variant, F.col("x"), across)
    scaled = AZIMUTH_SCALE if variant.startswith("baseline") else 1.0
    basis = basis if scaled != 1.0 else [b / AZIMUTH_SCALE for b in basis]
    scale = {"c1": scaled, "doffdx": scaled}
    y = F.col("y") + r * F.cos(theta) * F.col("k_dbh") - _column(ties, "sv_offset", 0.0)
    y = y if "dbc" in solved else y - across * F.col("k_dbc")
    e = y - F.col("s_c1") - F.col("s_doffdx") * F.col("x") - (across * F.col("s_dbc") if "dbc" in solved else F.lit(0.0))
    for _ in range(passes):
        state = _pass(rows, state, names, solved, y, e, basis, len(solved), scale)
    return _result(state, names, places, 4, [scale.get(n, 1.0) for n in solved])
