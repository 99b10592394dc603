"""The iterated fits against plain loops over the ties of one pair, with curved measures, noise and weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import calibrate, fit
from driftgrid.sources import sinks, text

NAMES = ("bn", "bp", "dbn", "dbp", "dbnq", "dbpq")


def ties_of(seed, n=300, noise=0.01):
    r = np.random.default_rng(seed)
    t = {"theta_d": r.uniform(-0.05, 0.05, n), "x": r.uniform(-0.5, 0.5, n), "slant": r.uniform(8.3e5, 8.7e5, n), "weight": r.choice([1.0, 10.0], n)}
    t["bn_s"], t["bp_s"] = 150 + 20 * t["x"], 60 - 5 * t["x"]
    t["noise"] = r.normal(0, noise, n)
    return t


def way(t, bn, bp):
    r = t["slant"]
    return np.sqrt(r * r - 2 * r * (bn * np.sin(t["theta_d"]) + bp * np.cos(t["theta_d"])) + bn * bn + bp * bp) - r


def poly(v, n, x):
    return v[n] + v["d" + n] * x + v["d" + n + "q"] * x * x


def columns(t, two_k=None):
    s, c, x = np.sin(t["theta_d"]), np.cos(t["theta_d"]), t["x"]
    k = 1.0 if two_k is None else two_k
    return {"bn": -k * s, "bp": -k * c, "dbn": -k * x * s, "dbp": -k * x * c, "dbnq": -k * x * x * s, "dbpq": -k * x * x * c, "const": np.ones_like(x), "ramp": k * x, "cos_ramp": k * x * c}


def solved_for(y, sigma, basis):
    a = np.stack(basis, axis=1) / sigma[:, None]
    p = np.linalg.lstsq(a, y / sigma, rcond=None)[0]
    return p, np.linalg.inv(a.T @ a)


def sigmas(spread, w):
    return np.maximum(spread * w * len(w) / w.sum(), 0.1 * spread)


@pytest.fixture(scope="module")
def known(spark):
    return {"bn": 180.0, "bp": 45.0, "dbn": 4.0, "dbp": 2.5, "dbnq": 0.0, "dbpq": 0.0, "const": 0.2}


def frame(spark, t, y, known, **more):
    cols = [*t, "y", *more]
    arrays = [*t.values(), y, *more.values()]
    rows = [(p, *map(float, r)) for p in (1, 2) for r in zip(*arrays)] + [(3, *[float(a[0]) for a in arrays])]
    ties = spark.createDataFrame(rows, ["pair_id", *cols]).repartition(5)
    start = spark.createDataFrame([(p, *known.values()) for p in (1, 2, 3)], ["pair_id", *known])
    return ties, start


@pytest.mark.parametrize("variant", list(fit.RANGE_VARIANTS))
def test_range_params(spark, known, variant):
    t = ties_of(1)
    terms, places = fit.RANGE_VARIANTS[variant]
    sv = variant.startswith("sv_")
    truth = {**known, "bn": 200.0, "dbn": -3.0, "dbp": 3.5, "const": 0.75} if not sv else {**dict.fromkeys(NAMES, 0.0), "bp": 1.5, "const": known["const"]}
    if variant == "quad":
        truth |= {"dbnq": 2.0, "dbpq": -1.0}
    if variant == "sv_quad":
        truth |= {"bn": 3.0, "dbn": -2.0, "dbp": 1.0, "dbnq": 0.5, "dbpq": 0.25}
    start = dict(known) if not sv else {**dict.fromkeys(NAMES, 0.0), "const": known["const"]}
    for n in truth:  # what isn't solved for is as known
        truth[n] = truth[n] if n in terms else start[n]
    add = (t["bn_s"], t["bp_s"]) if sv else (0.0, 0.0)
    y = way(t, poly(truth, "bn", t["x"]) + add[0], poly(truth, "bp", t["x"]) + add[1]) + truth["const"] + t["noise"]
    c, w, state, spread = columns(t), t["weight"], dict(start), 1.0
    for _ in range(3):
        bn, bp = poly(state, "bn", t["x"]) + add[0], poly(state, "bp", t["x"]) + add[1]
        b2 = bn**2 + bp**2
        d0 = -bn * np.sin(t["theta_d"]) - bp * np.cos(t["theta_d"]) + b2 / (2 * t["slant"])
        rest = y - b2 / (2 * t["slant"]) + d0**2 / (2 * t["slant"]) - sum(start[n] * c[n] for n in start if n not in terms) - c["bn"] * add[0] - c["bp"] * add[1]
        sigma = sigmas(spread, w)
        spread = (y - way(t, bn, bp) - state["const"]).std()
        p, cov = solved_for(rest, sigma, [c[n] for n in terms])
        state |= dict(zip(terms, p))
    ties, begun = frame(spark, t, y, known)
    got = {r.pair_id: r for r in calibrate.range_params(ties, variant, begun).collect()}
    assert set(got) == {1, 2}
    full = np.zeros((6, 6))
    full[np.ix_(places, places)] = cov
    for r in got.values():
        assert r.n == 300 and r.sigma_res == pytest.approx(spread, rel=1e-6)
        assert [r[n] for n in state] == pytest.approx(list(state.values()), rel=1e-6, abs=1e-6)
        assert np.array(r["cov"]).reshape(6, 6) == pytest.approx(full, rel=1e-5)
    if terms != ["const"]:
        clean = y - t["noise"]
        r = calibrate.range_params(frame(spark, t, clean, known)[0], variant, begun).first()
        assert [r[n] for n in truth] == pytest.approx(list(truth.values()), abs=1e-3)


@pytest.mark.parametrize("variant", list(fit.PHASE_VARIANTS))
def test_phase_baseline(spark, variant):
    t = ties_of(2, noise=0.05)
    two_k = 222.0
    terms, places = fit.PHASE_VARIANTS[variant]
    start = {"bn": 190.0, "bp": 45.0, "dbn": 4.0, "dbp": 2.5, "dbnq": 0.3, "dbpq": -0.2}
    truth = {n: start[n] + (7.0 if n in terms else 0.0) for n in start}
    c = columns(t, two_k)
    ramp = next((n for n in terms if "ramp" in n), "ramp")
    shift = 0.6 if "ramp" in variant else 0.0
    y = two_k * way(t, poly(truth, "bn", t["x"]), poly(truth, "bp", t["x"])) + shift * c[ramp] + t["noise"]
    state, spread = {**start, ramp: 0.0}, 10.0
    for _ in range(3):
        bn, bp = poly(state, "bn", t["x"]), poly(state, "bp", t["x"])
        b2, r = bn**2 + bp**2, t["slant"]
        near = -bn * np.sin(t["theta_d"]) - bp * np.cos(t["theta_d"]) + b2 / (2 * r)
        d = near - (near - near**2 / (2 * r)) ** 2 / (2 * r)
        rest = y - two_k * b2 / (2 * r) + d**2 * two_k / (2 * r)
        left = rest - sum(state[n] * c[n] for n in state)
        p, cov = solved_for(rest - sum(start[n] * c[n] for n in start if n not in terms), np.full(len(y), spread), [c[n] for n in terms])
        spread, state = left.std(), state | dict(zip(terms, p))
    ties, begun = frame(spark, t, y, start, two_k=np.full(len(y), two_k))
    got = calibrate.phase_baseline(ties, variant, begun).where("pair_id = 1").first()
    assert [got[n] for n in NAMES] == pytest.approx([state[n] for n in NAMES], rel=1e-6, abs=1e-6)
    assert got.ramp == pytest.approx(state[ramp], abs=1e-6) and got.sigma_res == pytest.approx(spread, rel=1e-5)
    full = np.zeros((6, 6))
    full[np.ix_(places, places)] = cov
    assert np.array(got["cov"]).reshape(6, 6) == pytest.approx(full, rel=1e-4)
    clean = frame(spark, t, y - t["noise"], start, two_k=np.full(len(y), two_k))[0]
    r = calibrate.phase_baseline(clean, variant, begun, passes=4).first()
    assert [r[n] for n in NAMES] == pytest.approx(list(truth.values()), abs=1e-3)


@pytest.mark.parametrize("variant", list(calibrate.AZIMUTH_VARIANTS))
def test_azimuth_params(spark, variant):
    t = ties_of(3)
    t["theta"] = 0.6 + t["theta_d"]
    terms, places = calibrate.AZIMUTH_VARIANTS[variant]
    known = {"dbc": 2e-5, "dbh": -1e-5}
    truth = {"c1": 3.0, "dbc": 5e-5 if "dbc" in terms else 2e-5, "dbh": -1e-5, "doffdx": 0.4 if "doffdx" in terms else 0.0}
    across, sv = t["slant"] * np.sin(t["theta"]), 0.1 * t["x"]
    y = truth["c1"] + across * truth["dbc"] - t["slant"] * np.cos(t["theta"]) * truth["dbh"] + truth["doffdx"] * t["x"] + sv + t["noise"]
    basis = {"c1": np.ones_like(y), "dbc": across, "doffdx": t["x"]}
    rest = y + t["slant"] * np.cos(t["theta"]) * known["dbh"] - sv - (0 if "dbc" in terms else across * known["dbc"])
    p, _ = solved_for(rest, sigmas(1.0, t["weight"]), [basis[n] for n in terms])
    spread = (rest - sum(a * basis[n] for a, n in zip(p, terms))).std()
    _, cov = solved_for(rest, sigmas(spread, t["weight"]), [basis[n] for n in terms])
    ties, begun = frame(spark, t, y, known, sv_offset=sv)
    got = calibrate.azimuth_params(ties, variant, begun).where("pair_id = 2").first()
    want = {"c1": 0.0, "doffdx": 0.0, **known, **dict(zip(terms, p))}
    assert [got[n] for n in want] == pytest.approx(list(want.values()), rel=1e-6, abs=1e-9)
    assert got.sigma_res == pytest.approx(spread, rel=1e-6)
    full = np.zeros((4, 4))
    full[np.ix_(places, places)] = cov
    assert np.array(got["cov"]).reshape(4, 4) == pytest.approx(full, rel=1e-4)
    assert [got[n] for n in truth] == pytest.approx(list(truth.values()), abs=0.05)


def test_qr_fit_is_stable_and_has_least_norm(spark):
    r = np.random.default_rng(4)
    x = r.uniform(-1, 1, 500)
    rows = [("near", float(a), float(a + 1e-9 * b), float(2 * a + 3 * b * 1e-9)) for a, b in zip(x, r.uniform(-1, 1, 500))]
    rows += [("same", float(a), float(a), float(4 * a)) for a in x] + [("one", 1.0, 2.0, 3.0), (None, 1.0, 0.0, 1.0), (None, 0.0, 1.0, 2.0), ("hole", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double").repartition(7)
    got = {g.k: g for g in fit.qr_fit(df, ["k"], F.col("y"), F.lit(1.0), [F.col("a"), F.col("b")]).collect()}
    assert set(got) == {"near", "same", None}
    # y = (2 - 3) a + 3 (a + 1e-9 b)
    assert got["near"].params == pytest.approx([-1.0, 3.0], abs=1e-6)
    assert got["same"].params == pytest.approx([2.0, 2.0], abs=1e-9)
    assert got[None].params == pytest.approx([1.0, 2.0]) and got["same"].chi2 == pytest.approx(0, abs=1e-9)


def test_parameter_file_comes_back(spark, known):
    t = ties_of(1)
    y = way(t, 200 + 0 * t["x"], 45 + 0 * t["x"]) + t["noise"]
    ties, begun = frame(spark, t, y, known)
    fits = calibrate.range_params(ties, "linear", begun)
    files = sinks.fit_lines(fits).select(F.concat(F.lit("/p/"), F.col("pair_id").cast("string")).alias("file"), F.col("value").alias("text"))
    back = {r.pair_id: r for r in text.read_fit_params(spark, files, "range").collect()}
    for r in fits.collect():
        b = back[str(r.pair_id)]
        assert b.params == pytest.approx([r.bn, r.bp, r.dbn, r.dbp, r.const, r.dbnq, r.dbpq], rel=1e-10)
        assert b["cov"] == pytest.approx(r["cov"], rel=1e-10) and b.sigma_res == pytest.approx(r.sigma_res, rel=1e-10)
        assert 0.005 < b.sigma_res < 0.02  # metres, not a ratio
