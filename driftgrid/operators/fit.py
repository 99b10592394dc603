"""Weighted least squares for all pairs at once: normal equations are sums in one aggregation; only k x k systems are solved in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wls_fit(df: DataFrame, keys: list[str], y: Column, sigma: Column, basis: list[Column], min_points: int | None = None) -> DataFrame:
    """Per key params, cov (flat k x k, of unit-weight errors), chi2, n and sigma_res; no row where points are too few or the system is singular.

    Rows with a null in y, sigma or a basis are left out.
    """
    k = len(basis)
    cols = [b.cast("double").alias(f"_b{n}") for n, b in enumerate(basis)]
    rows = df.select(*keys, y.cast("double").alias("_y"), (1 / (sigma * sigma)).alias("_w"), *cols).dropna()
    w = F.col("_w")
    sums = [F.sum(w * F.col(f"_b{a}") * F.col(f"_b{b}")) for a in range(k) for b in range(a, k)]
    rhs = [F.sum(w * F.col(f"_b{a}") * F.col("_y")) for a in range(k)]
    normal = rows.groupBy(*keys).agg(F.array(*sums).alias("_n"), F.array(*rhs).alias("_r"), F.sum(w * F.col("_y") * F.col("_y")).alias("_yy"), F.count(F.lit(1)).alias("n"))
    normal = normal.where(F.col("n") >= (min_points or k))

    def solve(batches):
        upper = np.triu_indices(k)
        for pdf in batches:
            m = np.zeros((len(pdf), k, k))
            if len(pdf):
                m[:, upper[0], upper[1]] = np.stack(pdf["_n"].to_numpy())
                m[:, upper[1], upper[0]] = m[:, upper[0], upper[1]]
            r = np.stack(pdf["_r"].to_numpy()) if len(pdf) else np.zeros((0, k))
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", m), 1e-300))
            unit = m / (scale[:, :, None] * scale[:, None, :])
            good = np.linalg.cond(unit) < 1e12 if len(pdf) else np.zeros(0, bool)
            inv = np.linalg.inv(unit[good]) / (scale[good][:, :, None] * scale[good][:, None, :])
            p = np.einsum("nab,nb->na", inv, r[good])
            out = pdf.loc[good, [*keys, "n"]].copy()
            chi2 = pdf["_yy"].to_numpy()[good] - np.einsum("na,na->n", p, r[good])
            out["params"], out["cov"], out["chi2"] = list(p), list(inv.reshape(len(p), -1)), np.maximum(chi2, 0)
            yield out[[*keys, "params", "cov", "chi2", "n"]]

    kinds = ", ".join(f"{c} {t}" for c, t in normal.select(*keys).dtypes)
    fitted = normal.mapInPandas(solve, f"{kinds}{', ' if kinds else ''}params array<double>, cov array<double>, chi2 double, n bigint")
    return fitted.withColumn("sigma_res", F.sqrt(F.col("chi2") / F.greatest(F.col("n") - k, F.lit(1))))


#: Pairs of which one task holds matrices before it hands them on.
HELD = 4096


def qr_fit(df: DataFrame, keys: list[str], y: Column, sigma: Column, basis: list[Column], min_points: int | None = None, e: Column | None = None) -> DataFrame:
    """X1 without normal equations: per key params, cov (flat k x k, of unit-weight errors), chi2, n, sigma_res and the spread of e (null without e).

    Each task keeps for a key the triangle of a QR decomposition of its rows [basis | y] / sigma, a matrix of (k + 1) x (k + 1); triangles of one key
    are stacked and decomposed again, so that rows are never shuffled and the condition number isn't squared. Singular values below 1e-12 of the
    largest are left out: a singular system has its solution of least norm. Rows with a null in y, sigma or a basis are left out.
    """
    k = len(basis)
    side = k + 1
    cols = [(b / sigma).cast("double").alias(f"_b{n}") for n, b in enumerate(basis)]
    rows = df.select(*keys, *cols, (y / sigma).cast("double").alias("_y"), F.coalesce(e, F.lit(0.0)).cast("double").alias("_e") if e is not None else F.lit(0.0).alias("_e"))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*keys).dtypes)

    def triangles(batches):
        held: dict = {}

        def out():
            made = [(*key, r.ravel(), *sums) for key, (r, sums) in held.items()]
            return pd.DataFrame(made, columns=[*keys, "r", "n", "e", "ee"])

        for pdf in batches:
            values = pdf[[*[f"_b{n}" for n in range(k)], "_y"]].to_numpy(float)
            # rows are dropped here: Spark would make every formula once more for a filter on all of them
            whole = ~np.isnan(values).any(axis=1)
            pdf, values = pdf[whole], values[whole]
            rest = pdf["_e"].to_numpy(float)
            for key, at in pdf.groupby(keys, dropna=False, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                before, sums = held.get(key, (np.zeros((0, side)), np.zeros(3)))
                r = np.linalg.qr(np.concatenate([before, values[at]]), mode="r")
                held[key] = r, sums + [len(at), rest[at].sum(), (rest[at] ** 2).sum()]
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def solved(parts, n: float, e: float, ee: float) -> tuple:
        r = np.linalg.qr(np.concatenate([x.reshape(-1, side) for x in parts]), mode="r")
        r = np.concatenate([r, np.zeros((max(0, side - len(r)), side))])
        u, s, vt = np.linalg.svd(r[:k, :k])
        inv = np.where(s > 1e-12 * max(s[0], 1e-300), 1 / np.where(s > 0, s, 1), 0)
        p = vt.T @ (inv * (u.T @ r[:k, k]))
        left = float(((r[:k, k] - r[:k, :k] @ p) ** 2).sum() + (r[k:, k] ** 2).sum())
        return p, ((vt.T * inv**2) @ vt).ravel(), left, int(n), np.sqrt(max(ee / n - (e / n) ** 2, 0.0))

    def solve(batches):
        for pdf in batches:
            made = [solved(*row) for row in zip(pdf["r"], pdf["n"], pdf["e"], pdf["ee"], strict=True)]
            yield pdf[keys].join(pd.DataFrame(made, columns=["params", "cov", "chi2", "n", "spread"], index=pdf.index))

    found = rows.mapInPandas(triangles, f"{kinds}, r array<double>, n double, e double, ee double")
    # a list has a triangle for each task that has met the key; a Python call for each key would take longer than the solution
    stacked = found.groupBy(*keys).agg(F.collect_list("r").alias("r"), *[F.sum(c).alias(c) for c in ("n", "e", "ee")])
    fitted = stacked.mapInPandas(solve, f"{kinds}, params array<double>, cov array<double>, chi2 double, n bigint, spread double")
    fitted = fitted.where(F.col("n") >= (min_points or k))
    return fitted.withColumn("sigma_res", F.sqrt(F.col("chi2") / F.greatest(F.col("n") - k, F.lit(1))))


def residuals(df: DataFrame, fitted: DataFrame, keys: list[str], y: Column, basis: list[Column]) -> DataFrame:
    """df with e, the residual of y; rows of keys without a fit are dropped."""
    model = sum((F.get("params", F.lit(n)) * b for n, b in enumerate(basis)), F.lit(0.0))
    return df.join(fitted.select(*keys, "params"), keys).withColumn("e", y - model).drop("params")


def reweight(df: DataFrame, keys: list[str]) -> DataFrame:
    """df(e, weight) with sigma: the residuals' spread shared out by weight, a tenth of it at least."""
    s = df.groupBy(*keys).agg(F.sqrt(F.greatest(F.avg(F.col("e") * F.col("e")) - F.avg("e") * F.avg("e"), F.lit(0.0))).alias("_sp"), F.sum("weight").alias("_sw"), F.count(F.lit(1)).alias("_n"))
    sigma = F.greatest(F.col("_sp") * F.col("weight") * F.col("_n") / F.col("_sw"), 0.1 * F.col("_sp"))
    return df.drop("sigma").join(s, keys).withColumn("sigma", F.greatest(sigma, F.lit(1e-12))).drop("_sp", "_sw", "_n")


def place_covariance(cov: Column, solved: list[int], size: int, scale: list[float] | None = None) -> Column:
    """A flat k x k covariance at its places in a flat size x size one, times conditioning constants; zeros elsewhere."""
    scale = scale or [1.0] * len(solved)
    at = {(solved[a], solved[b]): F.get(cov, F.lit(a * len(solved) + b)) * (scale[a] * scale[b]) for a in range(len(solved)) for b in range(len(solved))}
    return F.array(*[at.get((a, b), F.lit(0.0)) for a in range(size) for b in range(size)])


#: The terms solved for by variant, of struct columns theta_d and x, and their places in the covariance of bn, dbn, dbp, dbnq, dbpq and the last, which is the constant ("sv" variants: bp).
RANGE_VARIANTS = {
    "bnbpdbp": (["bn", "dbp", "const"], [0, 2, 5]),
    "bpdbp": (["dbp", "const"], [2, 5]),
    "const": (["const"], [5]),
    "linear": (["bn", "dbp", "dbn", "const"], [0, 2, 1, 5]),
    "quad": (["bn", "dbp", "dbn", "const", "dbpq", "dbnq"], [0, 2, 1, 5, 4, 3]),
    "sv_const": (["bp"], [5]),
    "sv_quad": (["bn", "dbp", "dbn", "bp", "dbpq", "dbnq"], [0, 2, 1, 5, 4, 3]),
}
#: The terms by variant and their places in the covariance of bn, bp, dbn, dbp, dbnq, dbpq; "ramp" and "no_ramp" have their along-track term at the place of dbp.
PHASE_VARIANTS = {
    "ramp": (["bn", "bp", "ramp", "dbn"], [0, 1, 3, 2]),
    "no_ramp": (["bn", "bp", "cos_ramp", "dbn"], [0, 1, 3, 2]),
    "bp": (["bp"], [1]),
    "bnbp": (["bn", "bp"], [0, 1]),
    "bpdbp": (["bp", "dbp"], [1, 3]),
    "bnbpdbp": (["bn", "bp", "dbp"], [0, 1, 3]),
    "dbp": (["bn", "bp", "dbp", "dbn"], [0, 1, 3, 2]),
    "quad": (["bn", "bp", "dbp", "dbn", "dbpq", "dbnq"], [0, 1, 3, 2, 5, 4]),
}


def baseline_terms(theta_d: Column, x: Column, scale: Column | float = 1.0) -> dict[str, Column]:
    """What each baseline parameter adds to a measure, times scale (two_k for phase), by name."""
    s, c, k = F.sin(theta_d), F.cos(theta_d), F.lit(scale)
    return {
        "bn": -k * s, "bp": -k * c, "dbn": -k * x * s, "dbp": -k * x * c, "dbnq": -k * x * x * s, "dbpq": -k * x * x * c,
        "const": F.lit(1.0), "ramp": k * x, "cos_ramp": k * x * c,
    }


def range_basis(variant: str, theta_d: Column, x: Column) -> list[Column]:
    terms = baseline_terms(theta_d, x)
    return [terms[n] for n in RANGE_VARIANTS[variant][0]]


#: Fixed value: the constant that makes the constant of azimuth offsets as large as the rates' terms.
AZIMUTH_SCALE = 8e5


def azimuth_basis(variant: str, x: Column, slant_sin: Column) -> list[Column]:
    """Constants and along-track rates, scaled near one another."""
    return {"const": [F.lit(8e5)], "linear": [F.lit(8e5), x * 8e5], "baseline_const": [F.lit(8e5), slant_sin], "baseline_linear": [F.lit(8e5), slant_sin, x * 8e5]}[variant]


def phase_basis(variant: str, theta_d: Column, x: Column, two_k: Column) -> list[Column]:
    terms = baseline_terms(theta_d, x, two_k)
    return [terms[n] for n in PHASE_VARIANTS[variant][0]]


def placed_covariance(fitted: DataFrame, variants: dict, variant: str, size: int = 6) -> DataFrame:
    """Fitted with cov, that of the parameters solved for, at its places in that of all."""
    return fitted.withColumn("cov", place_covariance(F.col("cov"), variants[variant][1], size))


def _passes(ties: DataFrame, basis: list[Column], passes: int, min_points: int, keys: list[str]) -> DataFrame:
    """Fits over and over, each pass with sigmas from the residuals of the one before."""
    rows = ties.withColumn("sigma", F.col("weight").cast("double"))
    fitted = wls_fit(rows, keys, F.col("y"), F.col("sigma"), basis, min_points)
    for _ in range(passes - 1):
        rows = reweight(residuals(rows, fitted, keys, F.col("y"), basis), keys).drop("e")
        fitted = wls_fit(rows, keys, F.col("y"), F.col("sigma"), basis, min_points)
    return fitted


def fit_range_params(ties: DataFrame, variant: str = "bnbpdbp", passes: int = 3) -> DataFrame:
    """Per pair_id from ties(pair_id, theta_d, x, weight, y); two points at least."""
    basis = range_basis(variant, F.col("theta_d"), F.col("x"))
    return _passes(ties, basis, passes, max(2, len(basis)), ["pair_id"])


def fit_azimuth_params(ties: DataFrame, variant: str = "linear", passes: int = 3) -> DataFrame:
    """Per pair_id from ties(pair_id, x, slant_sin, weight, y)."""
    basis = azimuth_basis(variant, F.col("x"), F.col("slant_sin"))
    return _passes(ties, basis, passes, len(basis), ["pair_id"])


def fit_phase_baseline(ties: DataFrame, variant: str = "dbp") -> DataFrame:
    """Per pair_id from ties(pair_id, theta_d, x, two_k, y), all errors alike; four points at least."""
    basis = phase_basis(variant, F.col("theta_d"), F.col("x"), F.col("two_k"))
    return wls_fit(ties, ["pair_id"], F.col("y"), F.lit(1.0), basis, max(4, len(basis)))


def fit_sv_azimuth_surface(samples: DataFrame, key: str = "pair_id") -> DataFrame:
    """Per pair a surface of the basis 1, r, a, ra and r squared through samples(key, r, a, offset); 100 points at least."""
    r, a = F.col("r"), F.col("a")
    return wls_fit(samples, [key], F.col("offset"), F.lit(1.0), [F.lit(1.0), r, a, r * a, r * r], 100)


def sv_sample_grid(pairs: DataFrame, side: int = 50) -> DataFrame:
    """pairs(n_range, n_azimuth, ...) with r and a at the nodes of a grid of side x side over the image."""
    at = lambda name: F.explode(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: k * F.col(name) / side)).alias(name[2:3])
    return pairs.select("*", at("n_range")).select("*", at("n_azimuth"))


def surface_at(params: Column, r: Column, a: Column) -> Column:
    """The surface's value."""
    p = [F.get(params, F.lit(k)) for k in range(5)]
    return p[0] + p[1] * r + p[2] * a + p[3] * r * a + p[4] * r * r
