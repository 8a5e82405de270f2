"""Fits against dense solves, predictions, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from compare import settings
from pyspark.sql import functions as F

from catalog.views import Views
from edaflux.operators import regression as G
from edaflux.operators.boosted import fit_boosted, predict_boosted, with_bin
from edaflux.operators.nonlinear import fit_formula
from edaflux.operators.predict import apply_model, coefficient_rows, predict_models
from edaflux.plans.daily import celsius_training, daily_forecast, horizon_forecast
from edaflux.session import settle


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    out = []
    for site, n in (("a", 200), ("b", 7), ("c", 3), ("d", 2)):
        x = rng.normal(290, 4, n)
        w = rng.normal(101325, 30, n)
        z = rng.uniform(0, 1, n)
        y = 3 + 0.2 * (x - 290) - 0.01 * (w - 101325) + 1.5 * z + rng.normal(0, 0.3, n)
        out += [(site, *map(float, r)) for r in zip(y, x, w, z)]
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "k string, y double, x double, w double, z double").repartition(6)


def solve(data, site, columns):
    rows = np.array([r[1:] for r in data if r[0] == site])
    y, x = rows[:, 0], rows[:, columns]
    m = x.mean(axis=0)
    a = np.column_stack([np.ones(len(y)), x - m])
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    r = y - a @ b
    n, k = a.shape
    shift = np.eye(k)
    shift[0, 1:] = -m
    cov = shift @ np.linalg.inv(a.T @ a) @ shift.T * (r @ r) / max(n - k, 1)
    return shift @ b, np.sqrt(np.diag(cov)), r


def test_line(frame, data):
    got = {r.k: r for r in G.fit_line(frame, ["k"], "y", "x").collect()}
    for site in ("a", "b", "c"):
        b, se, res = solve(data, site, [1])
        r = got[site]
        assert [r.intercept, r.slope] == pytest.approx(list(b), rel=1e-8)
        assert [r.se_intercept, r.se_slope] == pytest.approx(list(se), rel=1e-7)
        assert r.sigma == pytest.approx(np.std(res, ddof=1), rel=1e-7)
    assert got["d"].se_slope is None and got["d"].slope is not None
    assert {r.k for r in G.fit_line(frame, ["k"], "y", "x", more_than=3).collect()} == {"a", "b"}


def test_plane_with_pressure_scale_covariates(frame, data):
    got = {r.k: r for r in G.fit_plane(frame, ["k"], "y", "x", "w").collect()}
    for site in ("a", "b"):
        b, se, res = solve(data, site, [1, 2])
        r = got[site]
        assert [r.intercept, r.slope1, r.slope2] == pytest.approx(list(b), rel=1e-7)
        assert [r.se_intercept, r.se_slope1, r.se_slope2] == pytest.approx(list(se), rel=1e-6)
        assert r.sigma == pytest.approx(np.std(res, ddof=1), rel=1e-6)
    assert got["c"].slope1 is not None and got["c"].se_slope1 is None
    line = G.fit_line(frame.where("k = 'd'"), ["k"], "y", "x").first()  # two rows: the second covariate is aliased
    assert got["d"].slope2 is None and got["d"].se_slope1 is None and got["d"].rank == 2
    assert [got["d"].slope1, got["d"].intercept] == pytest.approx([line.slope, line.intercept])


def pivoted(x: np.ndarray, y: np.ndarray):
    """Least squares as a QR that passes over columns which those before them explain: (estimates, errors, sigma)."""
    columns = np.column_stack([np.ones(len(y)), x])
    used = []
    for j in range(columns.shape[1]):
        basis, v = columns[:, used], columns[:, j]
        rest = v - (basis @ np.linalg.lstsq(basis, v, rcond=None)[0] if used else 0)
        if np.linalg.norm(rest) > 1e-7 * np.linalg.norm(v):
            used.append(j)
    a = columns[:, used]
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    r = y - a @ b
    left = len(y) - len(used)
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (r @ r) / left) if left > 0 else [None] * len(used)
    est, err = [None] * columns.shape[1], [None] * columns.shape[1]
    for k, j in enumerate(used):
        est[j], err[j] = b[k], se[k]
    return est, err, (np.std(r, ddof=1) if len(y) > 1 else None)


def alike(got, want):
    return all((g is None) == (w is None) and (g is None or g == pytest.approx(w, rel=1e-6, abs=1e-7)) for g, w in zip(got, want, strict=True))


def test_aliased_terms_alone_are_null(spark):
    rng = np.random.default_rng(8)
    cases = {}
    for k in range(40):
        n = int(rng.integers(1, 30))
        x = rng.normal(rng.choice([0, 50]), 1, (n, 3))
        kind = k % 8
        if kind in (1, 5):
            x[:, 1] = 2 * x[:, 0] - 3
        if kind in (2, 5):
            x[:, 2] = x[:, 0] - x[:, 1]
        if kind in (3, 6):
            x[:, 0] = 7.25
        if kind in (4, 6):
            x[:, 2] = -1.5
        if kind == 7:
            x[:] = x[0]
        cases[f"g{k}"] = (x, x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, n))
    rows = [(g, float(v), *map(float, r)) for g, (x, y) in cases.items() for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "k string, y double, a double, b double, c double")
    got = {}
    for r in G.fit_many(df, ["k"], "y", ["a", "b", "c"]).collect():
        got.setdefault(r.k, {})[r.term] = r
    plane = {r.k: r for r in G.fit_plane(df, ["k"], "y", "a", "b").collect()}
    wide = {r.k: r for r in df.join(G.fit_wide(df, ["k"], "y", ["a", "b", "c"]), "k").withColumn("p", G.linear_prediction(["a", "b", "c"])).collect()}
    for g, (x, y) in cases.items():
        est, se, sigma = pivoted(x, y)
        terms = [got[g][t] for t in ("(Intercept)", "a", "b", "c")]
        assert alike([t.estimate for t in terms], est) and alike([t.std_error for t in terms], se), g
        assert alike([terms[0].sigma], [sigma])
        est, se, sigma = pivoted(x[:, :2], y)
        r = plane[g]
        assert alike([r.intercept, r.slope1, r.slope2, r.se_intercept, r.se_slope1, r.se_slope2, r.sigma], [*est, *se, sigma]), g
        assert wide[g].p is not None
    assert sum(t.estimate is None for g in got.values() for t in g.values()) > 20


def test_many_covariates(frame, data):
    got = {(r.k, r.term): r for r in G.fit_many(frame, ["k"], "y", ["x", "w", "z"]).collect()}
    b, se, _ = solve(data, "a", [1, 2, 3])
    for i, term in enumerate(("(Intercept)", "x", "w", "z")):
        assert got["a", term].estimate == pytest.approx(b[i], rel=1e-6)
        assert got["a", term].std_error == pytest.approx(se[i], rel=1e-6)
    assert got["d", "x"].estimate is not None and got["d", "w"].estimate is None and got["d", "x"].std_error is None


def test_q10_thresholds(spark):
    rows = [("four", math.exp(0.5 + 0.7 * (t - 10) / 10), t) for t in (5.0, 10.0, 15.0, 20.0)]
    rows += [("three", 1.0, t) for t in (5.0, 10.0, 15.0)] + [("bad", v, 10.0) for v in (0.0, -1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, flux double, TSOIL double")
    got = {(r.k, r.term): r.value for r in G.fit_q10(df, ["k"]).collect()}
    assert got["four", "kR"] == pytest.approx(math.exp(0.5)) and got["four", "Q10"] == pytest.approx(math.exp(0.7))
    assert got["three", "kR"] is None and got["three", "Q10"] is None
    assert got["bad", "kR"] is None


def test_diagnostics_of_short_and_perfect_fits(spark):
    rows = [("short", 1.0, 2.0), ("short", 2.0, 3.0)] + [("perfect", float(i), 2.0 * i) for i in range(5)]
    got = {r.k: r for r in G.regression_diagnostics(spark.createDataFrame(rows, "k string, flux double, q0500 double"), ["k"]).collect()}
    assert got["short"].slope is None and got["short"].nobs is None
    assert got["perfect"].slope == pytest.approx(2.0) and got["perfect"].loglik is None and got["perfect"].statistic is None


def test_formula_linear_in_parameters_equals_ols(frame):
    rows = frame.where("k in ('a', 'b')").withColumn("u", (F.col("x") - 290) / 4)
    want = {r.k: r for r in G.fit_line(rows, ["k"], "y", "u").collect()}
    for r in fit_formula(rows, ["k"], "y", "a0 + a1 * u", ["a0", "a1"]).collect():
        assert r.status == "converged"
        assert [r.a0, r.a1] == pytest.approx([want[r.k].intercept, want[r.k].slope], rel=1e-6)
        assert r.ssr == pytest.approx(want[r.k].ssr, rel=1e-9)


def test_formula_recovers_an_exponential_and_reports_failures(spark):
    rng = np.random.default_rng(5)
    rows = [("good", float(2.0 * np.exp(0.3 * t) + rng.normal(0, 0.01)), float(t)) for t in np.linspace(0, 4, 60)]
    rows += [("flat", 1.0, 2.0)] * 8
    df = spark.createDataFrame(rows, "k string, y double, t double")
    got = {r.k: r for r in fit_formula(df, ["k"], "y", "a * exp(b * t)", ["a", "b"], {"b": 0.1}).collect()}
    assert got["good"].status == "converged"
    assert got["good"].a == pytest.approx(2.0, abs=0.01) and got["good"].b == pytest.approx(0.3, abs=0.01)
    assert got["flat"].status == "singular" and got["flat"].a is None


FORMULAS = [
    "a0 + a1 * exp(-x)", "a0 * exp(a1 * x) - x / a1", "pow(x, a1) / (1 + a0 * x)", "a0 * (CASE WHEN x > 1 THEN a1 * x ELSE sqrt(a0) END)",
    "if(x > 0.7, a0, a1 * a1)", "greatest(a0, a1 * x) + least(a0 * x, a1)", "tanh(a0 * x) - a1 / x", "-a0 * ln(abs(a1)) + log10(x + a0 * a0)",
    "sin(a0 * x) * cos(a1) + tan(x * a1 / 9)", "atan(a0 * x) + log1p(a1 * x) - expm1(a0 / 9) + sinh(a1 / 5) - cosh(x * a0 / 5)", "a0 * 2 + 3 * x", "power(a0, a1 * x)",
]


@pytest.mark.parametrize("formula", FORMULAS)
def test_slopes_of_formulas(spark, formula):
    from edaflux.functions.slopes import slopes

    df = spark.createDataFrame([(0.3, 1.7, 0.9), (1.9, 0.4, 1.3), (0.8, 2.2, 0.6)], "x double, a0 double, a1 double")
    found = slopes(spark, formula, ["a0", "a1"])
    for p in ("a0", "a1"):
        up, down = (F.expr(formula.replace(p, f"({p} {sign} 1e-6D)")) for sign in "+-")
        for r in df.select(F.expr(found[p]).cast("double").alias("d"), ((up - down) / 2e-6).alias("want")).collect():
            assert r.d == pytest.approx(r.want, rel=1e-6, abs=1e-7)


def test_formulas_without_a_rule_fall_back_on_differences(spark):
    from edaflux.functions.slopes import NoSlope, slopes

    with pytest.raises(NoSlope):
        slopes(spark, "cbrt(a) * x", ["a"])
    df = spark.createDataFrame([("g", 2.0 * t, t) for t in (1.0, 2.0, 3.0)], "k string, y double, x double")
    r = fit_formula(df, ["k"], "y", "cbrt(a) * x", ["a"], {"a": 5.0}).first()
    assert r.status == "converged" and r.a == pytest.approx(8.0, rel=1e-6)


def test_stacked_systems_are_solved_like_single_ones():
    from edaflux.operators.nonlinear import stacked_steps

    rng = np.random.default_rng(3)
    j = rng.normal(0, 1, (20, 9, 3))
    j[4, :, 2] = 2 * j[4, :, 0]
    a, jr = np.einsum("gni,gnj->gij", j, j), rng.normal(0, 1, (20, 3))
    upper = np.triu_indices(3)
    steps = stacked_steps(a[:, upper[0], upper[1]], jr)
    for g in range(20):
        if g == 4:
            assert np.isnan(steps[g]).all()
            continue
        want = np.linalg.solve(a[g], jr[g])
        assert np.allclose(steps[g], [*want, max(want @ jr[g], 0)])


def test_formula_without_a_number_is_undefined(spark):
    df = spark.createDataFrame([("k", 1.0, -2.0), ("k", 2.0, 3.0), ("k", 2.5, 4.0)], "k string, y double, t double")
    r = fit_formula(df, ["k"], "y", "a * ln(t)", ["a"]).first()
    assert r.status == "undefined" and r.a is None


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return Views(spark, sf_dir.replace("sf0.001", "sf0.01"))


@pytest.fixture(scope="module")
def fits(small):
    joined = small.targets_day.join(small.drivers_day, ["site_id", "datetime"])
    return coefficient_rows({"lm": G.fit_soil_linear(celsius_training(joined)), "exp": G.fit_soil_exponential(joined)})


def test_seeded_predictions_do_not_depend_on_partitioning(small, fits):
    keys = ["site_id", "model", "day", "ensemble"]

    def run(n, seed):
        out = predict_models(small.ens_wide.repartition(n), fits, seed=seed)
        return {tuple(r[k] for k in keys): r.value for r in out.collect()}

    a = run(1, 3)
    assert a == run(7, 3)
    assert a != run(1, 4)


def test_noise_has_the_fitted_spread(small, fits):
    plain = predict_models(small.ens_wide, fits, unc_fac=0, noise=0).where("model = 'exp'")
    noisy = predict_models(small.ens_wide, fits, unc_fac=0, noise=1, seed=1).where("model = 'exp'")
    keys = ["site_id", "day", "ensemble"]
    sigma = fits.where("model = 'exp'").select("site_id", F.col("sigma").alias("fitted"))
    both = plain.select(*keys, F.ln("value").alias("p")).join(noisy.select(*keys, F.ln("value").alias("q")), keys)
    z = both.join(sigma, "site_id").select(((F.col("q") - F.col("p")) / F.col("fitted")).alias("z"))
    mean, sd, n = z.agg(F.avg("z"), F.stddev("z"), F.count("z")).first()
    assert n > 1000 and abs(mean) < 0.1 and abs(sd - 1) < 0.1


def test_user_model_takes_uncertainty_by_name(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0)], "site_id string, TSOIL double, PRES double")

    def model(TSOIL, uncertainty):
        return TSOIL * (2.0 if uncertainty else 3.0)

    assert apply_model(df, model).first().prediction == 3.0
    assert apply_model(df, model, uncertainty=True).first().prediction == 2.0
    noisy = apply_model(df, model, process_unc=0.5, keys=["site_id"]).first().prediction
    assert noisy != 3.0 and abs(noisy - 3.0) < 3


def test_boosted_eligibility(spark):
    rng = np.random.default_rng(2)
    rows = []
    for site, n, nulls in (("big", 60, 0), ("six", 6, 0), ("holes", 8, 4), ("five", 5, 0)):
        for i in range(n):
            t, w = rng.uniform(0, 20), rng.uniform(0, 0.4)
            rows.append((site, 2.0 * (t > 10) + 3 * w, t, w, None if i < nulls else 1.0))
    joined = spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, np.floating) else v, r)) for r in rows],
                                   "site_id string, flux double, TSOIL double, SOILW double, PRES double")
    ens = spark.createDataFrame(
        [(s, "gec00", 273.15 + t, 0.2) for s in ("big", "six", "holes", "five") for t in (2.0, 18.0)],
        "site_id string, ensemble string, TSOIL double, SOILW double")
    got = {}
    for r in predict_boosted(joined, ens, rounds=20, noise=0).collect():
        got.setdefault(r.site_id, []).append((r.TSOIL, r.value))
    assert set(got) == {"big", "six", "holes"}
    assert all(v is None for _, v in got["holes"])
    low, high = (v for _, v in sorted(got["big"]))
    assert high - low == pytest.approx(2.0, abs=0.5)
    assert sorted(t for t, _ in got["big"]) == [275.15, 291.15]


def test_forecasts_have_the_published_shape(small):
    from catalog.models import _training

    targets, drivers = _training(small)
    daily = daily_forecast(small.ens_wide, targets, drivers, "2024-01-01", seed=2, boosted_rounds=3).collect()
    assert {r.model for r in daily} == {"lm", "exp", "exp_month", "xgboost"}
    assert len({r.day for r in daily}) == 1
    for r in daily:
        q = [r.q0025, r.q0100, r.q0500, r.q0900, r.q0975]
        if None not in q:
            assert q == sorted(q)
    horizon = horizon_forecast(small.ens_wide, targets, drivers, "2024-01-01", seed=2, boosted_rounds=0)
    lo, hi, least = horizon.agg(F.min("horizon"), F.max("horizon"), F.min("crps")).first()
    assert lo == 0 and hi == 29 and least >= 0


def test_near_constant_covariate_has_no_slope(spark):
    rows = [("a", 0.1 + 0.2, 1.0), ("a", 0.3, 2.0), ("a", 0.3, 3.0), ("a", 0.3, 4.0), ("b", 273.15, 1.0), ("b", 273.16, 2.0), ("b", 273.17, 3.0)]
    got = {r.k: r for r in G.fit_line(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "y", "x").collect()}
    assert got["a"].slope is None and got["a"].n == 4 and got["b"].slope == pytest.approx(100.0)


def test_a_sites_trees_do_not_depend_on_the_number_of_sites(spark):
    """Each site has its own model, with 2, 1,025 or 2,100 sites."""
    def models(n, wanted):
        rows = spark.range(n * 8, numPartitions=8).select(
            (F.col("id") % n).cast("string").alias("site_id"), ((F.col("id") / n).cast("int") * 7 % 5 / 3.0).alias("flux"),
            ((F.col("id") / n).cast("int") * 1.5).alias("TSOIL"), ((F.col("id") / n).cast("int") * 5 % 7 / 10.0).alias("SOILW"))
        fits = fit_boosted(rows, rounds=5).select("site_id", "sigma", F.to_json(F.struct("steps")).alias("steps")).collect()
        assert len(fits) == n and all(r.sigma is not None for r in fits)
        return {(r.sigma, r.steps) for r in fits if r.site_id in wanted}

    few = models(2, ("0", "1"))
    assert len(few) == 1 and models(1025, ("0", "1")) == models(2100, ("0", "1")) == few


def plain_trees(x: list, y: list, rounds: int):
    """Boosting by nested lists of rows: (predict, fitted). Cuts are values; a row goes left below the cut."""
    base = sum(y) / len(y)
    fitted, trees = [base] * len(y), []

    def grow(rows, rest, depth):
        whole = sum(rest[i] for i in rows)
        best, found = 1e-6, None
        options = []
        for axis in range(2) if depth else ():
            for cut in sorted({v[axis] for v in x})[1:]:
                left = [i for i in rows if x[i][axis] < cut]
                if left and len(left) < len(rows):
                    g = sum(rest[i] for i in left)
                    gain = g * g / (len(left) + 1) + (whole - g) ** 2 / (len(rows) - len(left) + 1) - whole * whole / (len(rows) + 1)
                    options.append((gain, axis, cut))
                    best = max(best, gain)
        found = next(((a, c) for gain, a, c in options if gain > 1e-6 and gain >= best * (1 - 1e-9)), None)
        if found is None:
            return 0.1 * whole / (len(rows) + 1)
        axis, cut = found
        parts = [[i for i in rows if (x[i][axis] < cut) == side] for side in (True, False)]
        return axis, cut, *(grow(p, rest, depth - 1) for p in parts)

    def leaf(tree, v):
        while isinstance(tree, tuple):
            tree = tree[2] if v[tree[0]] < tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        tree = grow(list(range(len(y))), [a - f for a, f in zip(y, fitted, strict=True)], 3)
        trees.append(tree)
        fitted = [f + leaf(tree, v) for f, v in zip(fitted, x, strict=True)]
    return lambda v: base + sum(leaf(t, v) for t in trees), fitted


def test_trees_are_those_of_plain_boosting(spark):
    rng = np.random.default_rng(5)
    sites, rows, members = {"a": 40, "b": 25, "flat": 12}, [], []
    for s, n in sites.items():
        for _ in range(n):
            t, w = float(rng.integers(0, 15)), float(rng.integers(0, 9)) / 20
            rows.append((s, 1.0 if s == "flat" else float(np.sin(t) + 3 * w + rng.normal(0, 0.1)), t, w))
        members += [(s, f"g{k}", 273.15 + float(rng.uniform(-3, 18)), float(rng.uniform(-0.1, 0.5))) for k in range(30)]
    joined = spark.createDataFrame(rows, "site_id string, flux double, TSOIL double, SOILW double")
    ens = spark.createDataFrame([*members, ("a", "none", None, 0.1), ("b", "none", 280.0, None)], "site_id string, ensemble string, TSOIL double, SOILW double")
    models = fit_boosted(joined, rounds=12)
    got = {(r.site_id, r.ensemble): r.value for r in predict_boosted(joined, ens, rounds=12, noise=0, models=models).collect()}
    assert got.pop(("a", "none")) is None and got.pop(("b", "none")) is None and len(got) == 90
    sigma = {r.site_id: r.sigma for r in models.collect()}
    for s in sites:
        own = [r for r in rows if r[0] == s]
        predict, fitted = plain_trees([(r[2], r[3]) for r in own], [r[1] for r in own], 12)
        assert sigma[s] == pytest.approx(np.std([r[1] - f for r, f in zip(own, fitted, strict=True)], ddof=1), abs=1e-12)
        for site, e, t, w in members:
            if site == s:
                assert got[s, e] == pytest.approx(predict((t - 273.15, w)), rel=1e-9)


def test_a_dominant_value_leaves_the_others_exact(spark):
    """A hundred distinct values of which one has 99.9% of the rows."""
    rows = spark.range(100_000).select(
        F.lit("s").alias("site_id"), F.when(F.col("id") % 1000 == 0, F.col("id") / 1000 % 100).otherwise(0).cast("double").alias("SOILW"), F.lit(10.0).alias("TSOIL"))
    fit = fit_boosted(rows.withColumn("flux", 10 * F.col("SOILW")), rounds=200).first()
    assert fit.cuts == [[], [float(v) for v in range(1, 100)]] and len(fit.steps) == 100
    assert fit.sigma < 0.2


def test_many_values_and_heavy_ones_share_the_bins(spark):
    """20,000 continuous rows of three sites, one of them with two values that hold half of its rows."""
    t = F.when((F.col("site_id") == "2") & (F.col("id") % 2 == 0), F.col("id") % 4 / 2.0).otherwise(F.rand(1) * 20)
    rows = spark.range(20_000).withColumn("site_id", (F.col("id") % 3).cast("string")).select(
        "site_id", t.alias("TSOIL"), (F.rand(2) * 0.5).alias("SOILW"), (F.rand(3) * 0.1).alias("flux"))
    rows = settle(rows.withColumn("flux", F.col("flux") + F.sin("TSOIL") + F.col("SOILW")))
    for r in fit_boosted(rows, rounds=60).collect():
        assert all(100 < len(c) < 256 and c == sorted(set(c)) for c in r.cuts)
        assert len(r.steps) == (len(r.cuts[0]) + 1) * (len(r.cuts[1]) + 1) <= 256 * 256 and r.sigma < 0.2
        if r.site_id == "2":
            assert {0.0, 1.0} <= {0.0, *r.cuts[0]}
            assert min(c for c in r.cuts[0] if c > 1.0) < 1.2 and min(c for c in r.cuts[0] if c > 0.0) < 0.3


def test_binary_search_of_bins(spark):
    cuts = [float(v) for v in range(255)]
    rows = spark.createDataFrame([(v, c) for c in (cuts, cuts[:3], []) for v in (-1.0, 0.0, 0.5, 2.0, 254.0, 300.0, None)], "x double, cuts array<double>")
    got = with_bin(rows, "b", F.col("x"), F.col("cuts")).collect()
    assert all(r.b == (None if r.x is None else sum(c <= r.x for c in r.cuts)) for r in got)
    text = with_bin(rows, "b", F.col("x"), F.col("cuts"))._jdf.queryExecution().executedPlan().toString()
    assert "filter" not in text.lower()


def test_the_ensemble_is_not_shuffled_for_its_trees(spark):
    """47 sites of the largest possible grids are some 25 MB, which are broadcast; ten times that are not."""
    def joined(bins):
        steps = F.array_repeat(F.lit(1.0), bins * bins)
        cuts = F.array(F.sequence(F.lit(1), F.lit(bins - 1)).cast("array<double>"), F.sequence(F.lit(1), F.lit(bins - 1)).cast("array<double>"))
        models = spark.range(47).select(F.col("id").cast("string").alias("site_id"), F.lit(1.0).alias("sigma"), cuts.alias("cuts"), steps.alias("steps"))
        ens = spark.range(1000).select((F.col("id") % 47).cast("string").alias("site_id"), F.lit(280.0).alias("TSOIL"), F.lit(0.2).alias("SOILW"))
        out = predict_boosted(ens, ens, noise=0, models=models)
        assert out.count() == 1000
        return out._jdf.queryExecution().executedPlan().toString()

    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert "Exchange hashpartitioning" not in joined(256) and "SortMergeJoin" in joined(600)


def test_boosting_fits_what_it_is_given():
    from edaflux.operators.boosted import boost

    rng = np.random.default_rng(1)
    n = rng.integers(0, 3, (30, 20)).astype(float)
    y = n * (np.sin(np.arange(30) / 5)[:, None] + np.arange(20) ** 2 / 400)
    own = boost(n, y, 400)
    assert np.abs((own * n - y)[n > 0]).max() < 0.5 and np.std((own * n - y)[n > 0]) < 0.1 * np.std(y[n > 0])
    assert np.allclose(boost(n, y, 0), y.sum() / n.sum())


def test_only_steps_that_overshoot_are_shortened(spark, monkeypatch):
    """Sites whose whole steps lower the error are read once an iteration; one that starts far off comes to the same curve."""
    from edaflux.operators import nonlinear

    tried, usual = [], nonlinear._best_lengths
    monkeypatch.setattr(nonlinear, "_best_lengths", lambda *a: tried.append(a[1].count()) or usual(*a))
    rows = [(site, x / 10, 3.0 * math.exp(0.5 * x / 10) + (x % 3 - 1) * 0.01) for site in ("a", "b") for x in range(30)]
    df = spark.createDataFrame(rows, "site string, x double, y double")
    near = nonlinear.fit_formula(df, ["site"], "y", "k * exp(r * x)", ["k", "r"], {"k": 2.9, "r": 0.49}).collect()
    assert not tried and {r["status"] for r in near} == {"converged"}
    far = nonlinear.fit_formula(df, ["site"], "y", "k * exp(r * x)", ["k", "r"], {"k": 1.0, "r": -1.5}).collect()
    assert tried and {r["status"] for r in far} == {"converged"}
    for a, b in zip(sorted(near), sorted(far), strict=True):
        assert a["k"] == pytest.approx(b["k"], rel=1e-4) and a["r"] == pytest.approx(b["r"], rel=1e-4)
