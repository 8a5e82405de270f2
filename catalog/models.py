"""Model fit and predict."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import RUN_DATE
from edaflux.functions.dates import day_of
from edaflux.operators import regression as G
from edaflux.functions.scalars import kelvin_to_celsius, reduced_temperature_kelvin
from edaflux.operators.boosted import fit_boosted, predict_boosted
from edaflux.operators.filters import complete_cases
from edaflux.operators.joins import pair_training_rows
from edaflux.operators.nonlinear import fit_formula
from edaflux.operators.predict import (
    apply_model,
    coefficient_rows,
    predict_models,
    predict_null_model,
    standard_prediction,
)
from edaflux.operators.aggregate import ensemble_summary
from edaflux.plans.daily import celsius_training, daily_forecast, fit_forecast, horizon_forecast, predict_forecast
from edaflux.plans.hindcast import fit_flux, with_fitted
from edaflux.schemas import QUANTILES
from edaflux.session import settle

# Observed days stand for each training period in turn; a shift of dates brings them into the one asked for.
_DAYS_TO_TRAINING_MONTH = 61  # January 2024 -> November 2023
_DAYS_TO_YEAR_BEFORE = 731  # January 2024 -> the end of 2021 and January 2022


def _joined(v):
    return pair_training_rows(v.targets_day, v.drivers_day)


# Two covariates; constant ones, and a second one collinear with the first, are aliased.
_PLANE = """
    SELECT {g}, n, my - coalesce(b1, 0) * m1 - coalesce(b2, 0) * m2 AS intercept, b1, b2, sqrt(s2 * (1.0 / n + CASE
             WHEN d IS NOT NULL THEN (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d
             WHEN b1 IS NOT NULL THEN m1 * m1 / s11 WHEN b2 IS NOT NULL THEN m2 * m2 / s22 ELSE 0 END)) AS se0,
           sqrt(CASE WHEN d IS NOT NULL THEN s2 * s22 / d WHEN b1 IS NOT NULL THEN s2 / s11 END) AS se1,
           sqrt(CASE WHEN d IS NOT NULL THEN s2 * s11 / d WHEN b2 IS NOT NULL THEN s2 / s22 END) AS se2,
           CASE WHEN n > 1 THEN sqrt(ssr / (n - 1)) END AS sigma, ssr
    FROM (SELECT *, CASE WHEN n > rank THEN ssr / (n - rank) END AS s2
    FROM (SELECT *, greatest(syy - coalesce(b1, 0) * s1y - coalesce(b2, 0) * s2y, 0) AS ssr, 1 + (b1 IS NOT NULL)::INTEGER + (b2 IS NOT NULL)::INTEGER AS rank
    FROM (SELECT *, CASE WHEN d IS NOT NULL THEN (s22 * s1y - s12 * s2y) / d WHEN v1 THEN s1y / s11 END AS b1,
                 CASE WHEN d IS NOT NULL THEN (s11 * s2y - s12 * s1y) / d WHEN NOT v1 AND v2 THEN s2y / s22 END AS b2
    FROM (SELECT *, CASE WHEN v1 AND v2 AND n > 2 AND s11 * s22 - s12 * s12 > 1e-12 * s11 * s22 THEN s11 * s22 - s12 * s12 END AS d
    FROM (SELECT *, n > 1 AND s11 > 1e-14 * (s11 + n * m1 * m1) AS v1, n > 1 AND s22 > 1e-14 * (s22 + n * m2 * m2) AS v2
    FROM (SELECT {g}, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,
                 regr_sxx({y}, {x1}) AS s11, regr_sxx({y}, {x2}) AS s22, regr_syy({y}, {x1}) AS syy,
                 regr_sxy({y}, {x1}) AS s1y, regr_sxy({y}, {x2}) AS s2y, regr_sxy({x2}, {x1}) AS s12
          FROM {t} GROUP BY {g}))))))"""

_LINE = """
    SELECT {g}, n, my - b * mx AS intercept, b AS slope, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS se_intercept,
           sqrt(s2 / sxx) AS se_slope, sqrt(ssr / (n - 1)) AS sigma, ssr
    FROM (SELECT *, syy - b * sxy AS ssr, (syy - b * sxy) / (n - 2) AS s2
          FROM (SELECT *, sxy / NULLIF(sxx, 0) AS b
                FROM (SELECT {g}, count(*) AS n, avg({x}) AS mx, avg({y}) AS my, regr_sxx({y}, {x}) AS sxx,
                             regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy
                      FROM {t} GROUP BY {g} HAVING count(*) > {more})))"""

_COMPLETE = """(SELECT site_id, flux, "SOILW", "TSOIL" - 273.15::DOUBLE AS tc, datetime FROM targets_day
               JOIN drivers_day USING (site_id, datetime)
               WHERE flux IS NOT NULL AND flux_err IS NOT NULL AND "PRES" IS NOT NULL AND "TSOIL" IS NOT NULL
                 AND "SOILW" IS NOT NULL AND "WEASD" IS NOT NULL AND "SNOD" IS NOT NULL AND "ICETK" IS NOT NULL)"""
_LOGGED = """(SELECT site_id, ln(flux) AS ln_flux, ("TSOIL" - 273.15::DOUBLE - 10) / 10 AS t10 FROM targets_day
             JOIN drivers_day USING (site_id, datetime) WHERE flux > 0 AND "TSOIL" IS NOT NULL {and_})"""

_LM = _PLANE.format(g="site_id", x1='"SOILW"', x2="tc", y="flux", t=_COMPLETE)
_EXP = _LINE.format(g="site_id", x="t10", y="ln_flux", t=_LOGGED.format(and_=""), more=2)


@query("m1_ols_two_predictor", f"""
    SELECT site_id, n, intercept, b1 AS b_soilw, b2 AS b_tsoil, se0 AS se_intercept, se1 AS se_soilw, se2 AS se_tsoil, sigma
    FROM ({_LM})""")
def _m1(v):
    fit = G.fit_soil_linear(celsius_training(_joined(v)))
    return fit.select("site_id", "n", "intercept", "b_soilw", "b_tsoil", "se_intercept", "se_soilw", "se_tsoil", "sigma")


@query("m1_ols_two_predictor_large", f"""
    SELECT l_suppkey, n, intercept, b1 AS slope1, b2 AS slope2, se0 AS se_intercept, se1 AS se_slope1, se2 AS se_slope2, sigma
    FROM ({_PLANE.format(g="l_suppkey", x1="x1", x2="x2", y="y", t="reg_big")})""")
def _m1_large(v):
    return G.fit_plane(v.reg_big, ["l_suppkey"], "y", "x1", "x2").drop("ssr", "syy", "rank")


@query("m2_exponential", f"""
    SELECT site_id, n, intercept, slope AS b_t10, se_intercept, se_slope AS se_t10, sigma FROM ({_EXP})""")
def _m2(v):
    return G.fit_soil_exponential(_joined(v)).drop("ssr", "syy")


@query("m3_exponential_month", f"""
    SELECT site_id, n, intercept, slope AS b_t10, se_intercept, se_slope AS se_t10, sigma
    FROM ({_LINE.format(g="site_id", x="t10", y="ln_flux", t=_LOGGED.format(and_="AND datetime >= DATE '2024-01-02' AND datetime < DATE '2024-02-01'"), more=2)})""")
def _m3(v):
    """The month is chosen by the run's date; the SQL names the days that fall into it after the shift."""
    from edaflux.functions.dates import training_month
    from edaflux.plans.daily import within_month

    # 2 to 30 January fall into April 2024 once moved by 90 days, and a run of 20 May trains on April.
    moved = _joined(v).withColumn("datetime", F.date_add("datetime", 90))
    chosen = within_month(moved, training_month(F.lit("2024-05-20").cast("date")))
    return G.fit_soil_exponential(chosen).drop("ssr", "syy")


@query("m4_q10_law", f"""
    WITH f AS ({_LINE.format(g="site_id", x="t10", y="ln_flux", more=3, t='''(SELECT site_id, ln(flux) AS ln_flux, ("TSOIL" - 10) / 10 AS t10
        FROM targets_day JOIN drivers_day USING (site_id, datetime) WHERE flux > 0 AND "TSOIL" IS NOT NULL)''')}),
    g AS (SELECT DISTINCT site_id FROM targets_day JOIN drivers_day USING (site_id, datetime))
    SELECT g.site_id, 'kR' AS term, exp(intercept) AS value FROM g LEFT JOIN f USING (site_id)
    UNION ALL SELECT g.site_id, 'Q10', exp(slope) FROM g LEFT JOIN f USING (site_id)""")
def _m4(v):
    return G.fit_q10(_joined(v).select("site_id", "flux", "TSOIL"), ["site_id"])


def _fits(v):
    joined = _joined(v)
    return coefficient_rows({"lm": G.fit_soil_linear(celsius_training(joined)), "exp": G.fit_soil_exponential(joined)})


_VALUE = ("site_id", "day", "ensemble", "model", "value")


@query("m5_linear_prediction", f"""
    SELECT e.site_id, e.day, e.ensemble, 'lm' AS model,
           f.intercept + f.b1 * e."SOILW" + f.b2 * (e."TSOIL" - 273.15::DOUBLE) AS value
    FROM ens_wide e JOIN ({_LM}) f USING (site_id)""")
def _m5(v):
    out = predict_models(v.ens_wide, _fits(v).where(F.col("model") == "lm"), unc_fac=0, noise=0)
    return out.select(*_VALUE)


def _noise_check(rows, z, groups=("site_id",)):
    """Counts, nulls, and whether standardised noise has mean 0 and sd 1 within five standard errors, per group."""
    n = F.count(z)
    root = F.sqrt(n.cast("double"))
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(z.isNull()).alias("nulls"),
        (F.abs(F.avg(z)) <= F.lit(5.0) / root).alias("mean_ok"),
        (F.abs(F.stddev_samp(z) - 1) <= F.lit(5.0) / F.sqrt(2 * (n - 1).cast("double"))).alias("sd_ok"),
        (F.count_distinct(z) == n).alias("all_differ"),
    )


_NOISE = """count(*) AS n, count(*) FILTER ({v} IS NULL) AS nulls, CASE WHEN count({v}) > 0 THEN true END AS mean_ok,
    CASE WHEN count({v}) > 1 THEN true END AS sd_ok, true AS all_differ"""


def _seeded_against_point(v, model, scale, transform=lambda c: c):
    """Seeded values standardised by the sd their noise should have."""
    fits = _fits(v).where(F.col("model") == model)
    point = predict_models(v.ens_wide, fits, unc_fac=0, noise=0).select(*_VALUE[:4], transform(F.col("value")).alias("point"))
    seeded = predict_models(v.ens_wide, fits, seed=11).select(*_VALUE[:4], "TSOIL", "SOILW", transform(F.col("value")).alias("value"))
    rows = seeded.join(point, list(_VALUE[:4])).join(fits.drop("model"), "site_id")
    return _noise_check(rows, (F.col("value") - F.col("point")) / F.sqrt(scale))


@query("m5_linear_prediction_seeded", f"""
    WITH p AS (SELECT e.site_id, f.intercept + f.b1 * e."SOILW" + f.b2 * e."TSOIL" AS x FROM ens_wide e JOIN ({_LM}) f USING (site_id))
    SELECT site_id, {_NOISE.format(v="x")} FROM p GROUP BY site_id""")
def _m5_seeded(v):
    sq = lambda c: c * c
    return _seeded_against_point(
        v, "lm", sq(F.col("se_intercept")) + sq(F.col("se_soilw") * F.col("SOILW"))
        + sq(F.col("se_tsoil") * kelvin_to_celsius("TSOIL")) + sq(F.col("sigma")),
    )


@query("m6_exponential_prediction", f"""
    SELECT e.site_id, e.day, e.ensemble, 'exp' AS model,
           exp(f.intercept + f.slope * ((e."TSOIL" - 273.15::DOUBLE - 10) / 10)) AS value
    FROM ens_wide e JOIN ({_EXP}) f USING (site_id)""")
def _m6(v):
    out = predict_models(v.ens_wide, _fits(v).where(F.col("model") == "exp"), unc_fac=0, noise=0)
    return out.select(*_VALUE)


@query("m6_exponential_prediction_seeded", f"""
    WITH p AS (SELECT e.site_id, f.slope * e."TSOIL" AS x FROM ens_wide e JOIN ({_EXP}) f USING (site_id))
    SELECT site_id, {_NOISE.format(v="x")} FROM p GROUP BY site_id""")
def _m6_seeded(v):
    sq = lambda c: c * c
    t10 = reduced_temperature_kelvin("TSOIL")
    return _seeded_against_point(
        v, "exp", sq(F.col("se_intercept")) + sq(F.col("se_t10") * t10) + sq(F.col("sigma")), F.ln
    )


def _tree_ctes(train: str, members: str, rounds: int) -> str:
    """Boosting as chained tables, ``boosted`` (site_id, day, ensemble, value) last. ``train`` has (site_id, t, w, flux),
    ``members`` (site_id, day, ensemble, t, w). Training rows and members go down each tree together."""
    out = [f"""bu0 AS MATERIALIZED (SELECT site_id, NULL::DATE AS day, NULL::VARCHAR AS ensemble, t, w, flux AS y, avg(flux) OVER (PARTITION BY site_id) AS f, 0 AS node FROM {train}
      UNION ALL SELECT m.site_id, day, ensemble, t, w, NULL, base, 0 FROM {members} m JOIN (SELECT site_id, avg(flux) AS base FROM {train} GROUP BY site_id) USING (site_id)
      WHERE t IS NOT NULL AND w IS NOT NULL)""",
           f"bc AS MATERIALIZED (SELECT DISTINCT site_id, 0 AS axis, t AS cut FROM {train} UNION SELECT DISTINCT site_id, 1, w FROM {train})"]
    k = 0
    for _ in range(rounds):
        for _ in range(3):
            out.append(f"""bs{k} AS MATERIALIZED (
      SELECT site_id, node, arg_min(axis, axis * 1000000 + place) AS axis, arg_min(cut, axis * 1000000 + place) AS cut FROM (
        SELECT *, max(gain) OVER (PARTITION BY site_id, node) AS best, rank() OVER (PARTITION BY site_id, node, axis ORDER BY cut) AS place FROM (
          SELECT site_id, node, axis, cut, gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) - g * g / (n + 1) AS gain FROM (
            SELECT u.site_id, node, axis, cut, count(*) AS n, sum(y - f) AS g, count(*) FILTER (CASE axis WHEN 0 THEN t ELSE w END < cut) AS nl,
              coalesce(sum(y - f) FILTER (CASE axis WHEN 0 THEN t ELSE w END < cut), 0) AS gl
            FROM bu{k} u JOIN bc USING (site_id) WHERE y IS NOT NULL GROUP BY u.site_id, node, axis, cut) WHERE nl > 0 AND nl < n))
      WHERE gain > 1e-6 AND gain >= best * (1 - 1e-9) GROUP BY site_id, node)""")
            out.append(f"""bu{k + 1} AS MATERIALIZED (SELECT u.* REPLACE (2 * node + CASE WHEN CASE axis WHEN 0 THEN t WHEN 1 THEN w END >= cut THEN 1 ELSE 0 END AS node)
      FROM bu{k} u LEFT JOIN bs{k} USING (site_id, node))""")
            k += 1
        out.append(f"""bu{k + 1} AS MATERIALIZED (SELECT u.* REPLACE (f + step AS f, 0 AS node)
      FROM bu{k} u JOIN (SELECT site_id, node, 0.1 * sum(y - f) / (count(*) + 1) AS step FROM bu{k} WHERE y IS NOT NULL GROUP BY ALL) USING (site_id, node))""")
        k += 1
    return ",\n    ".join([*out, f"boosted AS (SELECT site_id, day, ensemble, f AS value FROM bu{k} WHERE y IS NULL)"])


_TREE_ROUNDS = 3  # of queries whose trees are restated in SQL


@query("m7_boosted_values", f"""
    WITH c AS (SELECT *, count(*) OVER (PARTITION BY site_id) AS n FROM {_COMPLETE}),
    tr7 AS (SELECT site_id, tc AS t, "SOILW" AS w, flux FROM c WHERE n > 5),
    me7 AS (SELECT site_id, day, ensemble, "TSOIL" - 273.15::DOUBLE AS t, "SOILW" AS w FROM ens_wide),
    {_tree_ctes("tr7", "me7", _TREE_ROUNDS)},
    j AS (SELECT site_id FROM targets_day JOIN drivers_day USING (site_id, datetime) GROUP BY site_id HAVING count(*) > 5)
    SELECT e.site_id, e.day, e.ensemble, value FROM ens_wide e JOIN j USING (site_id)
    LEFT JOIN boosted b ON b.site_id = e.site_id AND b.day = e.day AND b.ensemble = e.ensemble""")
def _m7_values(v):
    return predict_boosted(celsius_training(_joined(v)), v.ens_wide, _TREE_ROUNDS, noise=0).select("site_id", "day", "ensemble", "value")


@query("m7_boosted_trees", f"""
    WITH j AS (SELECT site_id, count(*) AS rows FROM targets_day JOIN drivers_day USING (site_id, datetime) GROUP BY site_id),
    c AS (SELECT site_id, count(*) AS complete FROM {_COMPLETE} GROUP BY site_id)
    SELECT e.site_id, count(*) AS n,
           count(*) FILTER ("TSOIL" IS NULL OR "SOILW" IS NULL OR coalesce(complete, 0) <= 5) AS nulls,
           CASE WHEN count(*) FILTER ("TSOIL" IS NOT NULL AND "SOILW" IS NOT NULL AND complete > 5) > 0 THEN true END AS in_range,
           CASE WHEN max(complete) > 5 THEN true END AS fits_closer_than_mean
    FROM ens_wide e JOIN j USING (site_id) LEFT JOIN c USING (site_id) WHERE rows > 5 GROUP BY e.site_id""")
def _m7(v):
    """200 rounds at every site; values lie near the training fluxes and the fit is closer than their mean."""
    joined = settle(celsius_training(_joined(v)))
    models = fit_boosted(joined)
    values = predict_boosted(None, v.ens_wide, noise=0, models=models)
    spread = complete_cases(joined).groupBy("site_id").agg(
        F.min("flux").alias("lo"), F.max("flux").alias("hi"), F.stddev_samp("flux").alias("sd")
    ).join(models.select("site_id", "sigma"), "site_id")
    return values.join(spread, "site_id", "left").groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.bool_and(F.col("value").between(2 * F.col("lo") - F.col("hi"), 2 * F.col("hi") - F.col("lo"))).alias("in_range"),
        F.bool_and(F.col("sigma") < F.col("sd")).alias("fits_closer_than_mean"),
    )


@query("m8_ols_one_covariate", f"""
    WITH f AS ({_LINE.format(g="l_suppkey", x="x1", y="y", t="reg_big", more=0)})
    SELECT l_suppkey, n, sigma, '(Intercept)' AS term, intercept AS estimate, se_intercept AS std_error FROM f
    UNION ALL SELECT l_suppkey, n, sigma, 'x1', slope, se_slope FROM f""")
def _m8_one(v):
    return G.fit_many(v.reg_big, ["l_suppkey"], "y", ["x1"]).drop("ssr")


@query("m8_ols_two_covariates", f"""
    WITH f AS ({_PLANE.format(g="l_suppkey", x1="x1", x2="x2", y="y", t="reg_big")})
    SELECT l_suppkey, n, sigma, '(Intercept)' AS term, intercept AS estimate, se0 AS std_error FROM f
    UNION ALL SELECT l_suppkey, n, sigma, 'x1', b1, se1 FROM f
    UNION ALL SELECT l_suppkey, n, sigma, 'x2', b2, se2 FROM f""")
def _m8_two(v):
    return G.fit_many(v.reg_big, ["l_suppkey"], "y", ["x1", "x2"]).drop("ssr")


# Three covariates by Cramer's rule on centred moments.
_CUBE = """
    SELECT {g}, n, my - b1 * m1 - b2 * m2 - b3 * m3 AS intercept, b1, b2, b3, sqrt(ssr / (n - 1)) AS sigma,
           sqrt(s2 * (1.0 / n + (m1 * m1 * k11 + m2 * m2 * k22 + m3 * m3 * k33 + 2 * (m1 * m2 * k12 + m1 * m3 * k13 + m2 * m3 * k23)) / d)) AS se0,
           sqrt(s2 * k11 / d) AS se1, sqrt(s2 * k22 / d) AS se2, sqrt(s2 * k33 / d) AS se3
    FROM (SELECT *, ssr / (n - 4) AS s2
    FROM (SELECT *, syy - b1 * s1y - b2 * s2y - b3 * s3y AS ssr
    FROM (SELECT *, (k11 * s1y + k12 * s2y + k13 * s3y) / d AS b1, (k12 * s1y + k22 * s2y + k23 * s3y) / d AS b2,
                 (k13 * s1y + k23 * s2y + k33 * s3y) / d AS b3
    FROM (SELECT *, s11 * k11 + s12 * k12 + s13 * k13 AS d
    FROM (SELECT *, s22 * s33 - s23 * s23 AS k11, s13 * s23 - s12 * s33 AS k12, s12 * s23 - s13 * s22 AS k13,
                 s11 * s33 - s13 * s13 AS k22, s12 * s13 - s11 * s23 AS k23, s11 * s22 - s12 * s12 AS k33
    FROM (SELECT {g}, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({x3}) AS m3, avg({y}) AS my,
                 regr_sxx({y}, {x1}) AS s11, regr_sxx({y}, {x2}) AS s22, regr_sxx({y}, {x3}) AS s33, regr_syy({y}, {x1}) AS syy,
                 regr_sxy({x1}, {x2}) AS s12, regr_sxy({x1}, {x3}) AS s13, regr_sxy({x2}, {x3}) AS s23,
                 regr_sxy({y}, {x1}) AS s1y, regr_sxy({y}, {x2}) AS s2y, regr_sxy({y}, {x3}) AS s3y
          FROM {t} GROUP BY {g}))))))"""


@query("m8_ols_three_covariates", f"""
    WITH f AS ({_CUBE.format(g="l_suppkey", x1="x1", x2="x2", x3="x3", y="y", t="reg_big")})
    SELECT l_suppkey, n, sigma, '(Intercept)' AS term, intercept AS estimate, se0 AS std_error FROM f
    UNION ALL SELECT l_suppkey, n, sigma, 'x1', b1, se1 FROM f
    UNION ALL SELECT l_suppkey, n, sigma, 'x2', b2, se2 FROM f
    UNION ALL SELECT l_suppkey, n, sigma, 'x3', b3, se3 FROM f""")
def _m8_three(v):
    return G.fit_many(v.reg_big, ["l_suppkey"], "y", ["x1", "x2", "x3"]).drop("ssr")


@query("m9_custom_formula", """
    WITH r AS (SELECT site_id, flux, exp(-"TSOIL" / 50) AS x FROM targets_day JOIN drivers_day USING (site_id, datetime)
               WHERE flux IS NOT NULL AND "TSOIL" IS NOT NULL),
    m AS (SELECT site_id, count(*) AS n, NULLIF(regr_slope(flux, x), 'NaN'::DOUBLE) AS b, regr_intercept(flux, x) AS a,
                 regr_syy(flux, x) AS syy, regr_sxy(flux, x) AS sxy FROM r GROUP BY site_id)
    SELECT site_id, CASE WHEN b IS NOT NULL THEN round(a, 4) END AS a0, round(b, 4) AS a1, CASE WHEN b IS NOT NULL THEN round(greatest(syy - b * sxy, 0), 4) END AS ssr, n,
           CASE WHEN b IS NULL THEN 'singular' ELSE 'converged' END AS status FROM m""")
def _m9(v):
    """Linear in its parameters, so the closed form is known; slopes by differences leave about eight digits."""
    rows = _joined(v).select("site_id", "flux", (F.col("TSOIL") / 50).alias("TSOIL"))
    fit = fit_formula(rows, ["site_id"], "flux", "a0 + a1 * exp(-TSOIL)", ["a0", "a1"], {"a0": 40.0}).drop("iterations")
    return fit.withColumns({c: F.round(c, 4) for c in ("a0", "a1", "ssr")})


@query("m9_non_linear_formula", """
    SELECT l_suppkey, count(*) AS n, 'converged' AS status, true AS stationary FROM reg_big GROUP BY l_suppkey""")
def _m9_power(v):
    """At a least-squares solution the residuals are orthogonal to the slopes of every parameter."""
    rows = v.reg_big.select("l_suppkey", "y", (F.col("x1") / 50).alias("x"))
    fit = fit_formula(rows, ["l_suppkey"], "y", "a0 * exp(a1 * x)", ["a0", "a1"], {"a0": 10_000.0, "a1": 1.0})
    curve = F.exp(F.col("a1") * F.col("x"))
    r, slopes = F.col("y") - F.col("a0") * curve, [curve, F.col("a0") * F.col("x") * curve]
    flat = [F.abs(F.sum(r * j)) <= F.lit(1e-4) * F.sqrt(F.sum(r * r) * F.sum(j * j)) for j in slopes]
    return rows.join(fit.select("l_suppkey", "a0", "a1", "status"), "l_suppkey").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("status").alias("status"), (flat[0] & flat[1]).alias("stationary")
    )


@query("m10_deterministic_prediction", """
    WITH c AS (SELECT site_id, NULLIF(regr_intercept(flux, "TSOIL"), 'NaN'::DOUBLE) AS a, NULLIF(regr_slope(flux, "TSOIL"), 'NaN'::DOUBLE) AS b
               FROM targets_day JOIN drivers_day USING (site_id, datetime) GROUP BY site_id)
    SELECT e.ensemble AS parameter, CAST(e.datetime AS DATE) AS datetime, e.family, e.site_id, e.reference_datetime,
           c.a + c.b * e."TSOIL" AS prediction, 'flux' AS variable
    FROM ens_wide e JOIN c USING (site_id)""")
def _m10(v):
    from edaflux.operators.joins import attach_coefficients

    rows = _joined(v).select("site_id", "flux", "TSOIL").dropna()
    fit = G.fit_line(rows, ["site_id"], "flux", "TSOIL").select("site_id", "intercept", "slope")
    ready = attach_coefficients(v.ens_wide, fit)
    out = standard_prediction(ready, F.col("intercept") + F.col("slope") * F.col("TSOIL"), "flux")
    return out.withColumn("datetime", day_of("datetime"))


@query("m11_coefficient_table", f"""
    WITH f AS ({_PLANE.format(g="l_suppkey", x1="x1", x2="x2", y="y", t="reg_big")}),
    r AS (SELECT l_suppkey, '(Intercept)' AS term, intercept AS estimate, se0 AS std_error FROM f
          UNION ALL SELECT l_suppkey, 'x1', b1, se1 FROM f UNION ALL SELECT l_suppkey, 'x2', b2, se2 FROM f)
    SELECT *, estimate / std_error AS statistic FROM r""")
def _m11(v):
    return _coefficients(v).drop("p_value")


# Simpson's rule over the tail angle, the integrand relative to its largest value; P(|T| > t) of df degrees of freedom.
_TAIL = """
    CASE WHEN {t} IS NOT NULL AND {df} >= 1 THEN round(pow(1 + pow({t}, 2) / {df}, -({df} - 1) / 2.0)
      * (SELECT sum(CASE WHEN k IN (0, 6000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(({df} - 1) * ln(greatest(
             cos(atan2(1, abs({t}) / sqrt({df})) * k / 6000) - abs({t}) / sqrt({df}) * sin(atan2(1, abs({t}) / sqrt({df})) * k / 6000), 1e-300))))
         FROM range(0, 6001) AS r(k)) * atan2(1, abs({t}) / sqrt({df}))
      / (SELECT sum(CASE WHEN k IN (0, 6000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(({df} - 1) * ln(greatest(
             cos(pi() / 2 * k / 6000), 1e-300)))) FROM range(0, 6001) AS r(k)) / (pi() / 2), 6) END"""


@query("m11_p_values", f"""
    WITH f AS ({_PLANE.format(g="l_suppkey", x1="x1", x2="x2", y="y", t="reg_big")}),
    r AS (SELECT l_suppkey, n, '(Intercept)' AS term, intercept / se0 AS t FROM f
          UNION ALL SELECT l_suppkey, n, 'x1', b1 / se1 FROM f UNION ALL SELECT l_suppkey, n, 'x2', b2 / se2 FROM f)
    SELECT l_suppkey, term, {_TAIL.format(t="t", df="(n - 3)")} AS p_value FROM r""")
def _m11_p(v):
    return _coefficients(v).select("l_suppkey", "term", F.round("p_value", 6).alias("p_value"))


def _coefficients(v):
    fit = G.fit_plane(v.reg_big, ["l_suppkey"], "y", "x1", "x2")
    terms = {"(Intercept)": ("intercept", "se_intercept"), "x1": ("slope1", "se_slope1"), "x2": ("slope2", "se_slope2")}
    return G.coefficient_table(fit, ["l_suppkey"], terms, parameters=3)


@query("m12_training_rmse", """
    WITH f AS (SELECT l_suppkey, regr_intercept(y, x1) AS a, regr_slope(y, x1) AS b FROM reg_big GROUP BY l_suppkey)
    SELECT l_suppkey, count(*) AS n, sqrt(avg(pow(y - a - b * x1, 2))) AS rmse FROM reg_big JOIN f USING (l_suppkey)
    GROUP BY l_suppkey""")
def _m12(v):
    return G.training_rmse(G.fit_line(v.reg_big, ["l_suppkey"], "y", "x1"), ["l_suppkey"])


@query("m13_user_model", """
    SELECT site_id, day, ensemble, 1.5::DOUBLE + 0.1::DOUBLE * "TSOIL" - 0.02::DOUBLE * "SOILW" AS prediction FROM ens_wide""")
def _m13(v):
    def model(TSOIL, SOILW, uncertainty):
        return F.lit(1.5) + F.lit(0.1) * TSOIL - F.lit(0.02) * SOILW

    return apply_model(v.ens_wide, model).select("site_id", "day", "ensemble", "prediction")


@query("m12_fitted_values", """
    WITH f AS (SELECT site_id, NULLIF(regr_intercept(flux, "TSOIL"), 'NaN'::DOUBLE) AS a, NULLIF(regr_slope(flux, "TSOIL"), 'NaN'::DOUBLE) AS b
               FROM targets_day JOIN drivers_day USING (site_id, datetime) WHERE flux IS NOT NULL AND "TSOIL" IS NOT NULL
               GROUP BY site_id HAVING count(*) > 5)
    SELECT site_id, datetime, a + b * "TSOIL" AS fitted, flux - (a + b * "TSOIL") AS residual
    FROM targets_day JOIN drivers_day USING (site_id, datetime) JOIN f USING (site_id)""")
def _m12_fitted(v):
    joined = _joined(v)
    return with_fitted(joined, *fit_flux(joined, ["TSOIL"])).select("site_id", "datetime", "fitted", "residual")


@query("m13_user_model_seeded", f"""SELECT site_id, {_NOISE.format(v='"TSOIL"')} FROM ens_wide GROUP BY site_id""")
def _m13_seeded(v):
    def model(TSOIL):
        return F.lit(1.5) + F.lit(0.1) * TSOIL

    keys = ["site_id", "day", "ensemble"]
    out = apply_model(v.ens_wide, model, process_unc=0.3, seed=11, keys=keys)
    return _noise_check(out, (F.col("prediction") - model(F.col("TSOIL"))) / F.lit(0.3))


@query("m13_null_model", """
    SELECT site_id, day, ensemble, 'null' AS model, 0.598::DOUBLE + exp(0.044::DOUBLE * ("TSOIL" - 273.15::DOUBLE)) AS value
    FROM ens_wide""")
def _m13_null(v):
    return predict_null_model(v.ens_wide).select(*_VALUE)


def _training(v):
    """Observed days of January 2024 as three training periods: that month, the month and the year a run of 1 January uses."""
    def periods(df):
        shift = F.explode(F.array(F.lit(0), F.lit(_DAYS_TO_TRAINING_MONTH), F.lit(_DAYS_TO_YEAR_BEFORE)))
        return df.select("*", shift.alias("_days")).withColumn("datetime", F.date_sub("datetime", F.col("_days"))).drop("_days")

    return periods(v.targets_day), periods(v.drivers_day)


_PERIODS = f"""
    tr AS (SELECT site_id, datetime, flux, flux_err FROM targets_day
           UNION ALL SELECT site_id, datetime - {_DAYS_TO_TRAINING_MONTH}, flux, flux_err FROM targets_day
           UNION ALL SELECT site_id, datetime - {_DAYS_TO_YEAR_BEFORE}, flux, flux_err FROM targets_day),
    dr AS (SELECT * FROM drivers_day
           UNION ALL SELECT site_id, datetime - {_DAYS_TO_TRAINING_MONTH}, "PRES", "TSOIL", "SOILW", "WEASD", "SNOD", "ICETK" FROM drivers_day
           UNION ALL SELECT site_id, datetime - {_DAYS_TO_YEAR_BEFORE}, "PRES", "TSOIL", "SOILW", "WEASD", "SNOD", "ICETK" FROM drivers_day),
    jn AS (SELECT * FROM tr JOIN dr USING (site_id, datetime)),
    lm_rows AS (SELECT site_id, flux, "SOILW", "TSOIL" - 273.15::DOUBLE AS tc FROM jn
                WHERE flux_err IS NOT NULL AND "PRES" IS NOT NULL AND "TSOIL" IS NOT NULL AND "SOILW" IS NOT NULL
                  AND "WEASD" IS NOT NULL AND "SNOD" IS NOT NULL AND "ICETK" IS NOT NULL),
    lg AS (SELECT site_id, datetime, ln(flux) AS ln_flux, ("TSOIL" - 273.15::DOUBLE - 10) / 10 AS t10 FROM jn
           WHERE flux > 0 AND "TSOIL" IS NOT NULL),
    ex AS (SELECT * FROM lg WHERE year(datetime) = 2022),
    em AS (SELECT * FROM lg WHERE year(datetime) = 2023 AND month(datetime) = 11),
    vals AS (
        SELECT e.site_id, e.day, e.ensemble, 'lm' AS model, f.intercept + f.b1 * e."SOILW" + f.b2 * (e."TSOIL" - 273.15::DOUBLE) AS value
        FROM ens_wide e JOIN ({_PLANE.format(g="site_id", x1='"SOILW"', x2="tc", y="flux", t="lm_rows")}) f USING (site_id)
        UNION ALL
        SELECT e.site_id, e.day, e.ensemble, 'exp', exp(f.intercept + f.slope * ((e."TSOIL" - 273.15::DOUBLE - 10) / 10))
        FROM ens_wide e JOIN ({_LINE.format(g="site_id", x="t10", y="ln_flux", t="ex", more=2)}) f USING (site_id)
        UNION ALL
        SELECT e.site_id, e.day, e.ensemble, 'exp_month', exp(f.intercept + f.slope * ((e."TSOIL" - 273.15::DOUBLE - 10) / 10))
        FROM ens_wide e JOIN ({_LINE.format(g="site_id", x="t10", y="ln_flux", t="em", more=2)}) f USING (site_id)
        UNION ALL
        SELECT site_id, day, ensemble, 'null', 0.598::DOUBLE + exp(0.044::DOUBLE * ("TSOIL" - 273.15::DOUBLE)) FROM ens_wide),
    summary AS (
        SELECT site_id, model, day, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS q0025,
               quantile_cont(value, 0.1) AS q0100, quantile_cont(value, 0.5) AS q0500, quantile_cont(value, 0.9) AS q0900,
               quantile_cont(value, 0.975) AS q0975
        FROM vals GROUP BY site_id, model, day)"""


_BOTH = """flux IS NOT NULL AND flux_err IS NOT NULL AND "PRES" IS NOT NULL AND "TSOIL" IS NOT NULL AND "SOILW" IS NOT NULL
             AND "WEASD" IS NOT NULL AND "SNOD" IS NOT NULL AND "ICETK" IS NOT NULL"""
_MONTH_ROWS = f"""
    mj AS (SELECT site_id, count(*) AS rows, count(*) FILTER ({_BOTH}) AS complete
           FROM jn WHERE year(datetime) = 2023 AND month(datetime) = 11 GROUP BY site_id)"""
# The trees of few rounds, summarised beside the other models.
_TREES = f"""{_MONTH_ROWS},
    tr7 AS (SELECT site_id, "TSOIL" - 273.15::DOUBLE AS t, "SOILW" AS w, flux FROM jn JOIN mj USING (site_id)
            WHERE year(datetime) = 2023 AND month(datetime) = 11 AND complete > 5 AND rows > 5 AND {_BOTH}),
    me7 AS (SELECT site_id, day, ensemble, "TSOIL" - 273.15::DOUBLE AS t, "SOILW" AS w FROM ens_wide),
    {_tree_ctes("tr7", "me7", _TREE_ROUNDS)},
    tvals AS (SELECT e.site_id, e.day, e.ensemble, 'xgboost' AS model, value FROM ens_wide e JOIN mj ON mj.site_id = e.site_id AND rows > 5
              LEFT JOIN boosted b ON b.site_id = e.site_id AND b.day = e.day AND b.ensemble = e.ensemble),
    all_vals AS (SELECT * FROM vals UNION ALL BY NAME SELECT * FROM tvals),
    all_summary AS (
        SELECT site_id, model, day, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS q0025,
               quantile_cont(value, 0.1) AS q0100, quantile_cont(value, 0.5) AS q0500, quantile_cont(value, 0.9) AS q0900,
               quantile_cont(value, 0.975) AS q0975
        FROM all_vals GROUP BY site_id, model, day)"""
# What is known of seeded forecasts: which rows there are, and of which sites and models.
_SEEDED_ROWS = f"""{_MONTH_ROWS},
    sv AS (SELECT site_id, model, day, count(value) AS n FROM vals WHERE model <> 'null' GROUP BY ALL
           UNION ALL SELECT e.site_id, 'xgboost', e.day, CASE WHEN max(complete) > 5 THEN count(*) FILTER ("TSOIL" IS NOT NULL AND "SOILW" IS NOT NULL) ELSE 0 END
           FROM ens_wide e JOIN mj USING (site_id) WHERE rows > 5 GROUP BY e.site_id, e.day),
    known AS (SELECT *, CASE WHEN n > 0 THEN true END AS ascending, CASE WHEN n > 0 THEN true END AS mean_ok,
                CASE WHEN n > 1 THEN true END AS sd_ok, CASE WHEN sum(n) OVER (PARTITION BY site_id, model) > 1 THEN true END AS noise_ok FROM sv)"""


@query("m14_daily_forecast", f"""
    WITH {_PERIODS}, {_TREES} SELECT * FROM all_summary WHERE day = DATE '2024-01-01'""")
def _m14(v):
    targets, drivers = _training(v)
    return daily_forecast(
        v.ens_wide, targets, drivers, "2024-01-01", unc_fac=0, noise=0, include_null=True, reference_date=RUN_DATE, boosted_rounds=_TREE_ROUNDS
    )


@query("m15_horizon_forecast", f"""
    WITH {_PERIODS}, {_TREES},
    pairs AS (
        SELECT a.site_id, a.model, a.day, avg(abs(a.value - b.value)) AS spread FROM all_vals a
        JOIN all_vals b ON a.site_id = b.site_id AND a.model = b.model AND a.day = b.day
        WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL),
    dist AS (SELECT e.site_id, e.model, e.day, avg(abs(e.value - t.flux)) AS d FROM all_vals e
             JOIN tr t ON e.site_id = t.site_id AND e.day = t.datetime WHERE e.value IS NOT NULL GROUP BY ALL)
    SELECT s.*, CAST(s.day - DATE '2024-01-01' AS INTEGER) AS horizon, d.d - p.spread / 2 AS crps
    FROM all_summary s JOIN tr t ON s.site_id = t.site_id AND s.day = t.datetime
    LEFT JOIN dist d ON s.site_id = d.site_id AND s.model = d.model AND s.day = d.day
    LEFT JOIN pairs p ON s.site_id = p.site_id AND s.model = p.model AND s.day = p.day""")
def _m15(v):
    targets, drivers = _training(v)
    return horizon_forecast(v.ens_wide, targets, drivers, "2024-01-01", unc_fac=0, noise=0, include_null=True, boosted_rounds=_TREE_ROUNDS)


def _seeded_values(v):
    """Every row of a seeded forecast of all 200 rounds, and whether its noise is standard normal by site and model.

    A regression draws for each row; the trees draw one residual for each site.
    """
    targets, drivers = _training(v)
    fits = fit_forecast(targets, drivers, F.lit(RUN_DATE).cast("date"))
    keys = ["site_id", "reference_datetime", "ensemble", "datetime", "model"]
    seeded = settle(predict_forecast(v.ens_wide, fits, seed=11).withColumn("day", day_of("datetime")))
    point = predict_forecast(v.ens_wide, fits, unc_fac=0, noise=0).withColumnRenamed("value", "point")
    scales = fits.coefficients.unionByName(fits.trees.select("site_id", F.lit("xgboost").alias("model"), "sigma"), allowMissingColumns=True)
    rows = seeded.join(point, keys).join(scales, ["site_id", "model"]).join(v.ens_wide.select(*keys[:-1], "TSOIL", "SOILW"), keys[:-1])
    square = lambda c: c * c
    of_lm = square(F.col("se_soilw") * F.col("SOILW")) + square(F.col("se_tsoil") * kelvin_to_celsius("TSOIL"))
    of_exp = square(F.col("se_t10") * reduced_temperature_kelvin("TSOIL"))
    tree, linear = F.col("model") == "xgboost", F.col("model").isin("lm", "xgboost")
    scale = F.sqrt(square(F.col("sigma")) + F.when(tree, 0.0).otherwise(square(F.col("se_intercept")) + F.when(linear, of_lm).otherwise(of_exp)))
    z = F.when(linear, F.col("value") - F.col("point")).otherwise(F.ln("value") - F.ln("point")) / scale
    n, root = F.count(z), F.sqrt(F.count(z).cast("double"))
    normal = (F.abs(F.avg(z)) <= 5.0 / root) & (F.abs(F.stddev_samp(z) - 1) <= 5.0 / F.sqrt(2 * (n - 1).cast("double"))) & (F.count_distinct(z) == n)
    once = (F.max(z) - F.min(z) < 1e-6) & (F.abs(F.avg(z)).between(1e-6, 5.0))
    noise = rows.groupBy("site_id", "model").agg(F.when(n > 1, F.when(F.first("model") == "xgboost", once).otherwise(normal)).alias("noise_ok"))
    return seeded, noise


def _seeded_summary(seeded, noise, summary, extra=()):
    """A summary against plain aggregates of the seeded rows."""
    plain = seeded.groupBy("site_id", "model", "day").agg(F.count("value").alias("n"), F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"))
    q = [F.col(c) for c in QUANTILES]
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * (1 + F.abs(F.col(b)))
    return summary.join(plain, ["site_id", "model", "day"]).join(noise, ["site_id", "model"]).select(
        "site_id", "model", "day", ((q[0] <= q[1]) & (q[1] <= q[2]) & (q[2] <= q[3]) & (q[3] <= q[4])).alias("ascending"),
        close("mean", "_mean").alias("mean_ok"), close("sd", "_sd").alias("sd_ok"), "noise_ok", *extra,
    )


@query("m14_daily_forecast_seeded", f"""
    WITH {_PERIODS}, {_SEEDED_ROWS} SELECT * EXCLUDE (n) FROM known WHERE day = DATE '2024-01-01'""")
def _m14_seeded(v):
    """All four models with noise and 200 rounds: rows, mean, sd and the noise itself."""
    targets, drivers = _training(v)
    return _seeded_summary(*_seeded_values(v), daily_forecast(v.ens_wide, targets, drivers, "2024-01-01", seed=11, reference_date=RUN_DATE))


@query("m15_horizon_forecast_seeded", f"""
    WITH {_PERIODS}, {_SEEDED_ROWS}
    SELECT k.* EXCLUDE (n), CAST(k.day - DATE '2024-01-01' AS INTEGER) AS horizon, CASE WHEN n > 0 THEN true END AS crps_ok
    FROM known k JOIN tr t ON k.site_id = t.site_id AND k.day = t.datetime""")
def _m15_seeded(v):
    """As m14; the CRPS lies below the mean distance from the observation by half the mean difference of two members,
    which is at most sd / sqrt(3)."""
    targets, drivers = _training(v)
    scored = horizon_forecast(v.ens_wide, targets, drivers, "2024-01-01", seed=11)
    values, noise = _seeded_values(v)
    flux = targets.select("site_id", F.col("datetime").alias("day"), "flux")
    far = values.join(flux, ["site_id", "day"]).groupBy("site_id", "model", "day").agg(F.avg(F.abs(F.col("value") - F.col("flux"))).alias("_far"))
    inside = (F.col("crps") <= F.col("_far") * (1 + 1e-9)) & (F.col("crps") >= F.col("_far") - F.coalesce("sd", F.lit(0.0)) / 3**0.5 - 1e-9) & (F.col("crps") >= -1e-9)
    return _seeded_summary(values, noise, scored.join(far, ["site_id", "model", "day"]).withColumn("crps_ok", inside), ["horizon", "crps_ok"])


@query("m_overflowing_site", """
    WITH v AS (SELECT site_id, day, exp("TSOIL" * 0.01::DOUBLE) AS x FROM ens_wide WHERE site_id <> '3')
    SELECT site_id, day, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.025) AS q0025, quantile_cont(x, 0.1) AS q0100,
           quantile_cont(x, 0.5) AS q0500, quantile_cont(x, 0.9) AS q0900, quantile_cont(x, 0.975) AS q0975
    FROM v GROUP BY site_id, day
    UNION ALL SELECT site_id, day, CASE WHEN count("TSOIL") > 0 THEN 'inf'::DOUBLE END, NULL,
      quantile_cont(big, 0.025), quantile_cont(big, 0.1), quantile_cont(big, 0.5), quantile_cont(big, 0.9), quantile_cont(big, 0.975)
    FROM (SELECT *, CASE WHEN "TSOIL" IS NOT NULL THEN 'inf'::DOUBLE END AS big FROM ens_wide WHERE site_id = '3') GROUP BY site_id, day""")
def _overflow(v):
    """A site whose exponent overflows has infinite quantiles and no sd; the other sites are as ever."""
    steep = F.when(F.col("site_id") == "3", 1e4).otherwise(0.01)
    base = F.when(F.col("site_id") == "3", F.greatest("TSOIL", F.lit(1.0))).otherwise(F.col("TSOIL"))
    values = v.ens_wide.select("site_id", "day", F.when(F.col("TSOIL").isNotNull(), F.exp(base * steep)).alias("value"))
    return ensemble_summary(values, ["site_id", "day"]).select("site_id", "day", "mean", "sd", *QUANTILES)


@query("m_flagship_null_forecast", """
    SELECT site_id, day, avg(f) AS mean, stddev_samp(f) AS sd, quantile_cont(f, 0.025) AS q0025, quantile_cont(f, 0.1) AS q0100,
           quantile_cont(f, 0.5) AS q0500, quantile_cont(f, 0.9) AS q0900, quantile_cont(f, 0.975) AS q0975
    FROM (SELECT site_id, day, 0.598::DOUBLE + exp(0.044::DOUBLE * ("TSOIL" - 273.15::DOUBLE)) AS f FROM ens_wide)
    GROUP BY site_id, day""")
def flagship(v):
    """The forecast distribution per site and day under the null model."""
    return ensemble_summary(predict_null_model(v.ens_wide), ["site_id", "day"]).select(
        "site_id", "day", "mean", "sd", *QUANTILES
    )
