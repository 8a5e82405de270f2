"""Evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.models import _CUBE, _TAIL
from catalog.registry import query
from edaflux.operators import evaluate as E
from edaflux.operators.regression import regression_diagnostics
from edaflux.plans.hindcast import cycle_reliability, forecast_cycle, hindcast
from edaflux.schemas import QUANTILES


@query("e1_sample_crps", """
    WITH m AS (SELECT site_id, day AS datetime, "TSOIL" AS x FROM ens_wide WHERE "TSOIL" IS NOT NULL),
    s AS (SELECT a.site_id, a.datetime, avg(abs(a.x - b.x)) AS spread FROM m a
          JOIN m b ON a.site_id = b.site_id AND a.datetime = b.datetime GROUP BY ALL),
    d AS (SELECT m.site_id, m.datetime, avg(abs(m.x - t.flux)) AS dist FROM m JOIN targets_day t USING (site_id, datetime) GROUP BY ALL)
    SELECT site_id, datetime, dist - spread / 2 AS crps FROM d JOIN s USING (site_id, datetime)""")
def _e1(v):
    members = v.ens_wide.select("site_id", F.col("day").alias("datetime"), F.col("TSOIL").alias("value"))
    return E.sample_crps(members, ["site_id", "datetime"], "value", v.targets_day)


@query("e1_sample_crps_large_groups", """
    WITH m AS (SELECT site_id, variable, value AS x FROM obs),
    y AS (SELECT site_id, variable, max(value) / 2 AS flux FROM obs GROUP BY ALL),
    s AS (SELECT a.site_id, a.variable, avg(abs(a.x - b.x)) AS spread FROM m a
          JOIN m b ON a.site_id = b.site_id AND a.variable = b.variable GROUP BY ALL),
    d AS (SELECT m.site_id, m.variable, avg(abs(m.x - y.flux)) AS dist FROM m JOIN y USING (site_id, variable) GROUP BY ALL)
    SELECT site_id, variable, dist - spread / 2 AS crps FROM d JOIN s USING (site_id, variable)""")
def _e1_large(v):
    observed = v.obs.groupBy("site_id", "variable").agg((F.max("value") / 2).alias("flux"))
    return E.sample_crps(v.obs, ["site_id", "variable"], "value", observed)


@query("e2_absolute_error", """
    SELECT site_id, datetime, abs(mean - flux) AS abs_err FROM forecast_scored""")
def _e2(v):
    return E.with_absolute_error(v.forecast_scored(), obs="flux").select("site_id", "datetime", "abs_err")


# DuckDB's corr is NaN where it is undefined.
_R = "NULLIF(corr({r}, {m}), 'NaN'::DOUBLE)"
_TAYLOR = """1.0::DOUBLE AS sd_meas, stddev_samp({m}) / NULLIF(stddev_samp({r}), 0) AS sd, """ + _R + """ AS r,
           stddev_samp({r} - {m}) / NULLIF(stddev_samp({r}), 0) AS centered_rms,
           stddev_samp({m}) / NULLIF(stddev_samp({r}), 0) * """ + _R + """ AS x_coord,
           CASE WHEN """ + _R + """ IS NOT NULL THEN
             stddev_samp({m}) / NULLIF(stddev_samp({r}), 0) * sqrt(greatest(1 - pow(""" + _R + """, 2), 0)) END AS y_coord"""


@query("e3_taylor_forecast", f"""
    SELECT site_id, {_TAYLOR.format(m="q0500", r="flux")} FROM forecast_scored
    WHERE q0500 IS NOT NULL AND flux IS NOT NULL GROUP BY site_id""")
def _e3(v):
    return E.taylor_statistics(v.forecast_scored(), ["site_id"], "flux", "q0500")


_PAIRED = """
    s AS (SELECT site_id, day, variable, avg(value) AS sensor FROM obs WHERE variable IN ('TSOIL', 'SOILW') AND event_id % 2 = 0 GROUP BY ALL),
    w AS (SELECT site_id, day, variable, avg(value) AS weather FROM obs WHERE variable IN ('TSOIL', 'SOILW') AND event_id % 2 = 1 GROUP BY ALL)"""


def _side(v, odd, name):
    rows = v.obs.where(F.col("variable").isin("TSOIL", "SOILW") & (F.col("event_id") % 2 == odd))
    return rows.groupBy("site_id", "day", "variable").agg(F.avg("value").alias(name))


@query("e4_taylor_sensor", f"""
    WITH {_PAIRED}
    SELECT site_id, '2024-01' AS month, variable AS name, {_TAYLOR.format(m="sensor", r="weather")}
    FROM (SELECT site_id, variable, CASE WHEN weather IS NOT NULL THEN sensor END AS sensor, weather
          FROM s LEFT JOIN w USING (site_id, day, variable)) GROUP BY site_id, variable""")
def _e4(v):
    return E.sensor_model_taylor(_side(v, 0, "sensor"), _side(v, 1, "weather"), "2024-01")


@query("e5_coverage", """
    SELECT avg(CAST(flux BETWEEN q0025 AND q0975 AS DOUBLE)) AS within_true,
           avg(CAST(NOT (flux BETWEEN q0025 AND q0975) AS DOUBLE)) AS within_false FROM forecast_scored""")
def _e5(v):
    return E.coverage(v.forecast_scored())


@query("e6_coverage_percent_by_site", """
    SELECT site_id, avg(CAST(flux BETWEEN q0025 AND q0975 AS DOUBLE)) * 100 AS within_true,
           avg(CAST(NOT (flux BETWEEN q0025 AND q0975) AS DOUBLE)) * 100 AS within_false FROM forecast_scored GROUP BY site_id""")
def _e6(v):
    return E.coverage(v.forecast_scored(), ["site_id"], scale=100.0)


@query("e7_coverage_80", """
    SELECT site_id, avg(CAST(flux BETWEEN q0100 AND q0900 AS DOUBLE)) AS coverage_80 FROM forecast_scored GROUP BY site_id""")
def _e7(v):
    return E.coverage_80(v.forecast_scored(), ["site_id"])


@query("e8_regression_diagnostics", """
    WITH m AS (SELECT site_id, count(*) AS n, regr_sxx(q0500, flux) AS sxx, regr_syy(q0500, flux) AS syy,
                      regr_sxy(q0500, flux) AS sxy
               FROM forecast_scored WHERE q0500 IS NOT NULL AND flux IS NOT NULL GROUP BY site_id),
    f AS (SELECT *, sxy / sxx AS slope, syy - sxy / sxx * sxy AS ssr FROM m WHERE n > 2 AND sxx > 0),
    l AS (SELECT *, -n / 2.0::DOUBLE * (ln(2 * pi()) + ln(ssr / n) + 1) AS loglik, 1 - ssr / syy AS r_squared FROM f)
    SELECT g.site_id, r_squared, 1 - (1 - r_squared) * (n - 1) / (n - 2) AS adj_r_squared, sqrt(ssr / (n - 2)) AS sigma,
           (syy - ssr) / (ssr / (n - 2)) AS statistic, CASE WHEN n IS NOT NULL THEN 1.0::DOUBLE END AS df, loglik, 6 - 2 * loglik AS aic,
           3 * ln(n) - 2 * loglik AS bic, ssr AS deviance, n - 2 AS df_residual, n AS nobs, slope
    FROM (SELECT DISTINCT site_id FROM forecast_scored) g LEFT JOIN l USING (site_id)""")
def _e8(v):
    return regression_diagnostics(v.forecast_scored(), ["site_id"]).drop("p_value")


@query("e8_regression_p_values", f"""
    WITH m AS (SELECT site_id, count(*) AS n, regr_sxx(q0500, flux) AS sxx, regr_syy(q0500, flux) AS syy, regr_sxy(q0500, flux) AS sxy
               FROM forecast_scored WHERE q0500 IS NOT NULL AND flux IS NOT NULL GROUP BY site_id),
    f AS (SELECT site_id, n, sqrt((sxy / sxx * sxy) / ((syy - sxy / sxx * sxy) / (n - 2))) AS t FROM m WHERE n > 2 AND sxx > 0)
    SELECT g.site_id, {_TAIL.format(t="t", df="(n - 2)")} AS p_value
    FROM (SELECT DISTINCT site_id FROM forecast_scored) g LEFT JOIN f USING (site_id)""")
def _e8_p(v):
    return regression_diagnostics(v.forecast_scored(), ["site_id"]).select("site_id", F.round("p_value", 6).alias("p_value"))


_SPANS = """
    span AS (SELECT CAST(date_trunc('week', min(datetime)) AS DATE) AS s, max(datetime) AS e FROM forecast_long),
    starts AS (SELECT unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL {step} DAY)) AS a, e FROM span),
    spans AS (SELECT a, a + INTERVAL {length} DAY AS b, row_number() OVER (ORDER BY a) AS k FROM starts
              WHERE a + INTERVAL {length} DAY <= e),
    dates AS (SELECT datetime, min(k) AS k FROM (SELECT DISTINCT datetime FROM forecast_long UNION SELECT datetime FROM challenge) d
              JOIN spans ON d.datetime BETWEEN a AND b GROUP BY datetime),
    q AS (SELECT f.site_id, f.variable, k, min(f.reference_datetime) AS reference_datetime, avg(prediction) AS mean,
                 stddev_samp(prediction) AS sd, quantile_cont(prediction, 0.025) AS q0025, quantile_cont(prediction, 0.1) AS q0100,
                 quantile_cont(prediction, 0.5) AS q0500, quantile_cont(prediction, 0.9) AS q0900,
                 quantile_cont(prediction, 0.975) AS q0975
          FROM forecast_long f JOIN dates USING (datetime) GROUP BY f.site_id, f.variable, k)"""
_STATS = """
    SELECT q.site_id, c.datetime, c.observation, q.reference_datetime, q.variable, mean, sd, q0025, q0100, q0500, q0900, q0975,
           abs(mean - observation) AS abs_err
    FROM q JOIN (SELECT challenge.*, k FROM challenge JOIN dates USING (datetime)) c
      ON q.site_id = c.site_id AND q.variable = c.variable AND q.k = c.k"""


@query("e9_forecast_statistics", f"WITH {_SPANS.format(step=1, length=1)} {_STATS}")
def _e9(v):
    return E.forecast_statistics(v.forecast_long, v.challenge, "P1D")


@query("e9_forecast_statistics_weekly", f"WITH {_SPANS.format(step=7, length=14)} {_STATS}")
def _e9_weekly(v):
    return E.forecast_statistics(v.forecast_long, v.challenge, "P1W")


_CYCLE = """
    runs AS (SELECT site_id, ensemble, family, datetime, reference_datetime,
                    max(NULLIF(prediction, 9999.0)) FILTER (variable = 'TSOIL') AS t,
                    max(NULLIF(prediction, 9999.0)) FILTER (variable = 'SOILW') AS w
             FROM ens_runs WHERE variable IN ('TSOIL', 'SOILW') GROUP BY ALL),
    p AS (SELECT c.site_id, c.variable, c.datetime + 1 AS next_eval, 1.5::DOUBLE + 0.1::DOUBLE * t - 0.02::DOUBLE * coalesce(w, 0) AS x
          FROM challenge c JOIN runs r ON r.site_id = c.site_id AND r.reference_datetime = c.datetime - 1
           AND r.datetime = c.datetime + 1
          WHERE c.observation IS NOT NULL),
    stats AS (SELECT site_id, variable, next_eval, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.025) AS q0025,
                     quantile_cont(x, 0.1) AS q0100, quantile_cont(x, 0.5) AS q0500, quantile_cont(x, 0.9) AS q0900,
                     quantile_cont(x, 0.975) AS q0975
              FROM p GROUP BY site_id, variable, next_eval),
    cycle AS (SELECT s.site_id, s.variable, s.next_eval AS datetime, mean, sd, q0025, q0100, q0500, q0900, q0975, c.observation,
                     abs(mean - c.observation) AS abs_err
              FROM stats s JOIN challenge c ON s.site_id = c.site_id AND s.variable = c.variable AND s.next_eval = c.datetime)"""


def _cycle(v):
    def model(TSOIL, SOILW):
        return F.lit(1.5) + F.lit(0.1) * TSOIL - F.lit(0.02) * F.coalesce(SOILW, F.lit(0.0))

    return forecast_cycle(v.challenge, v.ens_runs, model, ["TSOIL", "SOILW"])


@query("e10_forecast_cycle", f"WITH {_CYCLE} SELECT * FROM cycle")
def _e10(v):
    return _cycle(v).select("site_id", "variable", "datetime", "mean", "sd", *QUANTILES, "observation", "abs_err")


@query("e10_cycle_reliability", f"""
    WITH {_CYCLE}
    SELECT site_id, avg(CAST(observation BETWEEN q0025 AND q0975 AS DOUBLE)) * 100 AS within_true,
           avg(CAST(NOT (observation BETWEEN q0025 AND q0975) AS DOUBLE)) * 100 AS within_false
    FROM cycle GROUP BY site_id""")
def _e10_reliability(v):
    return cycle_reliability(_cycle(v))


_HINDCAST = """
    f AS (SELECT site_id, my - b * mx AS a, b FROM (
            SELECT site_id, avg(flux) AS my, avg("TSOIL") AS mx, NULLIF(regr_slope(flux, "TSOIL"), 'NaN'::DOUBLE) AS b
            FROM targets_day JOIN drivers_day USING (site_id, datetime)
            WHERE flux IS NOT NULL AND "TSOIL" IS NOT NULL AND datetime < DATE '2024-01-15' GROUP BY site_id HAVING count(*) > 5)),
    m AS (SELECT site_id, day AS datetime, a + b * "TSOIL" AS x FROM ens_wide JOIN f USING (site_id)),
    """
_SCORED = """
    ev AS (SELECT * FROM targets_day WHERE datetime >= DATE '2024-01-15'),
    s AS (SELECT site_id, datetime, avg(x) AS mean, stddev_samp(x) AS sd, quantile_cont(x, 0.025) AS q0025,
                 quantile_cont(x, 0.1) AS q0100, quantile_cont(x, 0.5) AS q0500, quantile_cont(x, 0.9) AS q0900,
                 quantile_cont(x, 0.975) AS q0975 FROM m GROUP BY site_id, datetime),
    sp AS (SELECT u.site_id, u.datetime, avg(abs(u.x - w.x)) AS spread FROM m u
           JOIN m w ON u.site_id = w.site_id AND u.datetime = w.datetime WHERE u.x IS NOT NULL AND w.x IS NOT NULL GROUP BY ALL),
    di AS (SELECT m.site_id, m.datetime, avg(abs(m.x - ev.flux)) AS dist FROM m JOIN ev USING (site_id, datetime)
           WHERE x IS NOT NULL GROUP BY ALL),
    hc AS (SELECT s.*, ev.flux, di.dist - sp.spread / 2 AS crps, ev.flux BETWEEN q0100 AND q0900 AS within_80
           FROM s JOIN ev USING (site_id, datetime) LEFT JOIN di USING (site_id, datetime) LEFT JOIN sp USING (site_id, datetime))"""


def _hindcast(v, covariates=("TSOIL",), **model):
    split = F.lit("2024-01-15").cast("date")
    return hindcast(
        v.targets_day.where(F.col("datetime") < split), v.drivers_day.where(F.col("datetime") < split), v.ens_wide,
        v.targets_day.where(F.col("datetime") >= split), covariates, **model,
    )


_THREE = f"""
    tr AS (SELECT site_id, flux, "TSOIL" AS x1, "SOILW" AS x2, "PRES" AS x3 FROM targets_day JOIN drivers_day USING (site_id, datetime)
           WHERE flux IS NOT NULL AND "TSOIL" IS NOT NULL AND "SOILW" IS NOT NULL AND "PRES" IS NOT NULL AND datetime < DATE '2024-01-15'),
    f AS ({_CUBE.format(g="site_id", x1="x1", x2="x2", x3="x3", y="flux", t="tr")}),
    m AS (SELECT site_id, day AS datetime, intercept + b1 * "TSOIL" + b2 * "SOILW" + b3 * "PRES" AS x
          FROM ens_wide JOIN f USING (site_id) WHERE n > 5),
    """
_CURVE = """
    f AS (SELECT site_id, regr_intercept(flux, exp(-"TSOIL" / 50)) AS a, regr_slope(flux, exp(-"TSOIL" / 50)) AS b
          FROM targets_day JOIN drivers_day USING (site_id, datetime)
          WHERE flux IS NOT NULL AND "TSOIL" IS NOT NULL AND datetime < DATE '2024-01-15' GROUP BY site_id HAVING count(*) > 5),
    m AS (SELECT site_id, day AS datetime, a + b * exp(-"TSOIL" / 50) AS x FROM ens_wide JOIN f USING (site_id)),
    """


@query("e11_hindcast_three_covariates", f"WITH {_THREE} {_SCORED} SELECT * FROM hc")
def _e11_three(v):
    return _hindcast(v, ["TSOIL", "SOILW", "PRES"])


_NUMBERS = ("mean", "sd", *QUANTILES, "crps")


@query("e11_hindcast_formula", f"""
    WITH {_CURVE} {_SCORED} SELECT site_id, datetime, flux, within_80, {", ".join(f"round({c}, 2) AS {c}" for c in _NUMBERS)} FROM hc""")
def _e11_formula(v):
    """Fitted by iteration, so printed to the digits that do not depend on where it stops."""
    out = _hindcast(v, ["TSOIL"], formula="a0 + a1 * exp(-TSOIL / 50)", parameters=["a0", "a1"], start={"a0": 40.0})
    return out.withColumns({c: F.round(c, 2) for c in _NUMBERS})


@query("e11_hindcast", f"WITH {_HINDCAST} {_SCORED} SELECT * FROM hc")
def _e11(v):
    return _hindcast(v)


@query("e11_hindcast_coverage", f"""
    WITH {_HINDCAST} {_SCORED} SELECT avg(CAST(within_80 AS DOUBLE)) AS coverage_80, avg(crps) AS crps FROM hc""")
def _e11_coverage(v):
    return _hindcast(v).agg(
        F.avg(F.col("within_80").cast("double")).alias("coverage_80"), F.avg("crps").alias("crps")
    )


@query("e12_driver_agreement", f"""
    WITH {_PAIRED}
    SELECT * EXCLUDE (sd_meas) FROM (
      SELECT site_id, variable, avg(weather - sensor) AS bias, count(*) AS n, {_TAYLOR.format(m="sensor", r="weather")}
      FROM s JOIN w USING (site_id, day, variable) GROUP BY site_id, variable)""")
def _e12(v):
    return E.driver_agreement(_side(v, 0, "sensor").join(_side(v, 1, "weather"), ["site_id", "day", "variable"]))


