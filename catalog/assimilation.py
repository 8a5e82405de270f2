"""Data assimilation (K1-K2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.models import _NOISE, _noise_check
from catalog.registry import query
from edaflux.operators.assimilate import assimilate_forecast, kalman_update
from edaflux.operators.evaluate import observations_in_span, spanned, with_intervals


def _observations(v):
    return v.obs.where(F.col("event_type") == "error").groupBy("site_id", "day").agg(F.avg("value").alias("observation"))


def _members(v):
    return v.obs.where(F.col("event_type") != "error").select("event_id", "site_id", "day", F.col("value").alias("prediction"))


@query("k1_kalman_update", """
    WITH y AS (SELECT site_id, day, avg(value) AS y FROM obs WHERE event_type = 'error' GROUP BY ALL),
    x AS (SELECT event_id, site_id, day, value, var_samp(value) OVER (PARTITION BY site_id, day) AS p FROM obs
          WHERE event_type <> 'error')
    SELECT event_id, CASE WHEN y IS NULL OR p IS NULL THEN value ELSE value + p / (p + 4.0) * (y - value) END AS prediction
    FROM x LEFT JOIN y ON x.site_id = y.site_id AND x.day = y.day""")
def _k1(v):
    out = kalman_update(_members(v), _observations(v), ["site_id", "day"], ic_sd=2.0, perturb=0)
    return out.select("event_id", "prediction")


@query("k1_kalman_update_seeded", f"""
    WITH y AS (SELECT site_id, day, avg(value) AS y FROM obs WHERE event_type = 'error' GROUP BY ALL),
    x AS (SELECT site_id, day, var_samp(value) OVER (PARTITION BY site_id, day) AS p FROM obs WHERE event_type <> 'error')
    SELECT x.site_id, {_NOISE.format(v="(CASE WHEN p > 0 THEN y END)")} FROM x LEFT JOIN y ON x.site_id = y.site_id AND x.day = y.day GROUP BY x.site_id""")
def _k1_seeded(v):
    """What the perturbation adds, by the gain and the sd it should have."""
    keys = ["site_id", "day"]
    calm = kalman_update(_members(v), _observations(v), keys, ic_sd=2.0, perturb=0).withColumnRenamed("prediction", "calm")
    moved = kalman_update(_members(v), _observations(v), keys, ic_sd=2.0, seed=11, member_keys=["site_id", "day", "event_id"])
    spread = _members(v).groupBy(*keys).agg(F.var_samp("prediction").alias("p")).join(_observations(v), keys, "left")
    rows = moved.join(calm, ["event_id", *keys]).join(spread, keys)
    gain = F.col("p") / (F.col("p") + 4)
    z = F.when((F.col("p") > 0) & F.col("observation").isNotNull(), (F.col("prediction") - F.col("calm")) / (gain * 2))
    return _noise_check(rows, z)


_ASSIMILATED = """
    WITH span AS (SELECT CAST(date_trunc('week', min(datetime)) AS DATE) AS s, max(datetime) AS e FROM forecast_long),
    starts AS (SELECT unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL {step} DAY)) AS a, e FROM span),
    spans AS (SELECT a, a + INTERVAL {length} DAY AS b, row_number() OVER (ORDER BY a) AS k FROM starts
              WHERE a + INTERVAL {length} DAY <= e),
    dates AS (SELECT datetime, min(k) AS k FROM (SELECT DISTINCT datetime FROM forecast_long UNION SELECT datetime FROM challenge) d
              JOIN spans ON d.datetime BETWEEN a AND b GROUP BY datetime),
    fx AS (SELECT f.*, k, var_samp(prediction) OVER (PARTITION BY site_id, variable, k) AS p FROM forecast_long f JOIN dates USING (datetime)),
    tg AS (SELECT site_id, variable, k, avg(observation) AS y FROM challenge JOIN dates USING (datetime) GROUP BY ALL)
    SELECT fx.site_id, fx.variable, fx.parameter, fx.datetime,
           CASE WHEN y IS NULL OR p IS NULL THEN prediction ELSE prediction + p / (p + 9.0) * (y - prediction) END AS prediction
    FROM fx LEFT JOIN tg ON fx.site_id = tg.site_id AND fx.variable = tg.variable AND fx.k = tg.k"""
_OUT = ("site_id", "variable", "parameter", "datetime", "prediction")


@query("k2_assimilate_forecast", _ASSIMILATED.format(step=1, length=1))
def _k2(v):
    return assimilate_forecast(v.forecast_long, v.challenge, "P1D", ic_sd=3.0, perturb=0).select(*_OUT)


@query("k2_assimilate_forecast_weekly", _ASSIMILATED.format(step=7, length=14))
def _k2_weekly(v):
    return assimilate_forecast(v.forecast_long, v.challenge, "P1W", ic_sd=3.0, perturb=0).select(*_OUT)


@query("k2_assimilate_forecast_seeded", f"""
    {_ASSIMILATED.format(step=1, length=1).replace("CASE WHEN y IS NULL OR p IS NULL THEN prediction ELSE prediction + p / (p + 9.0) * (y - prediction) END AS prediction", "y, p")
    .replace("SELECT fx.site_id, fx.variable, fx.parameter, fx.datetime,", "SELECT fx.variable, fx.parameter, fx.site_id,", 1)
    .replace("    SELECT fx.variable", "    , z AS (SELECT fx.variable", 1)})
    SELECT variable, {_NOISE.format(v="(CASE WHEN p > 0 THEN y END)")} FROM z GROUP BY variable""")
def _k2_seeded(v):
    keys = ["site_id", "variable", "parameter", "datetime"]
    forecast, span = spanned(v.forecast_long)
    placed = with_intervals(forecast, span, "P1D")
    seen = observations_in_span(v.challenge, span, "P1D").groupBy("site_id", "variable", "interval_id").agg(F.count("observation").alias("seen"))
    spread = placed.groupBy("site_id", "variable", "interval_id").agg(F.var_samp("prediction").alias("p"))
    of = placed.select(*keys, "interval_id").join(spread, ["site_id", "variable", "interval_id"]).join(seen, ["site_id", "variable", "interval_id"], "left")
    calm = assimilate_forecast(v.forecast_long, v.challenge, "P1D", ic_sd=3.0, perturb=0).select(*keys, F.col("prediction").alias("calm"))
    moved = assimilate_forecast(v.forecast_long, v.challenge, "P1D", ic_sd=3.0, seed=11).select(*keys, "prediction")
    rows = moved.join(calm, keys).join(of, keys)
    z = (F.col("prediction") - F.col("calm")) / (F.col("p") / (F.col("p") + 9) * 3)
    return _noise_check(rows, F.when((F.col("p") > 0) & (F.col("seen") > 0), z), ("variable",))
