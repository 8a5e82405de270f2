"""Joins (J1-J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from edaflux.functions.dates import next_evaluation
from edaflux.operators import joins as J
from edaflux.operators.aggregate import group_means
from edaflux.operators.evaluate import forecast_statistics, observations_in_span, spanned, with_intervals
from edaflux.operators.regression import fit_line


@query("j1_targets_with_drivers", """
    SELECT site_id, datetime, flux, flux_err, "TSOIL", "SOILW" FROM targets_day JOIN drivers_day USING (site_id, datetime)""")
def _j1(v):
    return J.pair_training_rows(v.targets_day, v.drivers_day.select("site_id", "datetime", "TSOIL", "SOILW"))


@query("j2_ensemble_with_coefficients", """
    WITH c AS (SELECT site_id, NULLIF(regr_intercept(flux, "TSOIL"), 'NaN'::DOUBLE) AS intercept,
                      NULLIF(regr_slope(flux, "TSOIL"), 'NaN'::DOUBLE) AS slope
               FROM targets_day JOIN drivers_day USING (site_id, datetime)
               WHERE flux IS NOT NULL AND "TSOIL" IS NOT NULL GROUP BY site_id)
    SELECT site_id, day, ensemble, "TSOIL", intercept, slope FROM ens_wide JOIN c USING (site_id)""")
def _j2(v):
    joined = J.pair_training_rows(v.targets_day, v.drivers_day).select("site_id", "flux", "TSOIL").dropna()
    fit = fit_line(joined, ["site_id"], "flux", "TSOIL").select("site_id", "intercept", "slope")
    return J.attach_coefficients(v.ens_wide.select("site_id", "day", "ensemble", "TSOIL"), fit)


_SIDE = """SELECT site_id, date_trunc('hour', ts) AS hour, avg(value) AS {name} FROM obs WHERE variable = '{name}'
           GROUP BY site_id, date_trunc('hour', ts)"""


@query("j3_temperature_with_water", f"""
    WITH a AS ({_SIDE.format(name="TSOIL")}), b AS ({_SIDE.format(name="SOILW")})
    SELECT coalesce(a.site_id, b.site_id) AS site_id,
           (epoch_us(coalesce(a.hour, b.hour)) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS hour,
           a."TSOIL" AS "TSOIL", b."SOILW" AS "SOILW"
    FROM a FULL JOIN b ON a.site_id = b.site_id AND a.hour = b.hour""")
def _j3(v):
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    hour = F.floor((F.unix_seconds("ts") - start) / 3600).alias("hour")

    def side(name):
        return v.obs.where(F.col("variable") == name).groupBy("site_id", hour).agg(F.avg("value").alias(name))

    return J.full_pair(side("TSOIL"), side("SOILW"), ["site_id", "hour"])


@query("j4_sensor_with_weather", """
    WITH s AS (SELECT day, variable, avg(value) AS sensor FROM obs WHERE variable IN ('TSOIL', 'SOILW') AND event_id % 2 = 0 GROUP BY ALL),
         w AS (SELECT day, variable, avg(value) AS weather FROM obs WHERE variable IN ('TSOIL', 'WEASD') AND event_id % 2 = 1 GROUP BY ALL)
    SELECT s.day, s.variable, s.sensor, w.weather FROM s LEFT JOIN w USING (day, variable)""")
def _j4(v):
    def side(names, odd, value):
        rows = v.obs.where(F.col("variable").isin(names) & (F.col("event_id") % 2 == odd))
        return rows.groupBy("day", "variable").agg(F.avg("value").alias(value))

    return J.left_pair(side(["TSOIL", "SOILW"], 0, "sensor"), side(["TSOIL", "WEASD"], 1, "weather"), ["day", "variable"])


@query("j5_ensemble_days_with_targets", """
    SELECT s.site_id, s.datetime, s.mean, t.flux FROM tsoil_summary s JOIN targets_day t USING (site_id, datetime)""")
def _j5(v):
    daily = group_means(
        v.ens_wide.select("site_id", F.col("day").alias("datetime"), F.col("TSOIL").alias("mean")), ["site_id", "datetime"], ["mean"]
    )
    return J.pair_training_rows(daily, v.targets_day.select("site_id", "datetime", "flux"))


_PLACED = """
    span AS (SELECT CAST(date_trunc('week', min(datetime)) AS DATE) AS s, max(datetime) AS e FROM forecast_long),
    fx AS (SELECT f.*, CAST(greatest(1, datetime - s) AS BIGINT) AS k FROM forecast_long f, span
           WHERE greatest(1, datetime - s) <= e - s),
    tg AS (SELECT c.*, CAST(greatest(1, datetime - s) AS BIGINT) AS k FROM challenge c, span
           WHERE datetime BETWEEN s AND e AND greatest(1, datetime - s) <= e - s AND observation IS NOT NULL)"""


@query("j6_summaries_with_observations", f"""
    WITH {_PLACED},
    q AS (SELECT site_id, variable, k, avg(prediction) AS mean FROM fx GROUP BY site_id, variable, k)
    SELECT q.site_id, q.variable, tg.datetime, q.mean, tg.observation
    FROM q JOIN tg ON q.site_id = tg.site_id AND q.variable = tg.variable AND q.k = tg.k""")
def _j6(v):
    out = forecast_statistics(v.forecast_long, v.challenge, "P1D")
    return out.select("site_id", "variable", "datetime", "mean", "observation")


@query("j7_forecast_with_observations", f"""
    WITH {_PLACED},
    o AS (SELECT site_id, variable, k, avg(observation) AS observation FROM tg GROUP BY site_id, variable, k)
    SELECT fx.site_id, fx.variable, fx.datetime, fx.parameter, fx.prediction, o.observation
    FROM fx LEFT JOIN o ON fx.site_id = o.site_id AND fx.variable = o.variable AND fx.k = o.k""")
def _j7(v):
    keys = ["site_id", "variable", "interval_id"]
    forecast, span = spanned(v.forecast_long)
    observed = observations_in_span(v.challenge, span, "P1D").groupBy(*keys).agg(F.avg("observation").alias("observation"))
    out = J.left_pair(with_intervals(forecast, span, "P1D"), observed, keys)
    return out.select("site_id", "variable", "datetime", "parameter", "prediction", "observation")


@query("j8_site_metadata", """
    WITH m AS (SELECT site_id, avg(flux) AS flux FROM monthly GROUP BY site_id)
    SELECT s.field_site_id, s.field_latitude, s.phenocam_vegetation, m.flux
    FROM site_meta s JOIN m ON s.field_site_id = m.site_id WHERE s.terrestrial = 1""")
def _j8(v):
    means = group_means(v.monthly, ["site_id"], ["flux"])
    out = J.with_site_metadata(means, v.site_meta.where(F.col("terrestrial") == 1))
    return out.select("field_site_id", "field_latitude", "phenocam_vegetation", "flux")


@query("j9_next_observation", """
    WITH s AS (SELECT site_id, variable, datetime, datetime + 1 AS next_eval, observation AS before FROM challenge)
    SELECT s.site_id, s.variable, s.next_eval, s.datetime AS origin, s.before, c.observation
    FROM s JOIN challenge c ON s.site_id = c.site_id AND s.variable = c.variable AND s.next_eval = c.datetime""")
def _j9(v):
    stats = v.challenge.select(
        "site_id", "variable", F.col("datetime").alias("origin"), next_evaluation("datetime", "duration").alias("next_eval"),
        F.col("observation").alias("before"),
    )
    return J.next_observation(stats, v.challenge)


@query("j10_training_with_evaluation", """
    WITH g AS (SELECT site_id, count(*) AS n FROM targets_day JOIN drivers_day USING (site_id, datetime) GROUP BY site_id
               HAVING count(*) > 5)
    SELECT e.site_id, e.day, e.ensemble, g.n FROM ens_wide e JOIN g USING (site_id)""")
def _j10(v):
    from edaflux.operators.aggregate import group_counts
    from edaflux.operators.filters import groups_larger_than

    groups = groups_larger_than(group_counts(J.pair_training_rows(v.targets_day, v.drivers_day), ["site_id"]), 5)
    return J.attach_coefficients(v.ens_wide.select("site_id", "day", "ensemble"), groups)


@query("j11_driver_target_scatter", """
    WITH x AS (SELECT site_id, day AS datetime, avg(value) AS value FROM obs WHERE variable = 'PRES' GROUP BY site_id, day)
    SELECT site_id, datetime, x.value, c.observation FROM x JOIN challenge c USING (site_id, datetime)
    WHERE c.variable = 'TSOIL'""")
def _j11(v):
    drivers = v.obs.groupBy("site_id", F.col("day").alias("datetime"), "variable").agg(F.avg("value").alias("value"))
    return J.driver_target_scatter(drivers, v.challenge, "PRES", "TSOIL")


