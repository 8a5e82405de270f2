"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from edaflux.functions.dates import training_month, training_year
from edaflux.operators import aggregate as A
from edaflux.operators.regression import fit_line
from edaflux.plans.targets import build_flux_month, build_sensor_month, sensor_means

_ENV = '"PRES", "TSOIL", "SOILW", "WEASD", "SNOD", "ICETK"'
_QUANTILES = """quantile_cont({c}, 0.025) AS q0025, quantile_cont({c}, 0.1) AS q0100, quantile_cont({c}, 0.5) AS q0500,
           quantile_cont({c}, 0.9) AS q0900, quantile_cont({c}, 0.975) AS q0975"""


@query("a1_daily_driver_means", """
    SELECT site_id, day AS datetime, avg("PRES") AS "PRES", avg("TSOIL") AS "TSOIL", avg("SOILW") AS "SOILW",
           avg("WEASD") AS "WEASD", avg("SNOD") AS "SNOD", avg("ICETK") AS "ICETK"
    FROM ens_wide GROUP BY site_id, day""")
def _a1(v):
    return A.daily_drivers(v.ens_wide)


@query("a2_weighted_mean", """
    SELECT site_id, day, sum(flux / (flux_err * flux_err)) / sum(CASE WHEN flux IS NOT NULL THEN 1 / (flux_err * flux_err) END) AS flux,
           sqrt(1 / sum(CASE WHEN flux IS NOT NULL THEN 1 / (flux_err * flux_err) END)) AS flux_err
    FROM half_hour GROUP BY site_id, day""")
def _a2(v):
    return A.weighted_mean(v.half_hour, ["site_id", "day"])


# Methods at a position, positions at a time, then gaps by position in the series.
GAP_FILL_SQL = """
    w AS (SELECT *, CASE WHEN flux IS NOT NULL THEN 1 / (flux_err * flux_err) END AS w FROM half_hour),
    p AS (SELECT site_id, startDateTime, horizontalPosition, sum(w * flux) / sum(w) AS flux, sqrt(1 / sum(w)) AS err
          FROM w GROUP BY ALL),
    pw AS (SELECT *, CASE WHEN flux IS NOT NULL THEN 1 / (err * err) END AS w FROM p),
    t AS (SELECT site_id, startDateTime, sum(w * flux) / sum(w) AS flux, sqrt(1 / sum(w)) AS flux_err FROM pw GROUP BY ALL),
    i AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY startDateTime) AS i FROM t),
    b AS (SELECT *,
            max(CASE WHEN flux IS NOT NULL THEN i END) OVER (PARTITION BY site_id ORDER BY i) AS lo,
            min(CASE WHEN flux IS NOT NULL THEN i END) OVER (PARTITION BY site_id ORDER BY i DESC) AS hi
          FROM i),
    g AS (SELECT b.site_id, b.startDateTime,
            CASE WHEN b.flux IS NOT NULL THEN b.flux
                 ELSE x.flux + (y.flux - x.flux) * (b.i - b.lo) / (b.hi - b.lo) END AS flux,
            CASE WHEN b.flux_err IS NOT NULL THEN b.flux_err
                 ELSE x.flux_err + (y.flux_err - x.flux_err) * (b.i - b.lo) / (b.hi - b.lo) END AS flux_err
          FROM b LEFT JOIN i x ON x.site_id = b.site_id AND x.i = b.lo LEFT JOIN i y ON y.site_id = b.site_id AND y.i = b.hi)"""


@query("a3_daily_flux", f"""
    WITH {GAP_FILL_SQL}
    SELECT site_id, CAST(startDateTime AS DATE) AS "startDateTime", sum(flux * 0.02161926::DOUBLE) AS flux,
           sqrt(sum(pow(flux_err * 0.02161926::DOUBLE, 2))) AS flux_err
    FROM g GROUP BY site_id, CAST(startDateTime AS DATE)""")
def _a3(v):
    return build_flux_month(v.half_hour)


@query("a4_ensemble_summary", f"""
    SELECT site_id, day, avg("TSOIL") AS mean, stddev_samp("TSOIL") AS sd, {_QUANTILES.format(c='"TSOIL"')}
    FROM ens_wide GROUP BY site_id, day""")
def _a4(v):
    return A.ensemble_summary(v.ens_wide, ["site_id", "day"], "TSOIL")


@query("a4_summary_of_all_members", f"""
    SELECT site_id, variable, avg(NULLIF(prediction, 9999.0)) AS mean, stddev_samp(NULLIF(prediction, 9999.0)) AS sd,
           {_QUANTILES.format(c="NULLIF(prediction, 9999.0)")}
    FROM ens_long GROUP BY site_id, variable""")
def _a4_raw(v):
    """Groups here grow with the events table."""
    from edaflux.functions.scalars import sentinel_to_null

    return A.ensemble_summary(
        v.ens_long.withColumn("prediction", sentinel_to_null("prediction")), ["site_id", "variable"], "prediction"
    )


@query("a5_column_quantiles", """
    SELECT day, 'TSOIL' AS variable, quantile_cont("TSOIL", 0.1) AS q10, quantile_cont("TSOIL", 0.5) AS q50,
           quantile_cont("TSOIL", 0.9) AS q90 FROM ens_wide WHERE "TSOIL" IS NOT NULL GROUP BY day
    UNION ALL
    SELECT day, 'SOILW', quantile_cont("SOILW", 0.1), quantile_cont("SOILW", 0.5), quantile_cont("SOILW", 0.9)
    FROM ens_wide WHERE "SOILW" IS NOT NULL GROUP BY day""")
def _a5(v):
    return A.column_quantiles(v.ens_wide, ["day"], ["TSOIL", "SOILW"])


@query("a6_sensor_position_means", """
    SELECT site_id, CAST(startDateTime AS DATE) AS day, avg(value) AS "SOILT" FROM sensor
    WHERE verticalPosition = '501' AND QF = 0 AND hour(startDateTime) = 0 AND minute(startDateTime) = 0
    GROUP BY site_id, startDateTime""")
def _a6(v):
    return sensor_means(v.sensor, "value", "SOILT").select("site_id", F.to_date("startDateTime").alias("day"), "SOILT")


@query("a6_sensor_month", """
    WITH k AS (SELECT site_id, CAST(startDateTime AS DATE) AS day, value, event_id % 3 AS third FROM sensor
               WHERE verticalPosition = '501' AND QF = 0 AND hour(startDateTime) = 0 AND minute(startDateTime) = 0),
         w AS (SELECT site_id, CAST(startDateTime AS DATE) AS day, avg(value) AS "VSWC" FROM sensor
               WHERE verticalPosition = '501' AND QF = 0 AND hour(startDateTime) = 0 AND minute(startDateTime) = 0
                 AND variable IN ('SOILW', 'PRES') GROUP BY ALL),
         t AS (SELECT site_id, day, avg(value) AS "SOILT" FROM k GROUP BY ALL)
    SELECT site_id, day, "SOILT", "VSWC" FROM t FULL JOIN w USING (site_id, day)""")
def _a6_month(v):
    water = v.sensor.where(F.col("variable").isin("SOILW", "PRES"))
    out = build_sensor_month(v.sensor, water)
    return out.select("site_id", F.to_date("startDateTime").alias("day"), "SOILT", "VSWC")


@query("a7_monthly_mean_flux", """
    SELECT site_id, strftime(datetime, '%Y-%m') AS month, avg(flux) AS flux FROM monthly GROUP BY ALL""")
def _a7(v):
    from edaflux.functions.dates import month_label

    return A.group_means(v.monthly.withColumn("month", month_label("datetime")), ["site_id", "month"], ["flux"])


@query("a8_daily_means", """
    SELECT day, horizontalPosition AS "horizontalPosition", avg(value) AS value FROM sensor WHERE verticalPosition = '501'
    GROUP BY day, horizontalPosition""")
def _a8(v):
    rows = v.sensor.where(F.col("verticalPosition") == "501")
    return A.group_means(rows, ["day", "horizontalPosition"], ["value"])


@query("a9_earliest_time", """
    SELECT site_id, datetime, year(datetime) = 2023 AND month(datetime) = 11 AS in_training_month
    FROM targets_day""")
def _a9(v):
    """The run's first time picks the training month: 1 January 2024 trains on November 2023, exp on 2022."""
    first = training_month(F.to_date(A.earliest(v.ens_long)))
    expected_year = training_year(F.to_date(A.earliest(v.ens_long))) == 2022
    return v.targets_day.select(
        "site_id", "datetime",
        ((F.trunc("datetime", "month") == first) & expected_year).alias("in_training_month"),
    )


@query("a10_distinct", "SELECT DISTINCT variable FROM obs")
def _a10(v):
    return A.distinct_values(v.obs, "variable")


@query("a11_group_counts", "SELECT site_id, variable, count(*) AS n FROM obs GROUP BY site_id, variable")
def _a11(v):
    return A.group_counts(v.obs, ["site_id", "variable"])


@query("a12_residual_sd", """
    SELECT l_suppkey, sqrt((regr_syy(y, x1) - regr_slope(y, x1) * regr_sxy(y, x1)) / (count(*) - 1)) AS sigma
    FROM reg_big GROUP BY l_suppkey""")
def _a12(v):
    return fit_line(v.reg_big, ["l_suppkey"], "y", "x1").select("l_suppkey", "sigma")
