"""Scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from edaflux.operators.aggregate import ensemble_summary
from edaflux.schemas import CHALLENGE_CSV, FORECAST_DAILY, FORECAST_HORIZON, QUANTILE_FILE_NAMES
from edaflux.session import shared_folder
from edaflux.sources.challenge import get_forecast_data
from edaflux.sources.ensemble import (
    gefs_soil_forecasts,
    month_of_drivers,
    noaa_mean_historical,
    noaa_soil_drivers,
    previous_run,
)
from edaflux.sources.observations import (
    consolidate_flux_month,
    consolidate_sensor_month,
    download_values,
    drivers_available,
    in_month_list,
    in_period,
    read_csv,
    targets_available,
)
from edaflux.sources.sinks import (
    submission,
    submission_problems,
    write_daily_forecasts,
    write_horizon_forecasts,
    write_month_of_drivers,
    write_month_of_targets,
    write_named_files,
)

_WIDE = """
       max(NULLIF(prediction, 9999.0)) FILTER (variable = 'PRES') AS "PRES",
       max(NULLIF(prediction, 9999.0)) FILTER (variable = 'TSOIL') AS "TSOIL",
       max(NULLIF(prediction, 9999.0)) FILTER (variable = 'SOILW') AS "SOILW",
       max(NULLIF(prediction, 9999.0)) FILTER (variable = 'WEASD') AS "WEASD",
       max(NULLIF(prediction, 9999.0)) FILTER (variable = 'SNOD') AS "SNOD",
       max(NULLIF(prediction, 9999.0)) FILTER (variable = 'ICETK') AS "ICETK" """
_IN_ENV = "variable IN ('PRES', 'TSOIL', 'SOILW', 'WEASD', 'SNOD', 'ICETK')"


def _folder(v, name):
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def _targets_files(v):
    """Monthly target files of seven years with missing errors, and a file of another layout among them."""
    folder = _folder(v, "targets")
    error = F.when(F.col("row_id") % 5 != 0, F.lit(1.5))
    write_month_of_targets(v.monthly.select(
        "site_id", F.col("datetime").cast("timestamp").alias("startDateTime"), "flux", error.alias("flux_err")), folder)
    write_named_files(v.spark.range(1).select("id"), folder, F.lit("readme-of-targets"))
    return folder


_TARGET_ROWS = """
    SELECT site_id, CAST(datetime AS TIMESTAMP) AS datetime, flux, CASE WHEN row_id % 5 <> 0 THEN 1.5::DOUBLE END AS flux_err FROM monthly"""


@query("s1_download_values_year", f"{_TARGET_ROWS} WHERE datetime >= DATE '1997-01-01' AND datetime < DATE '1998-01-01'")
def _s1_year(v):
    return download_values(v.spark, _targets_files(v), "targets", 1997)


@query("s1_download_values_month", f"{_TARGET_ROWS} WHERE datetime >= DATE '1997-12-01' AND datetime < DATE '1998-01-01'")
def _s1_month(v):
    return download_values(v.spark, _targets_files(v), "targets", "1997", 12)


@query("s2_targets_available_months", f"{_TARGET_ROWS} WHERE strftime(datetime, '%Y-%m') IN ('1996-02', '1997-11')")
def _s2_months(v):
    return targets_available(v.spark, _targets_files(v), ["1996-02", "1997-11"])


@query("s1_in_period", """
    SELECT row_id, site_id, datetime, flux FROM monthly WHERE datetime >= DATE '1997-12-01' AND datetime < DATE '1998-01-01'""")
def _s1_period(v):
    return in_period(v.monthly, 1997, 12)


@query("s2_in_month_list", """
    SELECT row_id, site_id, datetime, flux FROM monthly WHERE strftime(datetime, '%Y-%m') IN ('1996-02', '1999-11')""")
def _s2_list(v):
    return in_month_list(v.monthly, ["1996-02", "1999-11"])


_SHIFTED = """
    SELECT site_id, CAST(datetime + s AS TIMESTAMP) AS datetime, "PRES", "TSOIL", "SOILW", "WEASD", "SNOD", "ICETK"
    FROM drivers_day, (VALUES (0), (40), (366)) AS t(s)"""


def _drivers_files(v):
    folder = _folder(v, "drivers")
    shifted = v.drivers_day.withColumn("_s", F.explode(F.array(F.lit(0), F.lit(40), F.lit(366))))
    dated = shifted.withColumn("datetime", F.date_add("datetime", F.col("_s")).cast("timestamp")).drop("_s")
    write_month_of_drivers(dated, folder)
    return folder


@query("s2_targets_available", """
    SELECT site_id, CAST(datetime AS TIMESTAMP) AS datetime, flux, flux_err FROM targets_day""")
def _s2(v):
    """All files, without a list of months."""
    folder = _folder(v, "targets")
    write_month_of_targets(v.targets_day.select("site_id", F.col("datetime").cast("timestamp").alias("startDateTime"), "flux", "flux_err"), folder)
    return targets_available(v.spark, folder)


@query("s3_drivers_available", f"WITH d AS ({_SHIFTED}) SELECT * FROM d WHERE strftime(datetime, '%Y-%m') IN ('2024-01', '2025-01')")
def _s3(v):
    return drivers_available(v.spark, _drivers_files(v), ["2024-01", "2025-01"])


@query("s9_monthly_drivers", f"WITH d AS ({_SHIFTED}) SELECT * FROM d WHERE datetime >= TIMESTAMP '2024-02-01' AND datetime < TIMESTAMP '2024-03-01'")
def _s9_monthly(v):
    """Written as monthly files, one month read back."""
    return download_values(v.spark, _drivers_files(v), "drivers", 2024, 2)


@query("s9_rerun", f"""
    SELECT site_id, datetime, flux * CASE WHEN year(datetime) = 1997 AND month(datetime) > 6 THEN 9 ELSE 1 END AS flux, flux_err
    FROM ({_TARGET_ROWS}) WHERE datetime >= DATE '1997-01-01' AND datetime < DATE '1998-01-01'""")
def _s9_rerun(v):
    """Half a year of monthly files written again with other values: those replace the first ones, month by month."""
    folder = _targets_files(v)
    again = in_period(v.monthly, 1997).where(F.month("datetime") > 6)
    error = F.when(F.col("row_id") % 5 != 0, F.lit(1.5))
    write_month_of_targets(again.select(
        "site_id", F.col("datetime").cast("timestamp").alias("startDateTime"), (F.col("flux") * 9).alias("flux"), error.alias("flux_err")), folder)
    return download_values(v.spark, folder, "targets", 1997)


@query("s10_consolidated_rerun", """
    SELECT site_id, CAST(datetime AS TIMESTAMP) AS datetime, flux, flux_err FROM targets_day WHERE site_id IN ('1', '2', '3')""")
def _s10_rerun(v):
    """A month consolidated from the files of two sites, and again when the third site's file has come."""
    files, months = _folder(v, "fluxes"), _folder(v, "consolidated")
    rows = v.targets_day.select("site_id", F.col("datetime").cast("timestamp").alias("startDateTime"), "flux", "flux_err")
    for sites in (("1", "2"), ("3",)):
        write_named_files(rows.where(F.col("site_id").isin(*sites)), files, F.concat(F.lit("forecast_prediction-"), F.col("site_id"), F.lit("-2024-01")))
        write_month_of_targets(consolidate_flux_month(v.spark, files, "2024-01"), months)
    return targets_available(v.spark, months, ["2024-01"])


@query("s4_gefs_soil_forecasts", f"""
    SELECT reference_datetime, site_id, ensemble, family, horizon, datetime, {_WIDE}
    FROM ens_runs WHERE reference_datetime = DATE '2024-01-10' AND {_IN_ENV} AND site_id IN ('1', '2', '7')
    GROUP BY reference_datetime, site_id, ensemble, family, horizon, datetime""")
def _s4(v):
    return gefs_soil_forecasts(v.ens_runs.drop("day", "value"), "2024-01-10", ["1", "2", "7"])


@query("s4_noaa_soil_drivers", f"""
    SELECT reference_datetime, site_id, ensemble, family, horizon, datetime, {_WIDE}
    FROM ens_runs WHERE reference_datetime = DATE '2024-01-12' AND {_IN_ENV}
      AND site_id IN (SELECT field_site_id FROM site_meta WHERE terrestrial = 1)
    GROUP BY reference_datetime, site_id, ensemble, family, horizon, datetime""")
def _s4_sites(v):
    return noaa_soil_drivers(v.ens_runs.drop("day", "value"), v.site_meta, "2024-01-12")


@query("s5_site_metadata", """
    SELECT field_site_id, field_latitude, field_longitude FROM site_meta WHERE terrestrial = 1""")
def _s5(v):
    from edaflux.sources.ensemble import terrestrial_sites

    return terrestrial_sites(v.site_meta)


@query("s6_get_forecast_data", """
    SELECT project_id, site_id, datetime, duration, CASE variable WHEN 'TSOIL' THEN 'nee' ELSE 'oxygen' END AS variable, observation
    FROM challenge WHERE datetime BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND site_id IN ('0', '3', '4')""")
def _s6(v):
    """Two datasets as gzipped CSV, each with variables nobody asked for."""
    paths = {}
    for dataset, own, name in (("fluxes", "TSOIL", "nee"), ("aquatics", "SOILW", "oxygen")):
        rows = v.challenge.where(F.col("variable") == own)
        both = rows.withColumn("variable", F.explode(F.array(F.lit(name), F.lit("le" if own == "TSOIL" else "chla"))))
        paths[dataset] = _folder(v, dataset)
        both.select(*CHALLENGE_CSV.names).write.option("header", True).option("nullValue", "NA").option("compression", "gzip").csv(paths[dataset])
    return get_forecast_data(v.spark, paths, "2024-01-05", "2024-01-20", ["nee", "oxygen"], ["0", "3", "4"])


@query("s7_get_forecast_noaa", """
    SELECT e.site_id, o.origin, o.duration, e.reference_datetime, e.ensemble, e.family, e.datetime,
           max(NULLIF(e.prediction, 9999.0)) FILTER (e.variable = 'TSOIL') AS "TSOIL",
           max(NULLIF(e.prediction, 9999.0)) FILTER (e.variable = 'SOILW') AS "SOILW"
    FROM ens_runs e
    JOIN (SELECT DISTINCT site_id, datetime AS origin, duration FROM challenge) o
      ON e.site_id = o.site_id AND e.reference_datetime = o.origin - 1
    WHERE e.variable IN ('TSOIL', 'SOILW') AND e.datetime >= o.origin AND e.datetime <= o.origin + 1
    GROUP BY ALL""")
def _s7(v):
    origins = v.challenge.select("site_id", F.col("datetime").alias("origin"), "duration")
    return previous_run(v.ens_runs, origins, ["TSOIL", "SOILW"])


@query("s8_noaa_mean_historical", """
    SELECT site_id, day + 336 AS datetime, variable AS noaa, avg(prediction) AS value FROM ens_long
    WHERE site_id IN ('2', '5') AND day + 336 <= DATE '2024-12-31' GROUP BY site_id, day, variable""")
def _s8(v):
    """Days moved so that the last of them is 31 December, whose hours all count."""
    moved = v.ens_long.withColumn("datetime", F.col("datetime") + F.expr("INTERVAL 336 DAYS"))
    return noaa_mean_historical(moved, ["2", "5"], 2024)


@query("s9_csv_sink", """
    SELECT site_id, 'tsoil' AS model, datetime AS day, mean, sd, q0025, q0100, q0500, q0900, q0975 FROM tsoil_summary""")
def _s9(v):
    """Written as dated CSV and read back with the file's own schema."""
    members = v.ens_wide.select("site_id", F.lit("tsoil").alias("model"), "day", F.col("TSOIL").alias("value"))
    summary = ensemble_summary(members, ["site_id", "model", "day"])
    folder = f"{shared_folder(v.spark)}/daily-{uuid.uuid4().hex}"
    write_daily_forecasts(summary, folder)
    back = v.spark.read.schema(FORECAST_DAILY).option("header", True).option("nullValue", "NA").option("enforceSchema", True)
    return back.csv(folder).select(*FORECAST_DAILY.names)


@query("s9_horizon_sink", """
    SELECT site_id, 'tsoil' AS model, datetime AS day, CAST(datetime - DATE '2024-01-01' AS INTEGER) AS horizon, mean, sd,
           q0025, q0100, q0500, q0900, q0975, CASE WHEN day(datetime) % 3 <> 0 THEN mean / 2 END AS crps
    FROM tsoil_summary""")
def _s9_horizon(v):
    """Written as month-end files and read back with the file's own schema."""
    members = v.ens_wide.select("site_id", F.lit("tsoil").alias("model"), "day", F.col("TSOIL").alias("value"))
    summary = ensemble_summary(members, ["site_id", "model", "day"]).withColumns({
        "horizon": F.datediff("day", F.lit("2024-01-01").cast("date")), "crps": F.when(F.dayofmonth("day") % 3 != 0, F.col("mean") / 2)})
    folder = _folder(v, "horizon")
    write_horizon_forecasts(summary, folder)
    return read_csv(v.spark, folder, FORECAST_HORIZON, "forecast_prediction_horizon-*-31.csv")


@query("s10_consolidate_month", """
    SELECT lpad(site_id, 4, '0') AS site_id, CAST(day AS TIMESTAMP) AS "startDateTime", avg(value) FILTER (variable = 'SOILW') AS "VSWC",
           avg(value) FILTER (variable = 'TSOIL') AS "SOILT"
    FROM obs GROUP BY site_id, day""")
def _s10(v):
    """A file for each site and month, of this month and another; the site is in the name only."""
    site, month = F.lpad("site_id", 4, "0"), F.date_format("startDateTime", "yyyy-MM")
    rows = v.obs.groupBy("site_id", F.col("day").cast("timestamp").alias("startDateTime")).agg(
        F.avg(F.when(F.col("variable") == "TSOIL", F.col("value"))).alias("SOILT"),
        F.avg(F.when(F.col("variable") == "SOILW", F.col("value"))).alias("VSWC"),
    )
    later = rows.withColumn("startDateTime", F.col("startDateTime") + F.expr("INTERVAL 31 DAYS"))
    folder = _folder(v, "sensors")
    named = rows.unionByName(later).withColumn("_file", F.concat(F.lit("soil_drivers-"), site, F.lit("-"), month))
    write_named_files(named.select("startDateTime", "SOILT", "VSWC", "_file"), folder, F.col("_file"), drop=["_file"])
    return consolidate_sensor_month(v.spark, folder, "2024-01")


@query("s10_consolidate_flux_month", """
    SELECT site_id, CAST(datetime AS TIMESTAMP) AS "startDateTime", flux, flux_err FROM targets_day WHERE site_id IN ('1', '2', '3')""")
def _s10_flux(v):
    folder = _folder(v, "fluxes")
    rows = v.targets_day.where(F.col("site_id").isin("1", "2", "3")).select("site_id", F.col("datetime").cast("timestamp").alias("startDateTime"), "flux", "flux_err")
    write_named_files(rows, folder, F.concat(F.lit("forecast_prediction-"), F.col("site_id"), F.lit("-2024-01")))
    write_named_files(rows, folder, F.concat(F.lit("forecast_prediction-"), F.col("site_id"), F.lit("-2024-02")))
    return consolidate_flux_month(v.spark, folder, "2024-01")


@query("s11_month_of_drivers", f"""
    WITH wide AS (
        SELECT reference_datetime, site_id, ensemble, family, horizon, datetime, {_WIDE}
        FROM ens_runs WHERE reference_datetime BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND {_IN_ENV}
          AND ensemble = 'gec00' AND horizon < 86400
        GROUP BY reference_datetime, site_id, ensemble, family, horizon, datetime)
    SELECT site_id, CAST(datetime AS DATE) AS datetime, avg("PRES") AS "PRES", avg("TSOIL") AS "TSOIL",
           avg("SOILW") AS "SOILW", avg("WEASD") AS "WEASD", avg("SNOD") AS "SNOD", avg("ICETK") AS "ICETK"
    FROM wide GROUP BY reference_datetime, site_id, CAST(datetime AS DATE)""")
def _s11(v):
    return month_of_drivers(v.ens_runs.drop("day", "value"), "2024-01-01", "2024-01-31")


@query("s12_submission", """
    SELECT 'demo' AS project_id, 'lm_demo' AS model_id, datetime, reference_datetime, 'P1D' AS duration, site_id,
           'ensemble' AS family, parameter, 'soil_flux' AS variable, prediction
    FROM forecast_long""")
def _s12(v):
    return submission(v.forecast_long.withColumn("family", F.lit("ensemble")), "demo", "lm_demo")


@query("s12_submission_checks", """
    SELECT count(DISTINCT reference_datetime) AS reference_dates, count(*) FILTER (model_id LIKE '% %') AS ids_with_space,
           count(*) FILTER (site_id IS NULL OR datetime IS NULL) AS rows_without_key, count(*) AS n
    FROM (SELECT reference_datetime + CAST(CAST(parameter AS BIGINT) % 3 AS INTEGER) AS reference_datetime, datetime,
                 CASE WHEN CAST(parameter AS BIGINT) % 7 = 0 THEN 'lm demo' ELSE 'lm_demo' END AS model_id,
                 CASE WHEN CAST(parameter AS BIGINT) % 11 <> 0 THEN site_id END AS site_id FROM forecast_long)""")
def _s12_checks(v):
    """Three reference dates, blanks and spaces."""
    number = F.col("parameter").cast("long")
    faulty = submission(v.forecast_long.withColumn("family", F.lit("ensemble")), "demo", "lm_demo").withColumns({
        "reference_datetime": F.date_add("reference_datetime", (number % 3).cast("int")),
        "model_id": F.when(number % 7 == 0, "lm demo").otherwise(F.col("model_id")),
        "site_id": F.when(number % 11 != 0, F.col("site_id")),
    })
    return submission_problems(faulty)


assert list(QUANTILE_FILE_NAMES) == FORECAST_DAILY.names[-5:]
