"""Filters and predicates (F-1 to F-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from edaflux.functions.scalars import reduced_temperature_kelvin
from edaflux.operators import filters as P
from edaflux.operators.aggregate import group_counts
from edaflux.schemas import ENV_VARS
from edaflux.sources.ensemble import terrestrial_sites

_LONG = "ensemble, horizon, day, site_id, variable, prediction"


@query("f1_variable_membership", f"""
    SELECT {_LONG} FROM ens_long WHERE variable IN ('PRES', 'TSOIL', 'SOILW', 'WEASD', 'SNOD', 'ICETK')""")
def _f1(v):
    return P.members_of(v.ens_long, "variable", ENV_VARS).select(*_LONG.split(", "))


@query("f2_known_sites", f"""
    SELECT {_LONG} FROM ens_long WHERE site_id IN (SELECT field_site_id FROM site_meta WHERE terrestrial = 1)""")
def _f2(v):
    rows = P.known_sites(v.ens_long, terrestrial_sites(v.site_meta), site_column="field_site_id")
    return rows.select(*_LONG.split(", "))


@query("f3_first_day", f"SELECT {_LONG} FROM ens_long WHERE horizon < 86400")
def _f3(v):
    return P.first_day(v.ens_long).select(*_LONG.split(", "))


@query("f4_control_member", f"SELECT {_LONG} FROM ens_runs WHERE ensemble = 'gec00' AND horizon < 86400")
def _f4(v):
    return P.control_member(v.ens_runs).select(*_LONG.split(", "))


@query("f4_control_analysis", f"SELECT {_LONG} FROM ens_runs WHERE ensemble = 'gec00' AND horizon = 0")
def _f4_analysis(v):
    return P.control_member(v.ens_runs, analysis_only=True).select(*_LONG.split(", "))


@query("f5_sensor_quality", """
    SELECT event_id, site_id, verticalPosition AS "verticalPosition", QF AS "QF", value FROM sensor
    WHERE verticalPosition = '501' AND QF = 0 AND hour(startDateTime) = 0 AND minute(startDateTime) = 0""")
def _f5(v):
    return P.passing_sensor_rows(v.sensor).select("event_id", "site_id", "verticalPosition", "QF", "value")


@query("f6_complete_cases", """
    SELECT site_id, datetime, "PRES", "TSOIL", "SOILW", "WEASD", "SNOD", "ICETK" FROM drivers_day
    WHERE "PRES" IS NOT NULL AND "TSOIL" IS NOT NULL AND "SOILW" IS NOT NULL AND "WEASD" IS NOT NULL
      AND "SNOD" IS NOT NULL AND "ICETK" IS NOT NULL""")
def _f6(v):
    return P.complete_cases(v.drivers_day)


@query("f7_usable_log_rows", """
    SELECT site_id, datetime, flux - 40 AS flux, ("TSOIL" - 273.15::DOUBLE - 10) / 10 AS "TSOIL10"
    FROM targets_day JOIN drivers_day USING (site_id, datetime)
    WHERE flux - 40 > 0 AND "TSOIL" IS NOT NULL""")
def _f7(v):
    joined = v.targets_day.join(v.drivers_day, ["site_id", "datetime"])
    rows = joined.select(
        "site_id", "datetime", (F.col("flux") - 40).alias("flux"), reduced_temperature_kelvin("TSOIL").alias("TSOIL10")
    )
    return P.usable_log_rows(rows)


@query("f8_all_finite", """
    SELECT site_id, datetime, flux, flux_err FROM targets_day
    WHERE flux IS NOT NULL AND flux_err IS NOT NULL AND isfinite(flux) AND isfinite(flux_err)""")
def _f8(v):
    return P.all_finite(v.targets_day)


@query("f9_minimum_group", "SELECT site_id, day, count(*) AS n FROM obs GROUP BY site_id, day HAVING count(*) > 5")
def _f9(v):
    return P.groups_larger_than(group_counts(v.obs, ["site_id", "day"]), 5)


@query("f10_inclusive_range", "SELECT event_id, value FROM obs WHERE value BETWEEN 10.0 AND 20.0")
def _f10(v):
    return P.in_range(v.obs, "value", 10.0, 20.0).select("event_id", "value")


@query("f11_forecast_day", "SELECT event_id, day, value FROM obs WHERE day = DATE '2024-01-15'")
def _f11(v):
    return P.forecast_day(v.obs, "2024-01-15").select("event_id", "day", "value")


@query("f12_unpaired_rows", """
    WITH days AS (SELECT DISTINCT site_id, day AS datetime FROM obs),
    targets AS (SELECT site_id, datetime, flux_err AS observation FROM targets_day),
    rows AS (SELECT d.site_id, d.datetime, t.observation FROM days d LEFT JOIN targets t USING (site_id, datetime)),
    drivers AS (SELECT DISTINCT site_id, datetime FROM drivers_day WHERE "ICETK" IS NOT NULL)
    SELECT r.site_id, r.datetime, r.observation, r.observation IS NOT NULL AS obs_avail, d.site_id IS NOT NULL AS driver_avail
    FROM rows r LEFT JOIN drivers d ON r.site_id = d.site_id AND r.datetime = d.datetime
    WHERE r.observation IS NULL OR d.site_id IS NULL""")
def _f12(v):
    days = v.obs.select("site_id", F.col("day").alias("datetime")).distinct()
    targets = days.join(
        v.targets_day.select("site_id", "datetime", F.col("flux_err").alias("observation")), ["site_id", "datetime"], "left"
    )
    drivers = v.drivers_day.where(F.col("ICETK").isNotNull())
    out = P.unpaired(targets, drivers, ["site_id", "datetime"])
    return out.select("site_id", "datetime", "observation", "obs_avail", "driver_avail")
