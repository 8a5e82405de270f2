"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from edaflux.functions import scalars as S
from edaflux.functions.dates import month_label


@query("c1_sentinel_to_null", """
    SELECT ensemble, horizon, variable, NULLIF(prediction, 9999.0) AS prediction FROM ens_long""")
def _c1(v):
    return v.ens_long.select("ensemble", "horizon", "variable", S.sentinel_to_null("prediction").alias("prediction"))


@query("c2_kelvin_to_celsius", "SELECT event_id, value - 273.15::DOUBLE AS celsius FROM obs WHERE variable = 'TSOIL'")
def _c2(v):
    return v.obs.where(F.col("variable") == "TSOIL").select("event_id", S.kelvin_to_celsius("value").alias("celsius"))


@query("c3_reduced_temperature", """
    SELECT event_id, (value - 10) / 10 AS from_celsius, ((value - 273.15::DOUBLE) - 10) / 10 AS from_kelvin FROM obs""")
def _c3(v):
    return v.obs.select(
        "event_id", S.reduced_temperature("value").alias("from_celsius"),
        S.reduced_temperature_kelvin("value").alias("from_kelvin"),
    )


@query("c4_null_model", """
    SELECT event_id, 0.598::DOUBLE + exp(0.044::DOUBLE * (value - 273.15::DOUBLE)) AS flux FROM obs WHERE variable = 'TSOIL'""")
def _c4(v):
    return v.obs.where(F.col("variable") == "TSOIL").select("event_id", S.null_model_flux("value").alias("flux"))


@query("c5_carbon_units", """
    SELECT event_id, value * 0.02161926::DOUBLE AS half_hour, value * (1e-6::DOUBLE * 0.012011::DOUBLE * 1000 * 86400) AS per_day
    FROM obs""")
def _c5(v):
    return v.obs.select(
        "event_id", S.half_hour_carbon("value").alias("half_hour"), (F.col("value") * F.lit(S.DAY_CARBON)).alias("per_day")
    )


@query("c6_clamp_at_zero", """
    SELECT site_id, datetime, CASE WHEN flux_err IS NOT NULL THEN greatest(flux_err - 40, 0.0) END AS clamped FROM targets_day""")
def _c6(v):
    return v.targets_day.select("site_id", "datetime", S.clamp_at_zero(F.col("flux_err") - 40).alias("clamped"))


@query("c7_title_case", """
    WITH parts AS (
        SELECT o_orderkey, lower(o_orderpriority) AS t,
               list_transform(string_split_regex(lower(o_orderpriority), '[ -]'), lambda w: upper(w[1]) || w[2:]) AS words
        FROM orders)
    SELECT o_orderkey, CASE WHEN len(words) = 3 THEN words[1] || '-' || words[2] || ' ' || words[3]
                            ELSE words[1] || '-' || words[2] END AS title
    FROM parts""")
def _c7(v):
    return v.table("orders").select("o_orderkey", S.title_case("o_orderpriority").alias("title"))


@query("c8_rename_reorder", """
    SELECT site_id, datetime AS day, flux_err AS error, flux AS value FROM targets_day""")
def _c8(v):
    return v.targets_day.withColumnsRenamed({"datetime": "day", "flux": "value", "flux_err": "error"}).select(
        "site_id", "day", "error", "value"
    )


@query("c9_name_keys", """
    SELECT row_id, strftime(datetime, '%Y-%m') AS month, lpad(site_id, 4, 'S') AS site FROM monthly""")
def _c9(v):
    name = F.concat(F.lit("soil_drivers-"), F.lpad("site_id", 4, "S"), F.lit("-"), month_label("datetime"), F.lit(".csv"))
    return v.monthly.select(
        "row_id", S.name_part(name, r"(\d{4}-\d{2})\.csv$").alias("month"),
        S.name_part(name, r"soil_drivers-([A-Za-z0-9]{4})-").alias("site"),
    )


@query("c10_date_parts", """
    SELECT row_id, CAST(year(datetime) AS INTEGER) AS y, CAST(month(datetime) AS INTEGER) AS m,
           strftime(datetime, '%d') AS d_text
    FROM monthly""")
def _c10(v):
    text = F.split(F.col("datetime").cast("string"), "-")
    return v.monthly.select(
        "row_id", F.year("datetime").alias("y"), F.month("datetime").alias("m"), text[2].alias("d_text")
    )


@query("c11_water_response", """
    SELECT event_id, CASE WHEN w BETWEEN 0 AND 0.42::DOUBLE THEN pow(0.42::DOUBLE - w, 10.0::DOUBLE / 3) / 0.1764::DOUBLE ELSE 0.0 END AS moyano,
           1 - w AS linear
    FROM (SELECT event_id, value / 100 AS w FROM obs)""")
def _c11(v):
    w = F.col("value") / 100
    return v.obs.select(
        "event_id", S.moyano_water_response(w).alias("moyano"), S.linear_water_response(w).alias("linear")
    )


@query("c12_temperature_response", """
    SELECT event_id, pow((value + 273.15::DOUBLE) / 293.15::DOUBLE, 1.75::DOUBLE) AS response,
           30 - 10 * sin(pi() * hour(ts) / 12) AS at_hour
    FROM obs""")
def _c12(v):
    return v.obs.select(
        "event_id", S.temperature_response("value").alias("response"), S.diurnal_temperature(F.hour("ts")).alias("at_hour")
    )


@query("c13_fick_flux", """
    SELECT event_id,
           -0.2::DOUBLE * pow((value + 273.15::DOUBLE) / 293.15::DOUBLE, 1.75::DOUBLE)
             * (CASE WHEN w BETWEEN 0 AND 0.42::DOUBLE THEN pow(0.42::DOUBLE - w, 10.0::DOUBLE / 3) / 0.1764::DOUBLE ELSE 0.0 END) * g AS flux
    FROM (SELECT event_id, value, value / 1000 AS w, -(value + 1) AS g FROM obs)""")
def _c13(v):
    flux = S.fick_flux(F.lit(0.2), "value", F.col("value") / 1000, -(F.col("value") + 1))
    return v.obs.select("event_id", flux.alias("flux"))


@query("c14_model_label", "SELECT event_id, 'null' AS model, value FROM obs")
def _c14(v):
    return v.obs.select("event_id", F.lit("null").alias("model"), "value")


@query("c15_coverage_flag", """
    SELECT site_id, datetime, flux BETWEEN q0025 AND q0975 AS within_pi FROM forecast_scored""")
def _c15(v):
    return v.forecast_scored().select("site_id", "datetime", S.within("flux", "q0025", "q0975").alias("within_pi"))


@query("c16_taylor_coordinates", """
    SELECT site_id, sd * r AS x_coord, sd * sqrt(greatest(1 - r * r, 0)) AS y_coord
    FROM (SELECT site_id, stddev_samp(q0500) / NULLIF(stddev_samp(flux), 0) AS sd,
                 NULLIF(corr(flux, q0500), 'NaN'::DOUBLE) AS r FROM forecast_scored
          WHERE q0500 IS NOT NULL GROUP BY site_id)""")
def _c16(v):
    stats = v.forecast_scored().where(F.col("q0500").isNotNull()).groupBy("site_id").agg(
        F.try_divide(F.stddev_samp("q0500"), F.stddev_samp("flux")).alias("sd"), F.corr("flux", "q0500").alias("r")
    )
    return stats.select("site_id", S.taylor_x("sd", "r").alias("x_coord"), S.taylor_y("sd", "r").alias("y_coord"))
