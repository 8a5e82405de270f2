"""Reshape and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from edaflux.functions.scalars import null_model_flux
from edaflux.operators import reshape as R
from edaflux.operators.aggregate import ensemble_summary
from edaflux.schemas import ENV_VARS, QUANTILES


@query("r1_widen", """
    SELECT site_id, day, max(CASE WHEN variable = 'TSOIL' THEN prediction END) AS "TSOIL",
           max(CASE WHEN variable = 'SOILW' THEN prediction END) AS "SOILW"
    FROM ens_long GROUP BY site_id, day""")
def _r1(v):
    return R.widen(v.ens_long, ["site_id", "day"], ["TSOIL", "SOILW"])


@query("r2_lengthen", """
    SELECT site_id, datetime, unnest(['PRES', 'TSOIL', 'SOILW', 'WEASD', 'SNOD', 'ICETK']) AS variable,
           unnest(["PRES", "TSOIL", "SOILW", "WEASD", "SNOD", "ICETK"]) AS value
    FROM drivers_day""")
def _r2(v):
    return R.lengthen(v.drivers_day, ["site_id", "datetime"], ENV_VARS)


@query("r3_lengthen_compound", """
    SELECT day, 'TSOIL' AS variable, min("TSOIL") AS low, max("TSOIL") AS high FROM ens_wide GROUP BY day
    UNION ALL SELECT day, 'SOILW', min("SOILW"), max("SOILW") FROM ens_wide GROUP BY day""")
def _r3(v):
    wide = v.ens_wide.groupBy("day").agg(
        *[f(c).alias(f"{c}___{n}") for c in ("TSOIL", "SOILW") for f, n in ((F.min, "low"), (F.max, "high"))]
    )
    return R.lengthen_compound(wide, ["day"], ["TSOIL", "SOILW"], ["low", "high"])


@query("r4_spread_quantiles", """
    SELECT site_id, q0025, q0100, q0500, q0900, q0975 FROM (
        SELECT site_id, quantile_cont(flux, 0.025) AS q0025, quantile_cont(flux, 0.1) AS q0100,
               quantile_cont(flux, 0.5) AS q0500, quantile_cont(flux, 0.9) AS q0900, quantile_cont(flux, 0.975) AS q0975
        FROM targets_day GROUP BY site_id)""")
def _r4(v):
    summary = ensemble_summary(v.targets_day, ["site_id"], "flux")
    rows = summary.select("site_id", F.array(*QUANTILES).alias("quantiles"))
    return R.spread_quantiles(rows)


@query("r6_bind_rows", """
    SELECT site_id, datetime, 'mean' AS model, flux AS value FROM targets_day
    UNION ALL
    SELECT site_id, datetime, 'null', 0.598::DOUBLE + exp(0.044::DOUBLE * ("TSOIL" - 273.15::DOUBLE)) FROM drivers_day""")
def _r6(v):
    a = v.targets_day.select("site_id", "datetime", F.lit("mean").alias("model"), F.col("flux").alias("value"))
    b = v.drivers_day.select("site_id", "datetime", F.lit("null").alias("model"), null_model_flux("TSOIL").alias("value"))
    return R.bind_rows(a, b)


@query("r6_bind_rows_loose", """
    SELECT site_id, datetime, flux, NULL::DOUBLE AS "TSOIL" FROM targets_day
    UNION ALL SELECT site_id, datetime, NULL, "TSOIL" FROM drivers_day""")
def _r6_loose(v):
    return R.bind_rows(
        v.targets_day.select("site_id", "datetime", "flux"), v.drivers_day.select("site_id", "datetime", "TSOIL"), loose=True
    )
