"""Ordered analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregates import GAP_FILL_SQL
from catalog.registry import query
from edaflux.functions.scalars import fick_flux
from edaflux.operators.aggregate import weighted_mean
from edaflux.operators.assimilate import attach_ensemble_moments
from edaflux.operators.gapfill import fill_gaps
from edaflux.operators.ranking import pairwise_spread
from edaflux.operators.soil import surface_gradient


@query("w1_gap_fill", f"""
    WITH {GAP_FILL_SQL}
    SELECT site_id, (epoch_us(startDateTime) - epoch_us(TIMESTAMP '2024-01-01')) // 1800000000 AS slot, flux, flux_err FROM g""")
def _w1(v):
    series = weighted_mean(
        weighted_mean(v.half_hour, ["site_id", "startDateTime", "horizontalPosition"]), ["site_id", "startDateTime"]
    )
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    filled = fill_gaps(series, ["site_id"], "startDateTime", ["flux", "flux_err"])
    slot = F.floor((F.unix_seconds("startDateTime") - start) / 1800)
    return filled.select("site_id", slot.alias("slot"), "flux", "flux_err")


@query("w2_pairwise_difference", """
    SELECT a.site_id, a.variable, count(DISTINCT a.event_id) AS members, avg(abs(a.value - b.value)) AS mean_abs_difference
    FROM obs a JOIN obs b ON a.site_id = b.site_id AND a.variable = b.variable GROUP BY a.site_id, a.variable""")
def _w2(v):
    return pairwise_spread(v.obs, ["site_id", "variable"], "value")


@query("w3_surface_gradient", """
    WITH m AS (SELECT site_id, event_id % 3 + 1 AS depth, avg(value) AS c FROM obs GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY depth) AS k FROM m),
         two AS (SELECT site_id, max(CASE WHEN k = 1 THEN depth END) AS z1, max(CASE WHEN k = 1 THEN c END) AS c1,
                        max(CASE WHEN k = 2 THEN depth END) AS z2, max(CASE WHEN k = 2 THEN c END) AS c2
                 FROM r GROUP BY site_id)
    SELECT site_id, (c2 - c1) / (z2 - z1) AS gradient, c1 - (c2 - c1) / (z2 - z1) * z1 AS surface_value FROM two""")
def _w3(v):
    profile = v.obs.select("site_id", (F.col("event_id") % 3 + 1).alias("depth"), F.col("value").alias("co2"))
    return surface_gradient(profile, ["site_id"])


@query("w3_profile_flux", """
    WITH m AS (SELECT site_id, day, event_id % 3 + 1 AS depth, avg(value) AS c FROM obs GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY site_id, day ORDER BY depth) AS k FROM m),
         two AS (SELECT site_id, day, max(CASE WHEN k = 1 THEN depth END) AS z1, max(CASE WHEN k = 1 THEN c END) AS c1,
                        max(CASE WHEN k = 2 THEN depth END) AS z2, max(CASE WHEN k = 2 THEN c END) AS c2
                 FROM r GROUP BY site_id, day)
    SELECT site_id, day,
           -0.001::DOUBLE * pow((20 + 273.15::DOUBLE) / 293.15::DOUBLE, 1.75::DOUBLE)
             * (pow(0.42::DOUBLE - 0.1::DOUBLE, 10.0::DOUBLE / 3) / 0.1764::DOUBLE) * ((c2 - c1) / (z2 - z1)) AS flux
    FROM two""")
def _w3_flux(v):
    profile = v.obs.select("site_id", "day", (F.col("event_id") % 3 + 1).alias("depth"), F.col("value").alias("co2"))
    gradient = surface_gradient(profile, ["site_id", "day"])
    flux = fick_flux(F.lit(0.001), F.lit(20.0), F.lit(0.1), "gradient")
    return gradient.select("site_id", "day", flux.alias("flux"))


@query("w4_ensemble_moments", """
    SELECT event_id, value, avg(value) OVER w AS ens_mean, var_samp(value) OVER w AS ens_var FROM obs
    WINDOW w AS (PARTITION BY site_id, variable, day)""")
def _w4(v):
    out = attach_ensemble_moments(v.obs, ["site_id", "variable", "day"], "value")
    return out.select("event_id", "value", "ens_mean", "ens_var")
