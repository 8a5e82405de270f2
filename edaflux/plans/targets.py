"""Monthly target build: sensors and half-hourly fluxes to one row per site and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.operators.aggregate import daily_flux
from edaflux.operators.filters import passing_sensor_rows
from edaflux.operators.joins import full_pair


def sensor_means(sensor: DataFrame, value: str, name: str, qf: str = "QF") -> DataFrame:
    """Mean over positions of the accepted readings at each site and time."""
    kept = passing_sensor_rows(sensor, qf)
    return kept.groupBy("site_id", "startDateTime").agg(F.avg(value).alias(name))


def build_sensor_month(temperature: DataFrame, water: DataFrame, value: str = "value") -> DataFrame:
    """Soil temperature and water of all sites, either side possibly missing."""
    return full_pair(
        sensor_means(temperature, value, "SOILT"), sensor_means(water, value, "VSWC"), ["site_id", "startDateTime"]
    )


def build_flux_month(half_hours: DataFrame) -> DataFrame:
    """Daily targets of all sites in the layout of the target files."""
    return daily_flux(half_hours).select(
        "site_id", F.col("day").alias("startDateTime"), "flux", "flux_err"
    )
