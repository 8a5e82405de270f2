"""Explicit schemas. Spark binds CSV columns by position, so each file layout has its own."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols.items()])


STR, DBL, TS, DAY, INT = T.StringType(), T.DoubleType(), T.TimestampType(), T.DateType(), T.IntegerType()

# The six weather-model soil variables.
ENV_VARS = ("PRES", "TSOIL", "SOILW", "WEASD", "SNOD", "ICETK")

# Summary quantiles, internal name -> probability, and the names used in files.
QUANTILES = {"q0025": 0.025, "q0100": 0.10, "q0500": 0.5, "q0900": 0.9, "q0975": 0.975}
QUANTILE_FILE_NAMES = {
    "q0025": "q0.025",
    "q0100": "q0.10",
    "q0500": "q0.5",
    "q0900": "q0.90",
    "q0975": "q0.975",
}

TARGETS_CSV = _struct(site_id=STR, startDateTime=TS, flux=DBL, flux_err=DBL)
SENSOR_MONTH_CSV = _struct(site_id=STR, startDateTime=TS, VSWC=DBL, SOILT=DBL)
SENSOR_SITE_CSV = _struct(startDateTime=TS, SOILT=DBL, VSWC=DBL)
DRIVERS_CSV = _struct(site_id=STR, datetime=TS, PRES=DBL, TSOIL=DBL, SOILW=DBL, WEASD=DBL, SNOD=DBL, ICETK=DBL)
SITE_META_CSV = _struct(
    field_site_id=STR, field_latitude=DBL, field_longitude=DBL, terrestrial=INT, phenocam_vegetation=STR
)
CHALLENGE_CSV = _struct(project_id=STR, site_id=STR, datetime=DAY, duration=STR, variable=STR, observation=DBL)
ENSEMBLE_LONG = _struct(
    ensemble=STR, cycle=STR, horizon=DBL, datetime=TS, family=STR, site_id=STR, variable=STR, prediction=DBL,
    reference_datetime=DAY,
)
FORECAST_DAILY = _struct(
    site_id=STR, model=STR, day=DAY, mean=DBL, sd=DBL, q0025=DBL, q0100=DBL, q0500=DBL, q0900=DBL, q0975=DBL
)
FORECAST_HORIZON = _struct(
    site_id=STR, model=STR, day=DAY, horizon=INT, mean=DBL, sd=DBL, q0025=DBL, q0100=DBL, q0500=DBL, q0900=DBL, q0975=DBL,
    crps=DBL,
)

# Submission columns in file order.
SUBMISSION_COLUMNS = (
    "project_id", "model_id", "datetime", "reference_datetime", "duration",
    "site_id", "family", "parameter", "variable", "prediction",
)
