"""Weather-ensemble tables, partitioned by ``reference_datetime``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edaflux.functions.dates import EVALUATION_DAYS, day_of
from edaflux.functions.scalars import sentinel_to_null
from edaflux.operators.aggregate import daily_drivers
from edaflux.operators.filters import control_member, known_sites, members_of
from edaflux.operators.reshape import widen
from edaflux.schemas import ENSEMBLE_LONG, ENV_VARS
from edaflux.session import broadcast_if_small, settle

WIDE_KEYS = ("reference_datetime", "site_id", "ensemble", "family", "horizon", "datetime")


def read_ensemble(spark: SparkSession, path: str) -> DataFrame:
    """The long table. Filters on ``reference_datetime`` choose folders, others reach the Parquet scan."""
    return spark.read.schema(ENSEMBLE_LONG).parquet(path)


def gefs_soil_forecasts(
    long: DataFrame, input_date: str, sites: Sequence[str] | None = None, env_vars: Sequence[str] = ENV_VARS
) -> DataFrame:
    """One run: chosen variables and sites, sentinel to null, one column per variable."""
    run = members_of(long.where(F.col("reference_datetime") == F.lit(input_date).cast("date")), "variable", env_vars)
    if sites is not None:
        run = members_of(run, "site_id", sites)
    return _clean_wide(run, env_vars)


def noaa_soil_drivers(
    long: DataFrame, site_metadata: DataFrame, forecast_date: str, sites: Sequence[str] | None = None
) -> DataFrame:
    """One run at the terrestrial sites, or at those of them listed."""
    known = terrestrial_sites(site_metadata)
    if sites is not None:
        known = members_of(known, "field_site_id", sites)
    run = members_of(long.where(F.col("reference_datetime") == F.lit(forecast_date).cast("date")), "variable", ENV_VARS)
    return _clean_wide(known_sites(run, known, site_column="field_site_id"), ENV_VARS)


def _clean_wide(run: DataFrame, env_vars: Sequence[str]) -> DataFrame:
    keys = [k for k in WIDE_KEYS if k in run.columns]
    return widen(run.withColumn("prediction", sentinel_to_null("prediction")), keys, env_vars)


def terrestrial_sites(site_metadata: DataFrame) -> DataFrame:
    return site_metadata.where(F.col("terrestrial") == 1).select(
        "field_site_id", "field_latitude", "field_longitude"
    )


def month_of_drivers(long: DataFrame, first: str, last: str, sites: DataFrame | None = None) -> DataFrame:
    """Daily control-member drivers of every run from ``first`` to ``last``: one scan, not one per date."""
    runs = long.where(F.col("reference_datetime").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    runs = control_member(members_of(runs, "variable", ENV_VARS))
    if sites is not None:
        runs = known_sites(runs, sites, site_column="field_site_id")
    wide = _clean_wide(runs, ENV_VARS).withColumn("datetime", day_of("datetime"))
    # Days overlap between runs: each run's day is averaged by itself.
    keys = ["reference_datetime", "site_id", "datetime"]
    return wide.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ENV_VARS]).drop("reference_datetime")


def previous_run(long: DataFrame, origins: DataFrame, met_vars: Sequence[str]) -> DataFrame:
    """For every (site_id, origin, duration): the run of the day before, from the origin to the end of its span.

    Runs are matched by an equality on (site, reference date), so one pass serves all origins. The ensemble stays
    where it is while a count shows the list of origins is small.

    Only the folders of matching reference dates are read. The first and last of them, and of the times asked for, are
    one small row, known before the scan is planned: they prune folders and row groups whatever the join. On the side of
    the origins the same bounds are a selective filter, which lets Spark hand the exact dates of a broadcast side to the
    scan (dynamic partition pruning).
    """
    wanted = origins.select(
        "site_id", "origin", "duration", F.date_sub("origin", 1).alias("reference_datetime"),
        F.when(F.col("duration") == "P1D", F.date_add("origin", EVALUATION_DAYS["P1D"]))
        .otherwise(F.date_add("origin", EVALUATION_DAYS["P1W"])).alias("_until"),
    ).distinct()
    wanted = settle(wanted)
    first, last, start, stop = wanted.agg(
        F.min("reference_datetime"), F.max("reference_datetime"), F.min("origin").cast("timestamp_ntz"), F.max("_until").cast("timestamp_ntz")
    ).head()
    run_date, time = F.col("reference_datetime"), F.col("datetime")
    bounded = long.where(run_date.between(F.lit(first), F.lit(last)) & time.between(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")))
    rows = members_of(bounded, "variable", met_vars).withColumn("prediction", sentinel_to_null("prediction"))
    matched = rows.join(broadcast_if_small(wanted.where(run_date.between(F.lit(first), F.lit(last)))), ["site_id", "reference_datetime"])
    spanned = matched.where((time >= F.col("origin").cast("timestamp")) & (time <= F.col("_until").cast("timestamp")))
    keys = ["site_id", "origin", "duration", "reference_datetime", "ensemble", "family", "datetime"]
    return widen(spanned, keys, met_vars)


def noaa_mean_historical(stage3: DataFrame, sites: Sequence[str], year: int) -> DataFrame:
    """Daily means per site and variable of a whole year, its last day included."""
    c = F.col("datetime")
    rows = members_of(stage3, "site_id", sites).where(
        (c >= F.lit(f"{year}-01-01").cast("timestamp")) & (c < F.lit(f"{year + 1}-01-01").cast("timestamp"))
    )
    return rows.groupBy("site_id", day_of("datetime").alias("datetime"), F.col("variable").alias("noaa")).agg(
        F.avg("prediction").alias("value")
    )


__all__ = [
    "daily_drivers", "gefs_soil_forecasts", "month_of_drivers", "noaa_mean_historical", "noaa_soil_drivers",
    "previous_run", "read_ensemble", "terrestrial_sites",
]
