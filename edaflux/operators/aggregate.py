"""Aggregations. All combine map-side; quantiles go through ``ranking``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.functions.dates import day_of
from edaflux.functions.scalars import half_hour_carbon
from edaflux.operators.gapfill import fill_gaps
from edaflux.operators.ranking import ensemble_summary, quantiles
from edaflux.schemas import ENV_VARS


def group_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of every column per group, nulls left out."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def daily_drivers(wide: DataFrame, columns: Sequence[str] = ENV_VARS) -> DataFrame:
    """Daily mean of the driver variables by site."""
    by_day = wide.withColumn("datetime", day_of("datetime"))
    return group_means(by_day, ["site_id", "datetime"], columns)


def inverse_variance(flux: str = "flux", err: str = "flux_err") -> tuple[Column, Column]:
    """Weighted mean and its error as aggregates; pairs with a null or a zero error have no weight."""
    x, e = F.col(flux), F.col(err)
    weight = F.when(x.isNotNull(), F.try_divide(F.lit(1.0), e * e))
    total = F.sum(weight)
    return F.try_divide(F.sum(weight * x), total), F.sqrt(F.try_divide(F.lit(1.0), total))


def weighted_mean(df: DataFrame, keys: Sequence[str], flux: str = "flux", err: str = "flux_err") -> DataFrame:
    """Inverse-variance mean and error per group; a group without a usable pair keeps a null row."""
    mean, error = inverse_variance(flux, err)
    return df.groupBy(*keys).agg(mean.alias(flux), error.alias(err))


def daily_flux(half_hours: DataFrame, site: str = "site_id", ts: str = "startDateTime") -> DataFrame:
    """Half-hourly fluxes by position and method -> daily carbon totals with propagated error.

    Methods are averaged at each time and position, positions at each time, gaps filled by position in the series,
    units converted, days summed. Days with no usable half-hour are null.
    """
    by_position = weighted_mean(half_hours, [site, ts, "horizontalPosition"])
    by_time = weighted_mean(by_position, [site, ts])
    filled = fill_gaps(by_time, [site], ts, ["flux", "flux_err"])
    scaled = filled.select(
        site, day_of(ts).alias("day"), half_hour_carbon("flux").alias("f"), half_hour_carbon("flux_err").alias("e")
    )
    return scaled.groupBy(site, "day").agg(
        F.sum("f").alias("flux"), F.sqrt(F.sum(F.col("e") * F.col("e"))).alias("flux_err")
    )


def column_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Mapping[str, float] | None = None
) -> DataFrame:
    """Quantiles of several columns at once: one row per group and column name in ``variable``."""
    long = df.unpivot(list(keys), list(columns), "variable", "_v")
    return quantiles(long, [*keys, "variable"], "_v", probabilities or {"q10": 0.10, "q50": 0.50, "q90": 0.90})


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


__all__ = [
    "column_quantiles", "daily_drivers", "daily_flux", "distinct_values", "earliest", "ensemble_summary", "group_counts",
    "group_means", "inverse_variance", "latest", "weighted_mean",
]


def earliest(df: DataFrame, ts: str = "datetime") -> Column:
    """The table's first time as a scalar subquery."""
    return df.agg(F.min(ts)).scalar()


def latest(df: DataFrame, ts: str = "datetime") -> Column:
    return df.agg(F.max(ts)).scalar()
