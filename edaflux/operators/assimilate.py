"""Ensemble Kalman update of a scalar state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.functions.noise import keyed_gaussian
from edaflux.operators.evaluate import observations_in_span, spanned, with_intervals
from edaflux.operators.joins import lookup
from edaflux.operators.ranking import null_safe_join

MEMBER_KEYS = ("site_id", "reference_datetime", "parameter", "datetime")


def attach_ensemble_moments(members: DataFrame, keys: Sequence[str], value: str = "prediction") -> DataFrame:
    """Every member with its group's mean and variance.

    The moments are aggregated first (map-side) and looked up again, so no window gathers a hot group in one task.
    """
    moments = members.groupBy(*keys).agg(F.avg(value).alias("ens_mean"), F.var_samp(value).alias("ens_var"))
    return lookup(members, moments, keys)


def kalman_update(
    members: DataFrame, observations: DataFrame, keys: Sequence[str], ic_sd: float, perturb: float = 1.0, seed: int = 0,
    value: str = "prediction", obs: str = "observation", member_keys: Sequence[str] = MEMBER_KEYS,
) -> DataFrame:
    """Move each member towards its group's observation, perturbed per member with sd ``ic_sd``.

    Groups without an observation, and groups of one member, stay as they are. Several observations of one group
    count as their mean.
    """
    keys = list(keys)
    observed = observations.groupBy(*keys).agg(F.avg(obs).alias("_y"))
    moments = members.groupBy(*keys).agg(F.var_samp(value).alias("_var"))
    # Variance and observation travel together: the members are joined once, not twice.
    joined = lookup(members, null_safe_join(moments, observed, keys, "left"), keys)
    gain = F.try_divide(F.col("_var"), F.col("_var") + F.lit(float(ic_sd) ** 2))
    target = F.col("_y")
    if perturb:
        target = target + F.lit(float(ic_sd) * perturb) * keyed_gaussian(seed, "observation", member_keys)
    moved = F.col(value) + gain * (target - F.col(value))
    return joined.withColumn(value, F.coalesce(moved, F.col(value))).drop("_var", "_y")


def assimilate_forecast(
    forecast: DataFrame, targets: DataFrame, duration: str, ic_sd: float, perturb: float = 1.0, seed: int = 0
) -> DataFrame:
    """Update a forecast interval by interval; each (site, variable, interval) is independent of the others."""
    keys = ["site_id", "variable", "interval_id"]
    forecast, span = spanned(forecast)
    placed = with_intervals(forecast, span, duration)
    observed = observations_in_span(targets, span, duration)
    return kalman_update(placed, observed, keys, ic_sd, perturb, seed).drop("interval_id")
