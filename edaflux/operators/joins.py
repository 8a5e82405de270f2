"""Joins. Keys are never null in these tables, except where a helper says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.operators.ranking import null_safe_join
from edaflux.session import BROADCAST_MAX_ROWS, broadcast_if_small, settle


def pair_training_rows(targets: DataFrame, drivers: DataFrame, keys: Sequence[str] = ("site_id", "datetime")) -> DataFrame:
    """Observed flux next to the drivers of the same site and day."""
    return targets.join(drivers, list(keys), "inner")


def attach_coefficients(
    rows: DataFrame, coefficients: DataFrame, keys: Sequence[str] = ("site_id",), max_rows: int = BROADCAST_MAX_ROWS
) -> DataFrame:
    """Give every ensemble row its site's coefficients without moving the ensemble, while the table is small.

    The table is settled and counted first; past ``max_rows`` it is joined by key with AQE splitting hot sites.
    """
    return lookup(rows, coefficients, keys, "inner", max_rows)


def lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_MAX_ROWS
) -> DataFrame:
    """Join many rows to a derived table of one row per key, on keys where null matches null.

    A derived table has no statistics the optimizer could trust, so it is settled (computed once) and counted here.
    """
    return null_safe_join(rows, broadcast_if_small(settle(table), max_rows), list(keys), how)


def full_pair(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sides kept, keys merged."""
    return left.join(right, list(keys), "full")


def left_pair(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def with_site_metadata(values: DataFrame, sites: DataFrame) -> DataFrame:
    """Metadata next to a table of one row per site; metadata names its key differently."""
    values = broadcast_if_small(settle(values))
    return sites.join(values, sites["field_site_id"] == values["site_id"], "inner").drop(values["site_id"])


def next_observation(forecast: DataFrame, observations: DataFrame) -> DataFrame:
    """Forecasts checked at ``next_eval`` next to the observation made on that date."""
    later = observations.select("site_id", "variable", F.col("datetime").alias("next_eval"), "observation")
    return forecast.join(later, ["site_id", "variable", "next_eval"], "inner")


def driver_target_scatter(
    drivers: DataFrame, targets: DataFrame, driver_variable: str, target_variable: str,
    keys: Sequence[str] = ("site_id", "datetime"),
) -> DataFrame:
    """One driver variable against one target variable, complete rows only."""
    x = drivers.where(F.col("variable") == driver_variable).select(*keys, "value").dropna()
    y = targets.where(F.col("variable") == target_variable).select(*keys, "observation").dropna()
    return x.join(y, list(keys), "inner")
