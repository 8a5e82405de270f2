"""Row predicates of the forecasting workflow."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edaflux.functions.scalars import is_finite
from edaflux.session import broadcast_if_small

# Fixed values.
CONTROL_MEMBER = "gec00"
FIRST_DAY_SECONDS = 86_400
SURFACE_POSITION = "501"


def members_of(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Keep rows whose column is one of the listed values."""
    return df.where(F.col(column).isin(list(values)))


def known_sites(df: DataFrame, sites: DataFrame, column: str = "site_id", site_column: str = "site_id") -> DataFrame:
    """Keep rows of sites present in a site table, without moving the rows while a count shows the table is small."""
    wanted = sites.select(F.col(site_column).alias(column))
    return df.join(broadcast_if_small(wanted), column, "left_semi")


def first_day(df: DataFrame) -> DataFrame:
    """Lead time strictly under one day."""
    return df.where(F.col("horizon") < FIRST_DAY_SECONDS)


def control_member(df: DataFrame, analysis_only: bool = False) -> DataFrame:
    """The unperturbed member: its first day, or only its time zero."""
    lead = (F.col("horizon") == 0) if analysis_only else (F.col("horizon") < FIRST_DAY_SECONDS)
    return df.where((F.col("ensemble") == CONTROL_MEMBER) & lead)


def passing_sensor_rows(df: DataFrame, qf: str = "QF", ts: str = "startDateTime") -> DataFrame:
    """Shallowest position, unflagged, taken at 00:00."""
    return df.where(
        (F.col("verticalPosition") == SURFACE_POSITION)
        & (F.col(qf) == 0)
        & (F.hour(ts) == 0)
        & (F.minute(ts) == 0)
    )


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with no null in any (or any listed) column."""
    return df.dropna("any", subset=list(columns) if columns else None)


def usable_log_rows(df: DataFrame, flux: str = "flux", covariate: str = "TSOIL10") -> DataFrame:
    """Rows an ln(flux) fit can use."""
    return df.where(is_finite(flux) & (F.col(flux) > 0) & F.col(covariate).isNotNull())


def all_finite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every numeric column non-null and finite."""
    numeric = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    checks: list[Column] = [is_finite(F.col(c).cast("double")) for c in numeric]
    return df.where(reduce(lambda a, b: a & b, checks, F.lit(True)))


def groups_larger_than(counted: DataFrame, n: int, count: str = "n") -> DataFrame:
    """HAVING over an already aggregated table; the threshold is strict."""
    return counted.where(F.col(count) > n)


def in_range(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """Both ends included."""
    return df.where(F.col(column).between(F.lit(lo), F.lit(hi)))


def forecast_day(df: DataFrame, day: str, column: str = "day") -> DataFrame:
    return df.where(F.col(column) == F.lit(day).cast("date"))


def unpaired(targets: DataFrame, drivers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows that lack an observation or any driver row, with a flag for each."""
    present = drivers.select(*keys).distinct().withColumn("driver_avail", F.lit(True))
    return (
        targets.join(present, list(keys), "left")
        .withColumn("obs_avail", F.col("observation").isNotNull())
        .withColumn("driver_avail", F.coalesce("driver_avail", F.lit(False)))
        .where(~F.col("obs_avail") | ~F.col("driver_avail"))
    )
