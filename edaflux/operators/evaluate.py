"""Forecast skill: CRPS, Taylor statistics, coverage, interval evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.functions.dates import interval_id, week_start
from edaflux.functions.scalars import taylor_x, taylor_y, within
from edaflux.operators.aggregate import ensemble_summary
from edaflux.operators.filters import complete_cases
from edaflux.operators.ranking import group_key, keyed_ranks, moments_of_ranks, quantiles_of_ranks, spread_of_ranks, unpacked
from edaflux.schemas import QUANTILES
from edaflux.session import settle_observed


def sample_crps(
    members: DataFrame, keys: Sequence[str], value: str, observations: DataFrame, obs: str = "flux"
) -> DataFrame:
    """CRPS of an ensemble against one observation per group: mean distance to it minus half the mean spread."""
    return score_ensemble(members, keys, value, observations, obs).select(*keys, "crps").where(F.col("crps").isNotNull())


def _crps(value: str, obs: str) -> Column:
    distance = F.try_divide(F.sum(F.col("copies") * F.abs(F.col(value) - F.col(obs))), F.max("size").cast("double"))
    return F.when(F.abs(distance) < float("inf"), distance) - spread_of_ranks(value)


def score_ensemble(
    members: DataFrame, keys: Sequence[str], value: str, observations: DataFrame, obs: str = "flux",
    observation_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Summary and CRPS of every group that was observed; ``observation_keys`` is the part of ``keys`` both share.

    Members are ranked once, for the quantiles and the CRPS together. A key observed with several values gives a row
    for each of them.
    """
    keys, shared = list(keys), list(observation_keys or keys)
    keyed = members.select(group_key(keys).alias("_k"), value)
    observed = observations.select(group_key(shared).alias("_s"), obs)
    out = keyed_ranks(keyed, value, observed, shared).groupBy("_k", obs).agg(
        *moments_of_ranks(value), *quantiles_of_ranks(value, QUANTILES), _crps(value, obs).alias("crps")
    )
    return out.select(*unpacked(keys), "mean", "sd", obs, *QUANTILES, "crps")


def taylor_statistics(df: DataFrame, keys: Sequence[str], reference: str, model: str) -> DataFrame:
    """Normalised sd, correlation, centred rms difference and plot coordinates, over complete rows."""
    return _taylor(complete_cases(df.select(*keys, reference, model)), keys, reference, model)


def _taylor(rows: DataFrame, keys: Sequence[str], reference: str, model: str, *more: Column) -> DataFrame:
    """The statistics and ``more`` aggregates in one pass; rows hold both values or neither."""
    sums = rows.groupBy(*keys).agg(
        *more,
        F.stddev_samp(reference).alias("_ref"), F.stddev_samp(model).alias("_mod"), F.corr(reference, model).alias("r"),
        F.stddev_samp(F.col(reference) - F.col(model)).alias("_diff"),
    )
    sd = F.try_divide(F.col("_mod"), F.col("_ref"))
    return sums.select(
        *keys, *[c for c in sums.columns if c not in (*keys, "_ref", "_mod", "r", "_diff")], F.lit(1.0).alias("sd_meas"),
        sd.alias("sd"), "r",
        F.try_divide(F.col("_diff"), F.col("_ref")).alias("centered_rms"),
        taylor_x(sd, "r").alias("x_coord"), taylor_y(sd, "r").alias("y_coord"),
    )


def sensor_model_taylor(sensor: DataFrame, weather: DataFrame, month: str) -> DataFrame:
    """Sensor against weather model per site and variable, normalised by the weather model's sd.

    Both sides are long: site_id, day, variable, and ``sensor`` / ``weather`` values.
    """
    both = F.col("sensor").isNotNull() & F.col("weather").isNotNull()
    paired = sensor.join(weather, ["site_id", "day", "variable"], "left")
    rows = paired.select("site_id", "variable", *[F.when(both, F.col(c)).alias(c) for c in ("sensor", "weather")])
    stats = _taylor(rows, ["site_id", "variable"], "weather", "sensor")
    return stats.select("site_id", F.lit(month).alias("month"), F.col("variable").alias("name"), *stats.columns[2:])


def driver_agreement(paired: DataFrame, keys: Sequence[str] = ("site_id", "variable")) -> DataFrame:
    """Bias of the weather model against the sensor, with the Taylor statistics."""
    rows = complete_cases(paired.select(*keys, "sensor", "weather"))
    bias = F.avg(F.col("weather") - F.col("sensor")).alias("bias")
    return _taylor(rows, keys, "weather", "sensor", bias, F.count(F.lit(1)).alias("n")).drop("sd_meas")


def coverage(
    df: DataFrame, keys: Sequence[str] = (), obs: str = "flux", lo: str = "q0025", hi: str = "q0975", scale: float = 1.0
) -> DataFrame:
    """Share of observations inside and outside an interval; rows where that is unknown are left out."""
    flag = within(obs, lo, hi)
    return df.groupBy(*keys).agg(
        (F.avg(flag.cast("double")) * scale).alias("within_true"),
        (F.avg((~flag).cast("double")) * scale).alias("within_false"),
    )


def coverage_80(df: DataFrame, keys: Sequence[str] = (), obs: str = "flux") -> DataFrame:
    """Share of observations between the 10% and 90% quantiles."""
    return df.groupBy(*keys).agg(F.avg(within(obs, "q0100", "q0900").cast("double")).alias("coverage_80"))


def with_absolute_error(df: DataFrame, mean: str = "mean", obs: str = "observation") -> DataFrame:
    """The score of a single number: its distance to the observation."""
    return df.withColumn("abs_err", F.abs(F.col(mean) - F.col(obs)))


@dataclass(frozen=True)
class Span:
    """When a forecast begins and ends, and when it was made."""

    first: Column
    last: Column
    made: Column

    @property
    def monday(self) -> Column:
        return week_start(self.first)


def spanned(forecast: DataFrame) -> tuple[DataFrame, Span]:
    """The forecast, settled, and its span, gathered in the same pass: what follows neither makes the forecast again nor
    asks for its bounds."""
    table, seen = settle_observed(
        forecast, first=F.min("datetime"), last=F.max("datetime"), made=F.min("reference_datetime")
    )
    return table, Span(**seen)


def with_intervals(df: DataFrame, span: Span, duration: str) -> DataFrame:
    """Add ``interval_id`` counted from the Monday of the forecast's first week, and drop incomplete rows."""
    return complete_cases(df.withColumn("interval_id", interval_id("datetime", span.monday, span.last, duration)))


def observations_in_span(targets: DataFrame, span: Span, duration: str) -> DataFrame:
    """Targets between the forecast's first Monday and last time, with their interval."""
    return with_intervals(targets.where(F.col("datetime").between(span.monday, span.last)), span, duration)


def forecast_statistics(forecast: DataFrame, targets: DataFrame, duration: str) -> DataFrame:
    """Summaries per site, variable and evaluation interval next to the observations of that interval."""
    keys = ["site_id", "variable", "interval_id"]
    forecast, span = spanned(forecast)
    summary = ensemble_summary(with_intervals(forecast, span, duration), keys, "prediction")
    observed = observations_in_span(targets, span, duration).drop("project_id", "duration")
    scored = with_absolute_error(summary.join(observed, keys)).withColumn("reference_datetime", F.to_date(span.made))
    return scored.select(
        "site_id", "datetime", "observation", "reference_datetime", "variable", "mean", "sd", *QUANTILES, "abs_err"
    )
